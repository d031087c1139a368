"""Readers of run folders, JSON, CSV, text and markup, and the sinks beside them."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of the paths that exists, on whatever file system it names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(f"none of {paths}")


def csv(spark: SparkSession, path: str, *, schema: T.StructType | str | None = None, header: bool = True, null_value: str = "", names: list[str] | None = None, text_only: bool = False) -> DataFrame:
    """CSV with quoted line ends. names: for files without a header. text_only: every column is a string."""
    reader = spark.read.option("header", header).option("multiLine", True).option("escape", '"').option("nullValue", null_value)
    if schema is not None:
        reader = reader.schema(schema)
    elif not text_only:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.toDF(*names) if names else df


def json_cases(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One document a file, or an array of them, of one file or a glob."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def runs(spark: SparkSession, path: str, approaches: list[str]) -> DataFrame:
    """metrics.json files of run folders <model>_<approach>_<stamp>: run_id, model, approach, element and its metrics.

    Longer approach names are tried first, as some begin with others.
    """
    raw = spark.read.text(f"{path}/*/metrics.json", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"),
        -2).alias("run_id"), F.from_json("value", "map<string,map<string,double>>").alias("m"))
    names = "|".join(sorted(approaches, key=len, reverse=True))
    parts = lambda k: F.regexp_extract("run_id", rf"^(.+)_({names})_([^_].*)$", k)
    return raw.select("run_id", parts(1).alias("model"), parts(2).alias("approach"), F.explode("m").alias("element", "metrics"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: case_id (the file's stem) and text."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("case_id"), F.col("value").alias("text"))


def corpus_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same files as a stream: each new file once. sgml_documents() and the text functions take it as they take a table."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    raw = spark.readStream.format("text").option("wholetext", True).load(path)
    return raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("case_id"), F.col("value").alias("text"))


def sgml_documents(raw: DataFrame, text_col: str, tag: str, fields: list[str]) -> DataFrame:
    """Documents between <tag ...> and </tag>, with the contents of their first <field> elements."""
    found = raw.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))).alias("body"))
    return found.select("body", *(F.regexp_extract("body", rf"(?s)<{f}\b[^>]*>(.*?)</{f}>", 1).alias(f.lower()) for f in fields))


def case_folders(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Folders <surgeon>_<patient>_<type> of file paths: their parts, and the files in each."""
    folder = F.element_at(F.split(F.col(path_col), "/"), -2)
    part = lambda k: F.regexp_extract("folder", "^([A-Z]+)_([A-Z]+)_(inv|dcis|invasive)$", k)
    kind = F.when(part(3) == "dcis", "dcis").otherwise("invasive")
    named = files.select(folder.alias("folder"), F.element_at(F.split(F.col(path_col), "/"), -1).alias("file")).where(part(1) != "")
    return named.groupBy("folder").agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_set("file")),
        "|").alias("files")).select("folder", part(1).alias("surgeon"), part(2).alias("patient"), kind.alias("tumor_type"), "n_files", "files")


def text_with_fallback(candidates: list[tuple[str, Column, int]]) -> tuple[Column, Column]:
    """The first text that is longer than its method's gate, and the method's name: ('' , 'none') without any."""
    text, method = F.lit(""), F.lit("none")
    for name, c, gate in reversed(candidates):
        good = F.length(F.trim(F.coalesce(c, F.lit("")))) > gate
        text, method = F.when(good, c).otherwise(text), F.when(good, name).otherwise(method)
    return text, method


def write(df: DataFrame, path: str) -> None:
    """By the path's ending: .csv, .json or .parquet."""
    for ending, save in ((".csv", lambda w: w.option("header", True).csv(path)), (".json", lambda w: w.json(path)), (".parquet", lambda w: w.parquet(path))):
        if path.endswith(ending):
            return save(df.write.mode("overwrite"))
    raise ValueError(f"no format for {path}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_csv_if_there(df: DataFrame, path: str) -> bool:
    """CSV with a header at path, if the folder above it exists; otherwise a warning and False. Never raises."""
    try:
        if not exists(df.sparkSession, path.rstrip("/").rpartition("/")[0] or "/"):
            warnings.warn(f"no folder for {path}: not written", stacklevel=2)
            return False
        df.write.mode("overwrite").option("header", True).csv(path)
        return True
    except Exception as e:  # a report that can't be written doesn't end the analysis
        warnings.warn(f"{path} was not written: {e}", stacklevel=2)
        return False


def write_cases(df: DataFrame, path: str, key: str) -> None:
    """JSON documents twice: path/cases/<key>=<value> with one folder a case, path/combined with all of them."""
    rows = df.withColumn("_case", F.col(key))
    rows.write.mode("overwrite").partitionBy("_case").json(f"{path}/cases")
    df.write.mode("overwrite").json(f"{path}/combined")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A parquet folder for each table, as a workbook has a sheet for each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def todo(items: DataFrame, log: DataFrame, key: str, done: tuple[str, ...] = ("OK", "DONE")) -> DataFrame:
    """Items without a log row (key, status) that says they are done: what a repeated run has left to do."""
    finished = log.where(F.col("status").isin(*done)).select(key).distinct()
    return items.join(finished, key, "left_anti")


def with_status(results: DataFrame, key: str, error: str) -> DataFrame:
    """Log rows of a run: key, status OK or ERROR, and the error's text."""
    return results.select(key, F.when(F.col(error).isNull(), "OK").otherwise("ERROR").alias("status"), F.col(error).alias("error"))


def by_extension(paths: DataFrame, contents: dict[str, Column], path_col: str = "path") -> DataFrame:
    """Adds text, taken from the column that the path's ending (in lower case) names, and status: OK, EMPTY or UNSUPPORTED."""
    ending = F.lower(F.regexp_extract(F.col(path_col), r"\.([^./]+)$", 1))
    text = F.coalesce(*(F.when(ending == k, c) for k, c in contents.items()), F.lit(None).cast("string"))
    status = F.when(~ending.isin(*contents), "UNSUPPORTED").when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, "EMPTY").otherwise("OK")
    return paths.withColumn("text", text).withColumn("status", status)


def vector_store(spark: SparkSession, path: str, make, force: bool = False) -> DataFrame:
    """Vectors (id, embedding, unit length beside) at path, built by make() where there are none or force is set."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        v = make()
        n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        v.withColumn("length", n).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def provider_for(model: str, providers: dict):
    """The provider whose name the model's name begins with, the longest such name first; KeyError without one."""
    for prefix in sorted(providers, key=len, reverse=True):
        if model.startswith(prefix):
            return providers[prefix]
    raise KeyError(f"no provider for {model}")


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """Parquet at path, made first where it isn't there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(conf).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def provider_map(prompts: DataFrame, call, out: str = "case_id string, element string, raw_response string") -> DataFrame:
    """Answers of a model provider, call(list of prompts) -> list of texts, a batch at a time. prompts: case_id, element, prompt."""

    def run(batches):
        for pdf in batches:
            yield pdf[["case_id", "element"]].assign(raw_response=call(pdf["prompt"].tolist()))

    return prompts.mapInPandas(run, out)


def dry_run(prompts: list[str]) -> list[str]:
    """A provider that answers without a model."""
    return ['{"value": "not stated"}' for _ in prompts]
