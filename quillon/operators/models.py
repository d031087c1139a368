"""Predictive models on spark.ml: cross-validated classifiers, PCA, survival and ridge regression.

Folds are a column of the table, so a split is a filter; every fold's model is fitted by Spark on the executors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    FMClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, MinMaxScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.evaluation import auc_brier
from quillon.operators.nearest import nearest


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


def classifier(kind: str, inputs: int = 0) -> Estimator:
    return {
        "logistic": lambda: LogisticRegression(maxIter=20, regParam=0.01),
        "boosted_trees": lambda: GBTClassifier(maxIter=5, maxDepth=3, seed=42),
        "linear_svc": lambda: LinearSVC(maxIter=20, regParam=0.01),
        "random_forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=42),
        "decision_tree": lambda: DecisionTreeClassifier(maxDepth=5, seed=42),
        "naive_bayes": lambda: NaiveBayes(modelType="gaussian"),
        "perceptron": lambda: MultilayerPerceptronClassifier(layers=[inputs, 8, 2], maxIter=50, seed=42),
        "factorisation": lambda: FMClassifier(stepSize=0.01, maxIter=30, seed=42),
    }[kind]()


def cross_validated(df: DataFrame, kind: str, columns: list[str], label: str, fold: str, k: int) -> DataFrame:
    """One row for each fold: its size and the scores on it of a model fitted on the others."""
    data = assembled(df.withColumn("label", F.col(label).cast("double")), columns).select("features", "label", fold)
    if kind in ("perceptron", "factorisation"):  # these need inputs of one size
        data = MinMaxScaler(inputCol="features", outputCol="scaled").fit(data).transform(data).select(F.col("scaled").alias("features"), "label", fold)
    out = None
    for i in range(k):
        model = classifier(kind, len(columns)).fit(data.where(F.col(fold) != i))
        scored = model.transform(data.where(F.col(fold) == i))
        raw = vector_to_array("probability")[1] if "probability" in scored.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        row = auc_brier(scored.select(F.col("label").alias("y"), raw.alias("p")), "y", "p").select(F.lit(i).alias("fold"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def principal_components(df: DataFrame, vector: str, k: int) -> DataFrame:
    """k scores for each row of an array column, after scaling to unit variance."""
    v = df.withColumn("_v", array_to_vector(F.col(vector)))
    s = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(v).transform(v)
    p = PCA(k=k, inputCol="_s", outputCol="_p").fit(s).transform(s).withColumn("_p", vector_to_array("_p"))
    return p.select(*(c for c in df.columns if c != vector), *(F.col("_p")[i].alias(f"pc{i + 1}") for i in range(k)))


def aft(df: DataFrame, columns: list[str], time: str, event: str) -> DataFrame:
    """Predicted survival times of an accelerated failure time model; rows without the event are censored."""
    data = assembled(df.where(F.col(time) > 0), columns).withColumns({"label": F.col(time).cast("double"), "censor": F.col(event).cast("double")})
    return AFTSurvivalRegression(maxIter=20).fit(data).transform(data).drop("features", "label", "censor")


def ridge_held_out(df: DataFrame, columns: list[str], label: str, fold: str, k: int, penalty: float = 1.0) -> DataFrame:
    """One row for each fold: root mean square error and R2 of ridge regression fitted on the others."""
    data = assembled(df, columns).select("features", F.col(label).cast("double").alias("label"), fold)
    out = None
    for i in range(k):
        scored = LinearRegression(regParam=penalty, elasticNetParam=0.0).fit(data.where(F.col(fold) != i)).transform(data.where(F.col(fold) == i))
        e = F.col("label") - F.col("prediction")
        row = scored.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e),
            F.var_pop("label") * F.count("*"))).alias("r2")).select(F.lit(i).alias("fold"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def importances(df: DataFrame, kind: str, columns: list[str], label: str) -> DataFrame:
    """Features of a tree model by their share of the impurity taken away, largest first; `rank` breaks ties by name."""
    data = assembled(df.withColumn("label", F.col(label).cast("double")), columns).select("features", "label")
    found = classifier(kind).fit(data).featureImportances.toArray().tolist()
    rows = sorted(zip(columns, found), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame([(c, float(v), i + 1) for i, (c, v) in enumerate(rows)], "feature string, importance double, rank int")


def multi_class(df: DataFrame, columns: list[str], label: str, fold: str, held: int = 0) -> DataFrame:
    """Boosted trees, one class against the rest, fitted without the fold `held` and applied to it: label and prediction."""
    index = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(df)
    data = assembled(index.transform(df), columns)
    model = OneVsRest(classifier=classifier("boosted_trees"), featuresCol="features", labelCol="label").fit(data.where(F.col(fold) != held).select("features", "label"))
    names = F.array(*map(F.lit, index.labels))
    return model.transform(data.where(F.col(fold) == held)).select(label, names[F.col("prediction").cast("int")].alias("prediction"))


def aft_by_fold(df: DataFrame, columns: list[str], time: str, event: str, fold: str, k: int) -> DataFrame:
    """One row for each fold: rows with the event, and the error of their logarithmic times under a model of the others."""
    data = assembled(df.where(F.col(time) > 0), columns).withColumns({"label": F.col(time).cast("double"), "censor": F.col(event).cast("double")})
    out = None
    for i in range(k):
        scored = AFTSurvivalRegression(maxIter=20).fit(data.where(F.col(fold) != i)).transform(data.where(F.col(fold) == i)).where("censor = 1")
        e = F.ln("label") - F.ln("prediction")
        row = scored.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse_log")).select(F.lit(i).alias("fold"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and sums of products about it of the columns, from one aggregation: its size is that of the columns, not of the rows."""
    d = [F.col(c).cast("double") for c in columns]
    pairs = [(i, j) for i in range(len(d)) for j in range(i, len(d))]
    known = df.dropna(subset=columns)
    one = known.agg(F.count("*").alias("n"), F.array(*map(F.avg, d)).alias("m"), F.array(*(F.covar_pop(d[i], d[j]) for i, j in pairs)).alias("s")).first()
    products = np.zeros((len(d), len(d)))
    for (i, j), v in zip(pairs, one.s):
        products[i, j] = products[j, i] = (v or 0.0) * one.n
    return np.array([m or 0.0 for m in one.m]), products, one.n


def ridge_leave_one_out(df: DataFrame, columns: list[str], labels: list[str], penalty: float = 1.0) -> DataFrame:
    """Of each label: RMSE and R2 of ridge regression where every row is predicted by a model of all others.

    The closed form needs only the row's leverage: one pass for the moments, one for the errors.
    """
    every = [*columns, *labels]
    mean, products, n = moments(df, every)
    k = len(columns)
    inverse = np.linalg.inv(products[:k, :k] + penalty * np.eye(k))
    weights = inverse @ products[:k, k:]
    x = [F.col(c).cast("double") - float(m) for c, m in zip(columns, mean)]
    inner = lambda w: sum((a * float(b) for a, b in zip(x, w)), F.lit(0.0))
    leverage = F.lit(1.0 / n) + sum((x[i] * inner(inverse[i]) for i in range(k)), F.lit(0.0))
    known = df.dropna(subset=every)
    rows = known.select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("y"),
        ((F.col(c).cast("double") - float(mean[k + j]) - inner(weights[:, j])) / (1 - leverage)).alias("e")) for j,
        c in enumerate(labels)))).alias("s")).select("s.*")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        (1 - F.try_divide(F.sum(F.col("e") * F.col("e")), F.var_pop("y") * F.count("*"))).alias("r2"))


def truncated_svd(df: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """k scores for each row of an array column: the rows' products with the first right singular vectors (no centring).

    The matrix of products of columns is summed up over the rows, by partial aggregation, and decomposed on the driver: its
    size is the square of the vector's length. A vector's largest entry is positive, so signs are fixed.
    """
    size = df.select(F.max(F.size(vector))).first()[0] or 0

    def products(batches):
        total = np.zeros((size, size))
        for pdf in batches:
            if len(pdf):
                m = np.vstack(pdf["v"].to_numpy())
                total += m.T @ m
        yield pd.DataFrame({"s": [total.reshape(-1).tolist()]})

    v = df.select(id_col, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    parts = v.select("v").mapInPandas(products, "s array<double>").select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    gram = np.zeros(size * size)
    for r in parts.collect():
        gram[r.i] = r.x
    _, vectors = np.linalg.eigh(gram.reshape(size, size))
    top = vectors[:, ::-1][:, :k]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
    score = lambda c: F.aggregate(F.zip_with("v", F.array(*map(F.lit, c.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return v.select(id_col, *(score(top[:, i]).alias(f"sv{i + 1}") for i in range(top.shape[1])))


def mahalanobis(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Squared distance of each row from the mean under the columns' covariance; NULL where a column is."""
    mean, products, n = moments(df, columns)
    inverse = np.linalg.pinv(products / max(n - 1, 1))
    x = [F.col(c).cast("double") - float(m) for c, m in zip(columns, mean)]
    d = sum((x[i] * x[j] * float(inverse[i, j]) for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
    return df.select(id_col, d.alias("distance"))


def isolation_scores(df: DataFrame, id_col: str, columns: list[str], trees: int = 50, rows: int = 256, seed: int = 42) -> DataFrame:
    """Isolation forest: 2 to the power of minus the mean depth at which random cuts set a row apart, relative to `rows` rows.

    Trees grow on a sample of at most trees * rows rows, drawn by a hash (rows in all where there are fewer); every row is scored.
    """
    known = df.dropna(subset=columns).select(id_col, *(F.col(c).cast("double").alias(c) for c in columns))
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    sample = known.orderBy(order, id_col).limit(trees * rows).toPandas()[columns].to_numpy()
    rng = np.random.default_rng(seed)
    most = int(math.ceil(math.log2(max(2, min(rows, len(sample))))))

    def path(n: int) -> float:
        return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(x: np.ndarray, depth: int):
        spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
        if depth >= most or len(x) <= 1 or not len(spread):
            return depth + path(len(x))
        c = int(rng.choice(spread))
        at = float(rng.uniform(x[:, c].min(), x[:, c].max()))
        return c, at, grow(x[x[:, c] < at], depth + 1), grow(x[x[:, c] >= at], depth + 1)

    forest = [grow(sample[rng.permutation(len(sample))[:rows]], 0) for _ in range(trees)] if len(sample) else []
    scale = path(min(rows, len(sample))) or 1.0

    def score(batches):
        def depths(node, x, at, out):
            if not isinstance(node, tuple):
                out[at] += node
                return
            c, cut, low, high = node
            left = x[at, c] < cut
            depths(low, x, at[left], out)
            depths(high, x, at[~left], out)

        for pdf in batches:
            x, out = pdf[columns].to_numpy(float), np.zeros(len(pdf))
            for tree in forest:
                depths(tree, x, np.arange(len(x)), out)
            yield pd.DataFrame({id_col: pdf[id_col], "score": 2.0 ** (-out / (max(1, len(forest)) * scale))})

    kind = known.schema[id_col].dataType.simpleString()
    return known.mapInPandas(score, f"{id_col} {kind}, score double")


def nearest_neighbours(train: DataFrame, test: DataFrame, id_col: str, columns: list[str], label: str, k: int) -> DataFrame:
    """Majority label of the k nearest training rows (Euclidean; ties by id, then by the smaller label) for each row of test.

    test is a stated set of queries. Rows with a null among the columns are no one's neighbours before all others.
    """
    whole = F.array(*(F.col(c).cast("double") for c in columns))
    v = F.when(~F.exists(whole, lambda x: x.isNull()), whole)
    met = nearest(train.select(F.col(id_col).alias("id"), F.col(label).alias("y"), v.alias("v")), test.select(F.col(id_col).alias("id"), v.alias("v")), k, cosine=False, but_itself=False)
    near = met.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k)
    votes = near.groupBy("q", "y").agg(F.count("*").alias("n"))
    return votes.groupBy("q").agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("prediction")).withColumnRenamed("q", id_col)
