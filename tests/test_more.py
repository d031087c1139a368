"""Operators that SQL doesn't cover, against brute force, and edges of those that it does."""

from __future__ import annotations

import json
import math
import random
import warnings
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import distributions as D
from quillon.functions import text as X
from quillon.functions.numeric import binomial_tail
from quillon.operators import evaluation, models, reports, vectors
from quillon.operators.inference import bootstrap_counts
from quillon.operators.ranges import numbered, quantiles, running_total
from quillon.plans import reference_queries
from quillon.sources import files
from quillon.sources.tables import table


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- ranges


def test_running_total_and_numbers(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), i, r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(7)
    got = {x.k: x.t for x in running_total(df, ["g"], ["k"], "v", "t").collect()}
    up: Counter = Counter()
    for g, k, v in rows:
        up[g] += v
        assert got[k] == up[g]
    assert sorted(x.n for x in numbered(df, ["k"], "n").collect()) == list(range(1, 501))
    assert running_total(df.limit(0), ["g"], ["k"], "v", "t").count() == 0


def test_quantiles(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.choice([None, 1.0, 2.0, r.random()])) for _ in range(300)] + [("c", 5.0), ("d", None)]
    got = {x.g: x for x in quantiles(spark.createDataFrame(rows, "g string, v double"), ["v"], [0.0, 0.1, 0.5, 1.0], ["g"]).collect()}
    for g in "abc":
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g].n == len(v) and got[g].q == pytest.approx(np.quantile(v, [0.0, 0.1, 0.5, 1.0]).tolist())
    assert "d" not in got


def test_concordance(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.choice([None, *range(8)]), r.randint(0, 1), r.randint(0, 5)) for _ in range(200)]
    got = evaluation.concordance(spark.createDataFrame(rows, "g string, t int, e int, r int"), "t", "e", "r", "g").first()
    pairs = [(a[3] > b[3]) + 0.5 * (a[3] == b[3]) for a in rows for b in rows if a[0] == b[0] and a[2] == 1 and None not in (a[1], b[1]) and a[1] < b[1]]
    assert got.n_pairs == len(pairs) and got.c_index == pytest.approx(np.mean(pairs), abs=1e-6)


# --- inference


def test_binomial_tail_of_many(spark):
    some = [(60, 100), (1, 3), (0, 5), (5, 5), (5100, 10_000), (50_100_000, 100_000_000), (7, 3)]
    got = one(spark, *(binomial_tail(F.lit(c), F.lit(n)) for c, n in some))
    for (c, n), p in zip(some, got):
        if n < 20_000:
            assert p == pytest.approx(sum(math.comb(n, k) for k in range(c, n + 1)) / 2**n, rel=1e-6, abs=1e-12)
        else:
            assert p == pytest.approx(D.normal_sf((c - 0.5 - n / 2) / math.sqrt(n / 4)), rel=1e-3)


def test_bootstrap_weights(spark):
    """Over resamples, a group's sum has the mean and variance of Poisson weights, one by one or by the normal quantile."""
    rows = [(i, "x", 1, "1" if i % 4 else "2") for i in range(200)] + [(1000, "x", 1, "3")]
    b = bootstrap_counts(spark.createDataFrame(rows, "case_id long, g string, source int, code string"), "case_id", ["g"], 2000, 7).toPandas()
    for k, n in (("tp", 150), ("fn", 50), ("fp", 1)):
        values = np.append(b[k].to_numpy(float), np.zeros(2000 - len(b)))
        assert values.mean() == pytest.approx(n, rel=0.08) and values.var() == pytest.approx(n, rel=0.15)


def test_distributions():
    assert D.student_sf(2.1788, 12) == pytest.approx(0.025, abs=1e-5) and D.student_sf(-1.0, 5) == pytest.approx(1 - D.student_sf(1.0, 5))
    assert D.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    w, p = D.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))  # from Shapiro and Wilk (1965)
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.01
    assert D.shapiro_wilk(np.array([1.0, 1.0, 1.0])) == (1.0, 1.0) and math.isnan(D.shapiro_wilk(np.array([1.0]))[0])
    d = np.array([3.0, -1.0, 2.0, 5.0, -4.0])
    w, p = D.signed_rank(d)
    ranks = [3, 1, 2, 5, 4]
    every = [sum(k for k, s in zip(ranks, f"{m:05b}") if s == "1") for m in range(32)]
    assert (w, p) == (10.0, sum(x >= 10 for x in every) / 32)
    assert D.signed_rank(np.array([0.0, 0.0, -1.0]))[1] == 1.0


def test_paired_metric_tests(spark):
    r = random.Random(4)
    rows = [(f"E{i}", a, 0.8 + 0.01 * r.gauss(0, 1) + 0.05 * (a == "ai"), 0.1 * (i % 2)) for i in range(12) for a in ("human", "ai")] + [("E99", "ai", 0.5, None)]
    got = {x.metric: x for x in reports.paired_metric_tests(spark.createDataFrame(rows, "element string, annotator string, accuracy double, fabrication_rate double"), ["accuracy", "fabrication_rate"]).collect()}
    assert got["accuracy"].n == 12 and got["accuracy"].p < 0.001 and got["accuracy"].mean_diff > 0.03
    assert got["fabrication_rate"].mean_diff == 0


@pytest.mark.parametrize("x", [0.0, 0.5, 3.841458820694124, 20.0])
def test_chi_square(spark, x):
    assert one(spark, reports.chi_square_1_sf(F.lit(x)))[0] == pytest.approx(math.erfc(math.sqrt(x / 2)), abs=2e-7)


# --- text


def test_redaction_of_text(spark):
    text = "Seen 03/04/2021 at 10:30, MRN: 1234567, aged 93, 95-year-old, call (212) 555-0100, 10001-1234, a@b.org, 123-45-6789, Jan 3, 2020"
    got = one(spark, X.redact_simple(F.lit(text)), X.redact_simple(F.lit(None).cast("string")))
    assert got[0] == "Seen [DATE] at [TIME], [MRN], age [>89], [>89]-year-old, call [PHONE], [ZIP], [EMAIL], [SSN], [DATE]" and got[1] is None
    kind = T.StructType.fromDDL("a string, b array<struct<c:string,n:int>>, m map<string,string>")
    row = spark.createDataFrame([("x 10001", [("y 03/04/2021", 5), None], {"10001": "z@y.org"}), (None, None, None)], kind).select(X.redact_json(F.struct("*"), kind).alias("j")).collect()
    assert row[0].j.asDict(True) == {"a": "x [ZIP]", "b": [{"c": "y [DATE]", "n": 5}, None], "m": {"10001": "[EMAIL]"}} and row[1].j.asDict() == {"a": None, "b": None, "m": None}


def test_every_rule_has_a_match(spark):
    text = {
        "ADDRESS": "12 Main Hill Street", "CITY": "new  york", "ZIP": "10001", "DATE_MDY": "13-44-2020", "DATE_TEXT": "Sept 3, 2020", "DATE_MMDDYY": "1/2/20", "PHONE": "212-555-0100", "FAX": "fax: 212 555 0100",
        "EMAIL": "a@b.org", "SSN": "123-45-6789", "MRN_LABEL": "med rec", "MRN_NUMBER": "123456", "HEALTH_PLAN": "member id: ABC123", "ACCOUNT": "acct no 1234567", "CERTIFICATE": "license # AB12345",
        "VEHICLE": "VIN: 1HGCM82633", "DEVICE": "serial number XY123456", "URL": "www.x.org/a", "IP_ADDRESS": "1.2.3.4", "UNIQUE_ID": "AB123456",
    }
    got = one(spark, *(X.rule_count(F.lit(text[n]), p).alias(n) for n, p in X.REDACTION_RULES))
    assert len(X.REDACTION_RULES) == 20 and all(got[n] == 1 for n in text)


@pytest.mark.parametrize("seed", range(6))
def test_recursive_chunks(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word", "longer word", "x" * r.randint(1, 90), "\n\n", "\n", " ", ". "]) for _ in range(200))
    chunks = X.recursive_chunks(text, 60, 10)
    assert all(0 < len(c) <= 60 for c in chunks)
    assert "".join(text.split()) in "".join("".join(chunks).split()) or set(text.split()) <= set(" ".join(chunks).split()) or any(len(w) > 60 for w in text.split())
    assert X.recursive_chunks("  \n ") == [] and X.recursive_chunks("short") == ["short"]


def test_parse_response(spark):
    rows = [("{\"a\": null, \"b\": \"N/A\"}", False, "N/A"), ("x {\"a\": \"2 cm\"} y", True, "2 cm"), ("Not stated there", False, "Not reported"), ("illegible", True, "Unclear (illegible)"), ("", False, ""), ("{oops", True, "{oops")]
    got = spark.createDataFrame([(r[0],) for r in rows], "t string").select(*(c.alias(k) for k, c in X.parse_response(F.col("t")).items())).collect()
    assert [(g.present, g.value) for g in got] == [r[1:] for r in rows]


# --- vectors and models


def test_similar_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 6))
    rows = [(i, int(i % 3), (base[i % 40] + rng.normal(size=6) * 0.25).tolist()) for i in range(160)] + [(900, 0, [0.0] * 6)]
    copies = [(5000 + i, rows[0][1], rows[0][2]) for i in range(50)]
    got = {(x.a, x.b): x.sim for x in vectors.similar_pairs(spark.createDataFrame(rows + copies, "vec_id long, label int, embedding array<double>"), 0.8, "label").collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows if any(v)}
    want = {(i, j): float(unit[i] @ unit[j]) for i, a, _ in rows for j, b, _ in rows if i < j and a != b and i in unit and j in unit and unit[i] @ unit[j] >= 0.8}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items()) and len(want) > 100


def test_longest_common_subsequence(spark):
    r = random.Random(6)
    rows = [([r.choice("abc") for _ in range(r.randint(0, 90))], [r.choice("abc") for _ in range(r.randint(0, 90))]) for _ in range(30)]
    got = evaluation.with_lcs(spark.createDataFrame(rows, "a array<string>, b array<string>"), "a", "b").collect()
    for (a, b), g in zip(rows, got):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert g.lcs == t[-1][-1]


def test_svd_and_pca(spark):
    e = table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id", "embedding")
    m = np.array([r.embedding for r in e.orderBy("vec_id").collect()], float)
    got = models.truncated_svd(e, "vec_id", "embedding", 3).orderBy("vec_id").toPandas()[["sv1", "sv2", "sv3"]].to_numpy()
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    assert np.abs(np.abs(got) - np.abs(u[:, :3] * s[:3])).max() < 1e-6
    scores = models.principal_components(e, "embedding", 2).orderBy("vec_id").toPandas()[["pc1", "pc2"]].to_numpy()
    z = (m - m.mean(0)) / m.std(0, ddof=1)
    _, _, v = np.linalg.svd(z - z.mean(0), full_matrices=False)
    assert np.abs(np.abs(scores) - np.abs(z @ v[:2].T)).max() < 1e-6


def test_ridge_leave_one_out(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=40)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, y double")
    errors = []
    for i in range(40):
        k = np.arange(40) != i
        c, m, n = x[k] - x.mean(0), y[k] - y.mean(), len(x)
        whole = x - x.mean(0)
        w = np.linalg.solve(whole[k].T @ whole[k] + np.outer(whole[i], whole[i]) * 0 + np.eye(2) + np.outer(whole[i], whole[i]) / (n - 1), c.T @ m + whole[i] * (y[i] - y.mean()) / (n - 1))
        errors.append(y[i] - (y[k].mean() + (x[i] - x[k].mean(0)) @ np.linalg.solve((x[k] - x[k].mean(0)).T @ (x[k] - x[k].mean(0)) + np.eye(2), (x[k] - x[k].mean(0)).T @ (y[k] - y[k].mean()))))
    got = models.ridge_leave_one_out(df, ["a", "b"], ["y"]).first()
    assert got.n == 40 and got.rmse == pytest.approx(math.sqrt(np.mean(np.square(errors))), rel=1e-6)


def test_isolation_forest(spark):
    rng = np.random.default_rng(8)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(300)] + [(999, 9.0, 9.0), (1000, None, 1.0)]
    got = models.isolation_scores(spark.createDataFrame(rows, "i long, a double, b double"), "i", ["a", "b"]).toPandas()
    assert len(got) == 301 and got.score.between(0, 1).all() and got.i[got.score.idxmax()] == 999


def test_classifiers_beat_chance(spark):
    rng = np.random.default_rng(9)
    rows = [(float(a + i % 2 * 2), float(b), i % 2, i % 3) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, y int, fold int")
    for kind in ("random_forest", "decision_tree", "naive_bayes", "perceptron"):
        assert min(r.auc for r in models.cross_validated(df, kind, ["a", "b"], "y", "fold", 3).collect()) > 0.75, kind
    assert models.importances(df, "random_forest", ["a", "b"], "y").orderBy("rank").first().feature == "a"
    said = models.nearest_neighbours(df.where("fold > 0").withColumn("i", F.monotonically_increasing_id()), df.where("fold = 0").withColumn("i", F.monotonically_increasing_id()), "i", ["a", "b"], "y", 5)
    assert said.count() == 100


def test_queries_have_rows(spark, sf_dir):
    for name in ("isolation_forest", "svd_embed", "cluster_sizes", "recursive_chunks", "paired_metric_tests"):
        assert reference_queries()[name](spark, sf_dir).count() > 0, name


# --- sources


def test_columns_by_name(spark):
    assert reports.find_column(["a ", "My_Date", "date"], [" DATE"]) == "date" and reports.find_column(["x", "My_Date"], ["zz", "date"]) == "My_Date" and reports.find_column([], ["a"]) is None
    kept, gone = reports.without_identifiers(spark.createDataFrame([(1, 2, 3)], "id int, name int, v int"), ["name", "other"], ["v", "name"])
    assert kept.columns == ["v"] and gone == ["id", "name"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c1", 1), ("c2", 2)], "case_id string, n int")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert files.write_csv_if_there(df, str(tmp_path / "out")) and not files.write_csv_if_there(df, str(tmp_path / "none" / "out"))
    files.write_cases(df, str(tmp_path / "j"), "case_id")
    assert spark.read.json(str(tmp_path / "j" / "combined")).count() == 2 and json.loads(spark.read.text(str(tmp_path / "j" / "cases" / "_case=c2")).first()[0]) == {"case_id": "c2", "n": 2}
    files.write_tables({"a": df, "b": df}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "b")).count() == 2
    made = []
    vectors_at = lambda force=False: files.vector_store(spark, str(tmp_path / "v"), lambda: made.append(1) or spark.createDataFrame([(1, [3.0, 4.0])], "id int, embedding array<double>"), force)
    assert vectors_at().first().length == 5.0 and vectors_at().count() == 1 and len(made) == 1 and vectors_at(True).count() == 1 and len(made) == 2


def test_resume_dispatch_and_json(spark, tmp_path):
    items, log = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a", "OK"), ("b", "ERROR"), ("b", "ERROR")], "k string, status string")
    assert sorted(r.k for r in files.todo(items, log, "k").collect()) == ["b", "c"]
    assert [tuple(r) for r in files.with_status(spark.createDataFrame([("a", None), ("b", "bad")], "k string, e string"), "k", "e").collect()] == [("a", "OK", None), ("b", "ERROR", "bad")]
    p = spark.createDataFrame([("x/a.TXT", "hello"), ("x/b.txt", " "), ("x/c.pdf", "t"), ("x/d", "t")], "path string, body string")
    assert [r.status for r in files.by_extension(p, {"txt": F.col("body"), "docx": F.col("body")}).collect()] == ["OK", "EMPTY", "UNSUPPORTED", "UNSUPPORTED"]
    assert files.provider_for("gpt-4o-mini", {"gpt": 1, "gpt-4o": 2}) == 2
    with pytest.raises(KeyError):
        files.provider_for("other", {"gpt": 1})
    (tmp_path / "one.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.json_cases(spark, str(tmp_path / "*.json")).count() == 2
    files.write(items, str(tmp_path / "o.json"))
    assert spark.read.json(str(tmp_path / "o.json")).count() == 3


def test_arima(spark):
    """Errors' likelihood against a dense multivariate normal; the forecast of an AR(1) of differences decays towards a level."""
    from quillon.operators.series import arima, arma_fit

    rng = np.random.default_rng(12)
    e = rng.normal(size=300)
    x = np.zeros(300)
    for t in range(1, 300):
        x[t] = 0.6 * x[t - 1] + e[t] + 0.3 * e[t - 1]
    phi, theta, var, ll, _, _ = arma_fit(x)
    assert abs(phi - 0.6) < 0.15 and abs(theta - 0.3) < 0.2 and 0.8 < var < 1.2
    gamma = [var * (1 + 2 * phi * theta + theta**2) / (1 - phi**2), var * (1 + phi * theta) * (phi + theta) / (1 - phi**2)]
    while len(gamma) < 300:
        gamma.append(phi * gamma[-1])
    cov = np.array([[gamma[abs(i - j)] for j in range(300)] for i in range(300)])
    dense = -0.5 * (300 * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + x @ np.linalg.solve(cov, x))
    assert ll == pytest.approx(dense, rel=1e-6)
    rows = [("a", i, float(v)) for i, v in enumerate(np.cumsum(x))] + [("b", i, 1.0 * i) for i in range(5)]
    got = arima(spark.createDataFrame(rows, "g string, t long, y double"), "g", "t", "y").collect()
    assert [(r.g, r.step) for r in got] == [("a", 1), ("a", 2), ("a", 3)] and got[0].bic > got[0].aic


def test_sgml_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sgm").write_text("<DOC id=1><TITLE>one</TITLE></DOC>\n<DOC><TITLE>two</TITLE></DOC>")
    s = files.sgml_documents(files.corpus_stream(spark, str(tmp_path / "in")), "text", "DOC", ["TITLE"])
    s.writeStream.format("memory").queryName("sgml").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert sorted(r.title for r in spark.table("sgml").collect()) == ["one", "two"]


def test_skipped_rules_change_nothing(spark):
    r = random.Random(11)
    parts = ["12 Main Hill Street", "New York", "10001", "1/2/20", "fax: 212 555 0100", "a@b.org", "patient id", "policy # ABCDEF", "acct no ABCDEFG", "permit id ABCDEF", "plate ABCDEF", "serial no ABCDEFG", "www.x.org", "VIN ABCDEF", " ", "x"]
    rows = [(i, " ".join(r.choices(parts, k=r.randint(0, 4)))) for i in range(400)]

    def plain(text):
        for name, pattern in X.REDACTION_RULES:
            text = F.regexp_replace(text, f"(?i){pattern}", f"[{name}]")
        return text

    got = spark.createDataFrame(rows, "i int, t string").select(X.redact(F.col("t")).alias("a"), plain(F.col("t")).alias("b"))
    assert got.where("a <> b").count() == 0 and got.where("a like '%[%'").count() > 200


def test_rules_match_as_in_sql(spark, tmp_path):
    import duckdb

    from quillon.plans import reference_oracles

    r = random.Random(12)
    parts = ["12 Main Hill St", "San Jo\u017fe", "Broo\u212alyn", "10001", "1/2/20", "fax: 212 555 0100", "a@b.org", "patient id", "policy # ABCDE\u017f", "\u017ferial no ABCDEFG", "www.x.org/ä", "VIN ABCDEF", "\u017f\u212a123456",
        "aged 93", "95-year-old", "123-45-6789", "May 3, 2020", "MRN: 1234567", "(212) 555-0100", "1.2.3.4"]
    glue = [" ", " ", "ß", "é", "\u0301", "\x0b", "\u00a0", "\u017f", "_", ", "]
    rows = [(i, "".join(r.choice(parts) + r.choice(glue) for _ in range(r.randint(0, 3))) + r.choice(glue), "en", "x") for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("phi_rule_counts", "redact_text", "redact_simple"):
        want = db.execute(reference_oracles()[name]).fetchall()
        got = reference_queries()[name](spark, str(tmp_path)).select(*(c[0] for c in db.description))
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_holt_is_per_series(spark):
    from quillon.operators.series import holt

    rows = [(g, i, 10.0 + i * s) for g, s in (("a", 2.0), ("b", -1.0)) for i in range(12)]
    got = holt(spark.createDataFrame(rows, "g string, t long, y double"), "g", "t", "y").toPandas()
    assert set(got["g"]) == {"a", "b"} and isinstance(got, pd.DataFrame)
    for g, s in (("a", 2.0), ("b", -1.0)):  # a straight line goes on
        one_of = got[got["g"] == g].sort_values("step")
        assert one_of.forecast.tolist() == pytest.approx([10 + s * (11 + k) for k in (1, 2, 3)]) and one_of.mae.max() == 0
