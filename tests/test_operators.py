import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import cascade, graph, matrix, merging, metrics, ranking, similarity


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_merge_keeps_longest_text_and_first_values(spark):
    data = [("a", 0, "xx", "t0", "", ["p"]), ("a", 1, "yyy", "t1", "d1", ["q", "p"]), ("a", 2, "zzz", "t2", "d2", ["r"]), ("b", 3, "w", "t3", None, ["p"])]
    df = spark.createDataFrame(data, "id string, pos int, text string, title_text string, day string, prov array<string>")
    out = merging.dedup_merge(df, "id", "pos", "text", ["title_text"], ["day"], ["prov"])
    assert rows(out.select("id", "text", "title_text", "day", "prov", "n_records"), "id") == [("a", "yyy", "t1", "d1", ["p", "q", "r"], 3), ("b", "w", "t3", "", ["p"], 1)]


def test_look_ahead_boundaries(spark):
    cutoff, days = datetime.date(2026, 3, 10), [datetime.date(2026, 3, 9), datetime.date(2026, 3, 10), datetime.date(2026, 3, 11), None, datetime.date(2025, 1, 1)]
    df = spark.createDataFrame([(i, d, cutoff) for i, d in enumerate(days)], "i int, d date, c date")
    kept = {n: [r["i"] for r in df.filter(p.allows(F.col("d"), F.col("c"))).orderBy("i").collect()] for n, p in cascade.POLICIES.items()}
    assert kept["quality"] == [0, 3, 4] and kept["fetch"] == [0, 1, 3, 4] and kept["earnings_link"] == [0, 1] and kept["relevance"] == [0] and kept["rebuild"] == [0, 1, 4]


def test_reasons_and_gate(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "i int, v int")
    checks = [("small", F.col("v") < 10), ("odd", F.col("i") % 2 == 1)]
    kept, dropped = cascade.split(df, cascade.all_reasons(checks))
    assert rows(kept.select("i"), "i") == [(2,)] and rows(dropped.select("i", "drop_reasons"), "i") == [(1, ["small", "odd"]), (3, ["odd"])]
    assert rows(df.select("i", cascade.first_reason(checks, "ok").alias("r")), "i") == [(1, "small"), (2, "ok"), (3, "odd")]
    cascade.gate(kept, df, {"null": F.col("i").isNull()})
    with pytest.raises(AssertionError):
        cascade.gate(df, df, {})


def test_ranking(spark):
    votes = spark.createDataFrame([("a", "No", 1), ("a", "Yes", 2), ("b", "x", 3), ("b", "No", 4)], "k string, v string, o int")
    assert rows(ranking.plurality(votes, ["k"], "v", ["Yes", "No"]).select("k", "choice"), "k") == [("a", "Yes"), ("b", "No")]
    assert rows(ranking.mode_first(votes, ["k"], "v", "o").select("k", "mode"), "k") == [("a", "No"), ("b", "x")]
    c = spark.createDataFrame([(1, "p", True, 9.0), (1, "q", False, 5.0), (1, "r", False, 7.0), (1, "s", True, 1.0)], "g int, i string, pin boolean, s double")
    assert rows(ranking.pinned_top_k(c, ["g"], F.col("pin"), F.col("i"), [F.desc("s")], 3).select("rank", "i"), "rank") == [(1, "p"), (2, "s"), (3, "r")]
    assert ranking.gini(spark.createDataFrame([("a", 0), ("a", 0)], "k string, v int"), ["k"], "v").first()["gini"] == 0.0


def test_components_and_canonical(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 1), (20, 21)], "a long, b long")
    assert rows(graph.components(e), "node") == [(1, 1), (2, 1), (3, 1), (7, 1), (8, 1), (20, 20), (21, 20)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert graph.components(chain).filter("component <> 0").count() == 0
    assert graph.components(e.filter("false")).count() == 0


def test_banded_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((80, 16))
    x[50:60] = x[:10] + 0.05 * rng.standard_normal((10, 16))
    day = [None if i % 9 == 0 else datetime.date(2026, 1, 1) + datetime.timedelta(days=int(i % 7)) for i in range(80)]
    df = spark.createDataFrame([(i, day[i], [float(v) for v in x[i]]) for i in range(80)], "vec_id long, day date, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [(i, j) for i in range(80) for j in range(i + 1, 80) if day[i] and day[j] and abs((day[i] - day[j]).days) <= 3 and u[i] @ u[j] >= 0.8]
    assert rows(similarity.banded_pairs(df, 3, 0.8).select("a", "b"), "a", "b") == want
    top = similarity.cosine_top_k(df, df.filter("vec_id < 3").withColumnRenamed("vec_id", "query_id"), 4)
    got = {}
    for r in top.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item"])
    assert got == {i: list(np.argsort(-(u @ u[i]), kind="stable")[:4]) for i in range(3)}


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, None)], "t int, p int")
    s = metrics.summary(df, "t", "p", [0, 1, 2]).first()
    assert (s["n"], round(s["accuracy"], 3), round(s["balanced_accuracy"], 4)) == (5, 0.6, round((0.6667 + 0.5) / 2, 4))
    c = spark.createDataFrame([(1.0, 0), (0.95, 1), (0.95, 0)], "c double, y int")
    assert abs(metrics.ece(c, "c", "y").first()["ece"] - 2 / 3 * 0.45) < 1e-9  # a confidence of 1 is in no bin
    assert abs(metrics.chi2_p(3.841458820694124) - 0.05) < 1e-6
    a, b = metrics.platt(spark.createDataFrame([(float(x), int(x + 0.5 * (i % 3 - 1) > 0)) for i, x in enumerate(range(-9, 10))], "x double, y int"), "x", "y")
    assert a > 0


def test_matrix_even_shares_without_variance(spark):
    i = spark.createDataFrame([(1, 1, "x", 0.5), (1, 1, "y", 0.5), (1, 2, "x", 0.5), (1, 2, "y", 0.5)], "query_id long, ind int, hyp string, val double")
    assert [r["d"] for r in matrix.diagnosticity(i).collect()] == [0.5, 0.5]
    a = spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 2, 0.0)], "query_id long, row int, ind int, val double")
    assert [round(r["prob"], 3) for r in matrix.aggregate(a, i).collect()] == [0.5, 0.5]
