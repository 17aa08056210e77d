"""Metrics over predictions, probabilities and evidence matrices."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import matrix, metrics
from .registry import query, table

_GT = "SELECT l.doc_id, lang, source, quality AS gt, CASE WHEN (l.doc_id * 7) % 10 < 7 THEN quality ELSE 1 - quality END AS pred, ((l.doc_id * 13) % 100) / 100.0 AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def _predictions(spark, sf_dir):
    """Labels as truth, with made-up predictions and probabilities."""
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    right = (F.col("doc_id") * 7) % 10 < 7
    return l.select("doc_id", "lang", "source", F.col("quality").alias("gt"), F.when(right, F.col("quality")).otherwise(1 - F.col("quality")).alias("pred"), (((F.col("doc_id") * 13) % 100) / 100.0).alias("p"))


_CLASS = f"""WITH x AS ({_GT}), k AS (SELECT c, count_if(gt = c AND pred = c) AS tp, count_if(gt <> c AND pred = c) AS fp, count_if(gt = c AND pred <> c) AS fn, count_if(gt = c) AS support FROM x, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c),
 m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM k),
 f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""


@query(_CLASS + " SELECT c AS class, support, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM f")
def classification_metrics(spark, sf_dir):
    """Per class, a class without support included."""
    r = metrics.per_class(_predictions(spark, sf_dir), "gt", "pred", [0, 1, 2])
    return r.select("class", "support", *(F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")))


@query(_CLASS + " SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 4) AS accuracy, round(avg(round(recall, 4)) FILTER (support > 0), 4) AS balanced_accuracy, round(avg(round(f1, 4)), 4) AS macro_f1, round((avg(round(recall, 4)) FILTER (support > 0) - 1 / 3.0) / (2 / 3.0), 4) AS norm_balanced_accuracy FROM f")
def metric_summary(spark, sf_dir):
    r = metrics.summary(_predictions(spark, sf_dir), "gt", "pred", [0, 1, 2])
    return r.select("n", *(F.round(c, 4).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "norm_balanced_accuracy")))


@query(f"SELECT gt, pred, count(*) AS n FROM ({_GT}) GROUP BY ALL")
def confusion(spark, sf_dir):
    return metrics.confusion(_predictions(spark, sf_dir), "gt", "pred")


@query(f"""WITH x AS ({_GT}), s AS (SELECT count(*) AS s, count_if(gt = pred) AS c, count_if(gt = 0) AS t0, count_if(gt = 1) AS t1, count_if(pred = 0) AS p0, count_if(pred = 1) AS p1 FROM x)
 SELECT round((c * s - t0 * p0 - t1 * p1) / (sqrt(s * s - p0 * p0 - p1 * p1) * sqrt(s * s - t0 * t0 - t1 * t1)), 5) AS mcc FROM s""")
def mcc(spark, sf_dir):
    return metrics.mcc(_predictions(spark, sf_dir), "gt", "pred", [0, 1]).select(F.round("mcc", 5).alias("mcc"))


@query(f"SELECT coalesce(lang, '(all)') AS lang, coalesce(source, '(all)') AS source, count(*) AS n, round(avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END), 5) AS accuracy FROM ({_GT}) GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def metric_slices(spark, sf_dir):
    """All slices and the total in one pass."""
    x = _predictions(spark, sf_dir)
    g = x.groupingSets([[F.col("lang"), F.col("source")], [F.col("lang")], []], F.col("lang"), F.col("source")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("gt") == F.col("pred")).cast("double")), 5).alias("accuracy"))
    return g.select(F.coalesce("lang", F.lit("(all)")).alias("lang"), F.coalesce("source", F.lit("(all)")).alias("source"), "n", "accuracy")


@query(f"""WITH x AS ({_GT}), b AS (SELECT floor(p * 10) AS bin, count(*) AS c, avg(p) AS p, avg(CAST(gt AS DOUBLE)) AS a FROM x WHERE p < 1 GROUP BY 1),
 q AS (SELECT avg(CAST(gt AS DOUBLE)) AS g1, avg(p) AS p1 FROM x)
 SELECT (SELECT round(avg(power(p - gt, 2)), 6) FROM x) AS brier, (SELECT round(sum(c / (SELECT count(*) FROM x) * abs(a - p)), 6) FROM b) AS ece, (SELECT round(g1 * ln(g1 / p1) + (1 - g1) * ln((1 - g1) / (1 - p1)), 6) FROM q) AS kl""")
def brier_ece_kl(spark, sf_dir):
    x = _predictions(spark, sf_dir)
    one = x.agg(F.round(metrics.brier(F.col("p"), F.col("gt")), 6).alias("brier"), F.avg(F.col("gt").cast("double")).alias("g"), F.avg("p").alias("q"))
    g, q = F.col("g"), F.col("q")
    e = metrics.ece(x, "p", "gt").select(F.round("ece", 6).alias("ece"))
    return one.join(e).select("brier", "ece", F.round(metrics.kl([g, 1 - g], [q, 1 - q]), 6).alias("kl"))


@query(f"""WITH x AS (SELECT gt = pred AS a, (doc_id * 11) % 10 < 6 AS b FROM ({_GT})), s AS (SELECT count_if(a AND NOT b) AS b, count_if(b AND NOT a) AS c FROM x) SELECT b, c, round(power(abs(b - c) - 1, 2) / (b + c), 5) AS statistic FROM s""")
def mcnemar(spark, sf_dir):
    x = _predictions(spark, sf_dir).select((F.col("gt") == F.col("pred")).alias("a"), ((F.col("doc_id") * 11) % 10 < 6).alias("other"))
    return metrics.mcnemar(x, "a", "other").select("b", "c", F.round("statistic", 5).alias("statistic"))


_DRAWS = "CAST('0x' || substr(md5(doc_id || ':' || r || ':42'), 1, 12) AS BIGINT)"


@query(f"""WITH x AS ({_GT}), n AS (SELECT lang, count(*) AS n, count_if(gt = pred) AS c FROM x GROUP BY 1), a AS (SELECT lang, r, count_if({_DRAWS} % n < c) / count(*) AS accuracy FROM x JOIN n USING (lang), (SELECT unnest(range(1, 101)) AS r) GROUP BY ALL)
 SELECT lang, round(avg(accuracy), 6) AS mean, round(list_sort(list(accuracy))[3], 6) AS low, round(list_sort(list(accuracy))[98], 6) AS high FROM a GROUP BY 1""")
def bootstrap_ci(spark, sf_dir):
    """A hundred resamples of each stratum, drawn from hashes, so the same each time."""
    x = _predictions(spark, sf_dir).withColumn("ok", F.col("gt") == F.col("pred"))
    return metrics.bootstrap(x, "doc_id", "ok", 100, stratum="lang").select("lang", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query(f"""WITH x AS ({_GT}), k AS (SELECT lang, gt, count(*) AS n, count_if(gt = pred) AS ok FROM x GROUP BY ALL), m AS (SELECT lang, arg_min(gt, (-n, gt)) AS majority_class, max(n) / sum(n) AS majority_accuracy, sum(ok) / sum(n) AS accuracy FROM k GROUP BY 1)
 SELECT lang, majority_class, round(majority_accuracy, 5) AS majority_accuracy, accuracy > majority_accuracy AS beats_majority FROM m""")
def beats_majority(spark, sf_dir):
    """Whether a system is better than always naming the largest class."""
    k = _predictions(spark, sf_dir).groupBy("lang", "gt").agg(F.count("*").alias("n"), F.count_if(F.col("gt") == F.col("pred")).alias("ok"))
    m = k.groupBy("lang").agg(F.min_by("gt", F.struct(-F.col("n"), "gt")).alias("majority_class"), (F.max("n") / F.sum("n")).alias("m"), (F.sum("ok") / F.sum("n")).alias("a"))
    return m.select("lang", "majority_class", F.round("m", 5).alias("majority_accuracy"), (F.col("a") > F.col("m")).alias("beats_majority"))


_T = "(1 / (1 + 0.3275911 * z))"


@query(f"""WITH x AS (SELECT lang, gt = pred AS a, (doc_id * 11) % 10 < 6 AS b FROM ({_GT})), s AS (SELECT lang, count_if(a AND NOT b) AS b, count_if(b AND NOT a) AS c FROM x GROUP BY 1), z AS (SELECT *, sqrt(CASE WHEN b + c > 0 THEN power(abs(b - c) - 1, 2) / (b + c) ELSE 0 END / 2) AS z FROM s)
 SELECT lang, round((0.254829592 * {_T} - 0.284496736 * power({_T}, 2) + 1.421413741 * power({_T}, 3) - 1.453152027 * power({_T}, 4) + 1.061405429 * power({_T}, 5)) * exp(-z * z), 5) AS p FROM z""")
def mcnemar_p(spark, sf_dir):
    """How likely so uneven discordant counts are by chance."""
    x = _predictions(spark, sf_dir).select("lang", (F.col("gt") == F.col("pred")).alias("a"), ((F.col("doc_id") * 11) % 10 < 6).alias("o"))
    s = x.groupBy("lang").agg(F.count_if(F.col("a") & ~F.col("o")).alias("b"), F.count_if(~F.col("a") & F.col("o")).alias("c"))
    statistic = F.when(F.col("b") + F.col("c") > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / (F.col("b") + F.col("c"))).otherwise(0.0)
    return s.select("lang", F.round(metrics.chi2_tail(statistic), 5).alias("p"))


@query()
def platt_calibrated(spark, sf_dir):
    """Scores as probabilities, fit fold by fold; the fit is iterative, so there is no SQL."""
    return metrics.platt_folds(_predictions(spark, sf_dir).select("doc_id", "p", "gt"), "doc_id", "p", "gt", 3).select("doc_id", "fold", F.round("probability", 6).alias("probability"))


@query(f"""WITH x AS (SELECT x.*, n_chars // 4 AS tokens FROM ({_GT}) x JOIN documents USING (doc_id)), y AS (SELECT lang, source, count(*) AS n, avg(CASE WHEN gt = pred THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN gt = (doc_id * 11) % 2 THEN 1.0 ELSE 0 END) AS b, avg(CASE WHEN pred = (doc_id * 11) % 2 THEN 1.0 ELSE 0 END) AS agree, sum(tokens) AS t, sum(CASE WHEN doc_id % 2 = 0 THEN tokens // 2 ELSE tokens END) AS u FROM x GROUP BY ALL)
 SELECT lang, source, n, round(a - b, 5) AS accuracy_delta, round(agree, 5) AS agreement, CAST(t - u AS BIGINT) AS token_delta FROM y""")
def head_to_head_tokens(spark, sf_dir):
    """Two systems by two keys: the difference of their accuracies, their agreement, and what one needs more in tokens."""
    x = _predictions(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 4).alias("tokens")), "doc_id").withColumn("other", (F.col("doc_id") * 11) % 2)
    share = lambda c: F.avg(c.cast("double"))
    less = F.when(F.col("doc_id") % 2 == 0, F.floor(F.col("tokens") / 2)).otherwise(F.col("tokens"))
    g = x.groupBy("lang", "source").agg(F.count("*").alias("n"), (share(F.col("gt") == F.col("pred")) - share(F.col("gt") == F.col("other"))).alias("d"), share(F.col("pred") == F.col("other")).alias("a"), (F.sum("tokens") - F.sum(less)).alias("token_delta"))
    return g.select("lang", "source", "n", F.round("d", 5).alias("accuracy_delta"), F.round("a", 5).alias("agreement"), "token_delta")


@query(f"""WITH x AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE doc_id * 7 % 11 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'partial' ELSE 'supported' END AS verdict FROM ({_GT}))
 SELECT confidence, count(*) AS n, count_if(verdict = 'supported') AS supported, count_if(verdict = 'partial') AS partial, count_if(verdict = 'unsupported') AS unsupported, CASE WHEN confidence <> 'high' THEN 'not judged' WHEN count(*) < 20 THEN 'too few' WHEN round(100.0 * count_if(verdict = 'unsupported') / count(*), 1) / 100 > 0.12 THEN 'fail' ELSE 'pass' END AS gate FROM x GROUP BY 1""")
def unsupported_gate(spark, sf_dir):
    """The share of unsupported statements by confidence, parsed back from the report's rows, and the gate on the high ones."""
    confidence = F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("low")
    verdict = F.when(F.col("doc_id") * 7 % 11 == 0, "unsupported").when(F.col("doc_id") * 7 % 11 == 1, "partial").otherwise("supported")
    x = _predictions(spark, sf_dir).select(confidence.alias("confidence"), verdict.alias("verdict"))
    report = metrics.support_report(x, "confidence", "verdict")
    return metrics.support_gate(report, threshold=0.12, least=20)


_RUNS = f"SELECT x.*, s, CASE WHEN (doc_id * (s + 3)) % 10 < 5 + s THEN gt ELSE 1 - gt END AS said FROM ({_GT}) x, (SELECT unnest([0, 1, 2, 3]) AS s)"


@query(f"""WITH a AS (SELECT 'run' || s AS system, s, count(*) AS n, avg(CASE WHEN gt = said THEN 1.0 ELSE 0 END) AS accuracy FROM ({_RUNS}) GROUP BY ALL)
 SELECT a.system, a.n, round(a.accuracy, 5) AS accuracy, round(a.accuracy - r.accuracy, 5) AS delta, round(a.accuracy - p.accuracy, 5) AS step FROM a LEFT JOIN a r ON r.s = 0 LEFT JOIN a p ON p.s = a.s - 1""")
def ablation_table(spark, sf_dir):
    """Every configuration against the first, and against the one before it."""
    x = _predictions(spark, sf_dir).withColumn("s", F.explode(F.array(*map(F.lit, range(4)))))
    said = F.when((F.col("doc_id") * (F.col("s") + 3)) % 10 < 5 + F.col("s"), F.col("gt")).otherwise(1 - F.col("gt"))
    a = x.groupBy("s").agg(F.count("*").alias("n"), F.avg((F.col("gt") == said).cast("double")).alias("a"))
    r = a.filter("s = 0").select(F.col("a").alias("r"))
    p = a.select((F.col("s") + 1).alias("s"), F.col("a").alias("p"))
    return a.join(F.broadcast(r)).join(p, "s", "left").select(F.concat(F.lit("run"), "s").alias("system"), "n", F.round("a", 5).alias("accuracy"), F.round(F.col("a") - F.col("r"), 5).alias("delta"), F.round(F.col("a") - F.col("p"), 5).alias("step"))


@query(f"SELECT gt AS majority_class, n AS majority_n, round(n / sum(n) OVER (), 5) AS share FROM (SELECT gt, count(*) AS n FROM ({_GT}) GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, gt) = 1")
def majority_class(spark, sf_dir):
    """The largest class, of equals the first declared."""
    x = _predictions(spark, sf_dir).groupBy("gt").agg(F.count("*").alias("n"))
    r = x.agg(F.min_by("gt", F.struct(-F.col("n"), "gt")).alias("majority_class"), F.max("n").alias("majority_n"), F.sum("n").alias("all"))
    return r.select("majority_class", "majority_n", F.round(F.col("majority_n") / F.col("all"), 5).alias("share"))


@query(f"""WITH x AS ({_GT}), y AS (SELECT lang, avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN gt = (doc_id * 11) % 2 THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN pred = (doc_id * 11) % 2 THEN 1.0 ELSE 0.0 END) AS agree FROM x GROUP BY 1)
 SELECT lang, round(a, 5) AS accuracy_a, round(b, 5) AS accuracy_b, round(a - b, 5) AS delta, round(agree, 5) AS agreement FROM y""")
def head_to_head(spark, sf_dir):
    """Two systems on the same rows: accuracies, their difference, agreement."""
    x = _predictions(spark, sf_dir).withColumn("other", (F.col("doc_id") * 11) % 2)
    share = lambda c: F.avg(c.cast("double"))
    g = x.groupBy("lang").agg(share(F.col("gt") == F.col("pred")).alias("a"), share(F.col("gt") == F.col("other")).alias("b"), share(F.col("pred") == F.col("other")).alias("agree"))
    return g.select("lang", F.round("a", 5).alias("accuracy_a"), F.round("b", 5).alias("accuracy_b"), F.round(F.col("a") - F.col("b"), 5).alias("delta"), F.round("agree", 5).alias("agreement"))


_MATRIX = """A AS (SELECT label AS query_id, vec_id AS row, i AS ind, CAST(embedding[i] AS DOUBLE) AS val FROM embeddings, (SELECT unnest(range(1, 9)) AS i)),
 I AS (SELECT label AS query_id, i AS ind, 'h' || h AS hyp, avg(CAST(embedding[8 + (h - 1) * 8 + i] AS DOUBLE)) AS val FROM embeddings, (SELECT unnest(range(1, 9)) AS i), (SELECT unnest(range(1, 5)) AS h) GROUP BY ALL),
 V AS (SELECT query_id, ind, var_pop(val) AS v FROM I GROUP BY ALL), D AS (SELECT query_id, ind, v / sum(v) OVER (PARTITION BY query_id) AS d FROM V),
 S AS (SELECT A.query_id, hyp, sum(A.val * d * I.val) / count(DISTINCT A.row) AS score FROM A JOIN I ON A.query_id = I.query_id AND A.ind = I.ind JOIN D ON D.query_id = A.query_id AND D.ind = A.ind GROUP BY ALL)"""


@query(f"WITH {_MATRIX} SELECT query_id, hyp, round(score * 1000, 6) AS score, round(exp(score) / sum(exp(score)) OVER (PARTITION BY query_id), 6) AS prob, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hyp) AS rank FROM S")
def matrix_aggregate(spark, sf_dir):
    """Presence, influence and diagnosticity: mean score of each hypothesis, softmax, rank."""
    a, i = _evidence(spark, sf_dir)
    r = matrix.aggregate(a, i)
    return r.select("query_id", "hyp", F.round(F.col("score") * 1000, 6).alias("score"), F.round("prob", 6).alias("prob"), "rank")


def _evidence(spark, sf_dir):
    """Presence (query_id, row, ind, val) and influence (query_id, ind, hyp, val) from parts of the vectors."""
    e = table(spark, sf_dir, "embeddings")
    ind = F.posexplode(F.slice("embedding", 1, 8)).alias("p", "v")
    a = e.select(F.col("label").alias("query_id"), F.col("vec_id").alias("row"), ind).select("query_id", "row", (F.col("p") + 1).alias("ind"), F.col("v").cast("double").alias("val"))
    i = e.select(F.col("label").alias("query_id"), F.posexplode(F.slice("embedding", 9, 32)).alias("p", "v"))
    i = i.groupBy("query_id", (F.col("p") % 8 + 1).alias("ind"), F.concat(F.lit("h"), (F.floor(F.col("p") / 8) + 1).cast("string")).alias("hyp")).agg(F.avg(F.col("v").cast("double")).alias("val"))
    return a, i


_STACK = """A AS (SELECT label AS query_id, vec_id AS row, i AS ind, CAST(embedding[i] AS DOUBLE) AS val FROM embeddings, (SELECT unnest(range(1, 9)) AS i)),
 I AS (SELECT label AS query_id, i AS ind, 'h' || h AS hyp, avg(CAST(embedding[8 + (h - 1) * 8 + i] AS DOUBLE)) AS val FROM embeddings, (SELECT unnest(range(1, 9)) AS i), (SELECT unnest(range(1, 5)) AS h) GROUP BY ALL),
 C AS (SELECT * FROM (VALUES ('base', false, false, false), ('calibrated', true, false, false), ('weighted', true, true, false), ('absence', true, true, true)) t(config, cal, diag, gone)),
 P AS (SELECT query_id, i AS ind, 0.1 * i AS phi FROM (SELECT DISTINCT label AS query_id FROM embeddings), (SELECT unnest(range(1, 9)) AS i)),
 B AS (SELECT config, query_id, row, ind, CASE WHEN cal THEN 1 / (1 + exp(-(2 * val - 0.1))) ELSE val END AS val FROM A, C UNION ALL SELECT config, query_id, -1, ind, 1 - 1 / (1 + exp(-(2 * phi - 0.1))) FROM P, C WHERE gone),
 J AS (SELECT config, diag, query_id, ind, hyp, CASE WHEN cal THEN 1 / (1 + exp(-(2 * val - 0.1))) ELSE val END AS val FROM I, C),
 V AS (SELECT config, query_id, ind, var_pop(val) AS v FROM J GROUP BY ALL), D AS (SELECT config, query_id, ind, CASE WHEN sum(v) OVER w < 1e-10 THEN 1.0 / count(*) OVER w ELSE v / sum(v) OVER w END AS d FROM V WINDOW w AS (PARTITION BY config, query_id)),
 S AS (SELECT config, query_id, hyp, sum(B.val * CASE WHEN diag THEN d ELSE 1 END * J.val) / count(DISTINCT B.row) AS score FROM B JOIN J USING (config, query_id, ind) JOIN D USING (config, query_id, ind) GROUP BY ALL)"""


@query(f"WITH {_STACK} SELECT config, query_id, hyp, row_number() OVER (PARTITION BY config, query_id ORDER BY round(score, 9) DESC, hyp) AS rank FROM S")
def configuration_stack(spark, sf_dir):
    """Four configurations over the same matrices, each with one step more: calibration, diagnosticity, a row for what is absent."""
    a, i = _evidence(spark, sf_dir)
    calibrated = lambda c: 1 / (1 + F.exp(-(2 * c - 0.1)))
    phi = a.select("query_id", "ind").distinct().withColumn("val", F.col("ind") * 0.1)
    out = None
    for name, cal, diag, gone in (("base", False, False, False), ("calibrated", True, False, False), ("weighted", True, True, False), ("absence", True, True, True)):
        x, y, z = ((t.withColumn("val", calibrated(F.col("val"))) if cal else t) for t in (a, i, phi))
        r = matrix.aggregate(matrix.with_absence(x, z) if gone else x, y, weighted=diag).select(F.lit(name).alias("config"), "query_id", "hyp", "score")
        out = r if out is None else out.unionByName(r)
    best = W.partitionBy("config", "query_id").orderBy(F.round("score", 9).desc(), "hyp")
    return out.select("config", "query_id", "hyp", F.row_number().over(best).alias("rank"))


@query("WITH r AS (SELECT label AS query, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings) SELECT query, vec_id, CASE WHEN query % 2 = 0 AND rank = 1 THEN 2 WHEN query % 2 = 0 AND rank = 2 THEN 1 ELSE rank END AS rank FROM r")
def contested_swap(spark, sf_dir):
    """The first two of a ranking change places where a closer look says so."""
    r = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query"), "vec_id", F.row_number().over(W.partitionBy("label").orderBy(F.desc(F.col("embedding")[0]), "vec_id")).alias("rank"))
    return matrix.swap_top(r.withColumn("contested", F.col("query") % 2 == 0), "contested").select("query", "vec_id", "rank")
