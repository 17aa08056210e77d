"""Classification, calibration and significance; class sets are small and declared."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, truth, predicted).agg(F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(df: DataFrame, truth: str, predicted: str, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, support, precision, recall and f1 of every declared class, also of those without support."""
    t, p = F.col(truth), F.col(predicted)
    parts = []
    for c in classes:
        hit, said, is_ = t.eqNullSafe(F.lit(c)) & p.eqNullSafe(F.lit(c)), p.eqNullSafe(F.lit(c)), t.eqNullSafe(F.lit(c))
        parts.append(F.struct(F.lit(c).alias("class"), F.count_if(hit).alias("tp"), F.count_if(said & ~is_).alias("fp"), F.count_if(is_ & ~said).alias("fn"), F.count_if(is_).alias("support")))
    rows = df.groupBy(*by).agg(F.array(*parts).alias("_c")).select(*by, F.inline("_c"))
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = rows.withColumn("precision", precision).withColumn("recall", recall)
    return rows.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(df: DataFrame, truth: str, predicted: str, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy, balanced accuracy (classes with support), its normal form, and macro-F1 (all classes, from rounded F1)."""
    k = len(classes)
    rows = per_class(df, truth, predicted, classes, by)
    balanced = F.avg(F.when(F.col("support") > 0, F.round("recall", 4)))
    out = rows.groupBy(*by).agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), balanced.alias("balanced_accuracy"), F.avg(F.round("f1", 4)).alias("macro_f1"))
    return out.withColumn("norm_balanced_accuracy", (F.col("balanced_accuracy") - 1.0 / k) / (1 - 1.0 / k) if k > 1 else F.lit(0.0))


def mcc(df: DataFrame, truth: str, predicted: str, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Gorodkin's correlation; rows outside the declared classes don't count."""
    rows = df.filter(F.col(truth).isin(*classes) & F.col(predicted).isin(*classes))
    rows = per_class(rows, truth, predicted, classes, by)
    s, c = F.sum("support"), F.sum("tp")
    t2, p2 = F.sum(F.col("support") * F.col("support")), F.sum((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fp")))
    tp = F.sum(F.col("support") * (F.col("tp") + F.col("fp")))
    den = F.sqrt(F.greatest(s * s - p2, F.lit(0))) * F.sqrt(F.greatest(s * s - t2, F.lit(0)))
    return rows.groupBy(*by).agg(F.when(den > 0, (c * s - tp) / den).otherwise(0.0).alias("mcc"))


def brier(p: Column, outcome: Column) -> Column:
    return F.avg(F.pow(p - outcome.cast("double"), 2))


def ece(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over right-open bins: a confidence of 1 is in none of them, but counts in n."""
    total = df.agg(F.count("*").alias("n"))
    by = df.filter((F.col(confidence) >= 0) & (F.col(confidence) < 1)).groupBy(F.floor(F.col(confidence) * bins).alias("bin")).agg(F.count("*").alias("c"), F.avg(confidence).alias("p"), F.avg(F.col(correct).cast("double")).alias("a"))
    return by.crossJoin(total).agg(F.sum(F.col("c") / F.col("n") * F.abs(F.col("a") - F.col("p"))).alias("ece"))


def kl(p: Sequence[Column], q: Sequence[Column], eps: float = 1e-9) -> Column:
    """Divergence of distributions, clipped away from 0 and normalised again."""
    clipped = [[F.greatest(x, F.lit(eps)) for x in side] for side in (p, q)]
    totals = [sum(side[1:], side[0]) for side in clipped]
    terms = [(x / totals[0]) * F.ln((x / totals[0]) / (y / totals[1])) for x, y in zip(*clipped, strict=True)]
    return sum(terms[1:], terms[0])


def mcnemar(df: DataFrame, a_correct: str, b_correct: str) -> DataFrame:
    """Discordant counts and the statistic with continuity correction."""
    b, c = F.count_if(F.col(a_correct) & ~F.col(b_correct)), F.count_if(~F.col(a_correct) & F.col(b_correct))
    return df.agg(b.alias("b"), c.alias("c")).withColumn("statistic", F.when(F.col("b") + F.col("c") > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / (F.col("b") + F.col("c"))).otherwise(0.0))


def chi2_p(statistic: float) -> float:
    """The upper tail of chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(max(statistic, 0.0) / 2))


# Coefficients of a rational approximation of erfc, good to seven digits.
ERFC = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def chi2_tail(statistic: Column) -> Column:
    """chi2_p as an expression, to seven digits."""
    z = F.sqrt(F.greatest(statistic, F.lit(0.0)) / 2)
    t = 1 / (1 + ERFC[0] * z)
    powers = [F.lit(c) * F.pow(t, F.lit(k)) for k, c in enumerate(ERFC[1:], 1)]
    return sum(powers[1:], powers[0]) * F.exp(-z * z)


def bootstrap(df: DataFrame, ident: str, correct: str, rounds: int = 1000, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """Mean and 95% interval of accuracy over resamples of the size of each stratum; the interval's ends are sorted values by index.

    Every row makes one draw in each round, by a hash of its id: a number below the stratum's size, which is a hit where it is
    below its number of correct rows, as if these came first. So rows never meet, and what is shuffled is a partial sum for each round.
    """
    by = [stratum] if stratum else []
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if(F.col(correct)).alias("_c"))
    rows = df.select(*by, F.col(ident).cast("string").alias("_id"))
    rows = rows.join(F.broadcast(sizes), stratum) if stratum else rows.join(F.broadcast(sizes))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "_id", "round", F.lit(str(seed))).cast("binary")), 1, 12), 16, 10).cast("long") % F.col("_n")
    hits = rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).groupBy(*by, "round").agg((F.count_if(drawn < F.col("_c")) / F.count("*")).alias("accuracy"))
    values = F.sort_array(F.collect_list("accuracy"))  # as many as there are rounds
    at = lambda q: F.get(F.col("values"), F.lit(min(rounds - 1, int(q * rounds))))
    return hits.groupBy(*by).agg(F.avg("accuracy").alias("mean"), values.alias("values")).select(*by, "mean", at(0.025).alias("low"), at(0.975).alias("high"))


def platt(df: DataFrame, score: str, label: str, steps: int = 25) -> tuple[float, float]:
    """a and b of sigmoid(a x + b) by Newton's method; each step is one aggregate."""
    a, b = 0.0, 0.0
    x, y = F.col(score), F.col(label).cast("double")
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(a * x + b)))
        w = p * (1 - p)
        r = df.agg(F.sum((y - p) * x), F.sum(y - p), F.sum(w * x * x), F.sum(w * x), F.sum(w)).first()
        g1, g0, h11, h10, h00 = (float(v or 0) for v in r)
        h11, h00 = h11 + 1e-9, h00 + 1e-9
        det = h11 * h00 - h10 * h10
        if abs(det) < 1e-18:
            break
        da, db = (h00 * g1 - h10 * g0) / det, (h11 * g0 - h10 * g1) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a, b


def platt_folds(df: DataFrame, ident: str, score: str, label: str, folds: int = 5) -> DataFrame:
    """Calibrated probabilities, each from a fit on the other folds; folds are dealt by the id."""
    rows, out = df.withColumn("fold", F.pmod(F.col(ident), F.lit(folds))), None
    for k in range(folds):
        a, b = platt(rows.filter(F.col("fold") != k), score, label)
        part = rows.filter(F.col("fold") == k).withColumn("probability", 1 / (1 + F.exp(-(a * F.col(score) + b))))
        out = part if out is None else out.unionByName(part)
    return out


def support_report(df: DataFrame, confidence: str, verdict: str) -> DataFrame:
    """One line of a report for each confidence: | `high` | n | supported | partial | unsupported | share % |."""
    g = df.groupBy(confidence).agg(F.count("*").alias("n"), *(F.count_if(F.col(verdict) == v).alias(v) for v in ("supported", "partial", "unsupported")))
    share = F.format_string("%.1f", 100.0 * F.col("unsupported") / F.col("n"))
    return g.select(F.format_string("| `%s` | %d | %d | %d | %d | %s%% |", F.col(confidence), "n", "supported", "partial", "unsupported", share).alias("line"))


def support_gate(report: DataFrame, threshold: float, least: int, judged: str = "high") -> DataFrame:
    """The report's numbers with the gate's word: 'too few', 'fail' over the threshold, 'pass', and 'not judged' for other rows."""
    pattern = r"^\|\s*`?(\w+)`?\s*\|\s*(\d+)\s*\|\s*(\d+)\s*\|\s*(\d+)\s*\|\s*(\d+)\s*\|\s*([0-9.]+)\s*%"
    cell = lambda k: F.regexp_extract("line", pattern, k)
    n, share = cell(2).cast("long"), cell(6).cast("double") / 100
    gate = F.when(cell(1) != judged, "not judged").when(n < least, "too few").when(share > threshold, "fail").otherwise("pass")
    return report.select(cell(1).alias("confidence"), n.alias("n"), *(cell(k).cast("long").alias(c) for k, c in ((3, "supported"), (4, "partial"), (5, "unsupported"))), gate.alias("gate"))
