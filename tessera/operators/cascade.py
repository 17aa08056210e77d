"""Filter cascades with reasons, look-ahead policies, and gates on what they leave."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Checks = list[tuple[str, Column]]


def all_reasons(checks: Checks) -> Column:
    """Names of every check that fails; a check that is null does not fail."""
    return F.array_compact(F.array(*(F.when(bad, name) for name, bad in checks)))


def first_reason(checks: Checks, otherwise: str | None = None) -> Column:
    """The name of the first check that fails."""
    out = F
    for name, bad in checks:
        out = out.when(bad, name)
    return out.otherwise(otherwise)


def split(df: DataFrame, reasons: Column, name: str = "drop_reasons") -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and dropped rows with their reasons."""
    tagged = df.withColumn(name, reasons)
    return tagged.filter(F.size(name) == 0).drop(name), tagged.filter(F.size(name) > 0)


@dataclass(frozen=True)
class LookAhead:
    """Which evidence a question may see. Bounds: 'before' (day < cutoff) or 'until' (day <= cutoff); undated kept or not; days back."""

    bound: str = "before"
    undated: bool = True
    lookback: int | None = None

    def allows(self, day: Column, cutoff: Column) -> Column:
        ok = day < cutoff if self.bound == "before" else day <= cutoff
        if self.lookback is not None:
            ok = ok & (day >= F.date_sub(cutoff, self.lookback))
        return F.when(cutoff.isNull(), F.lit(True)).when(day.isNull(), F.lit(self.undated)).otherwise(ok)


#: The policies in use, by stage.
POLICIES = {
    "quality": LookAhead("before", True),
    "fetch": LookAhead("until", True),
    "earnings_link": LookAhead("until", False, 90),
    "relevance": LookAhead("before", False, 90),
    "editorial": LookAhead("before", False),
    "horizon": LookAhead("before", True),
    "rebuild": LookAhead("until", False),
    "relink": LookAhead("before", False),
    "attach": LookAhead("before", False, 90),
}


def shipped(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Only the fields that are published, in their order; one that the table lacks is null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields))


def fetch_outcomes(df: DataFrame, checks: Checks, url: str, title: str, by: str, order: Sequence[Column], name: str = "outcome") -> DataFrame:
    """What becomes of fetched records: the first check that fails, then 'dup_url' for a url met before, 'dup_title' for a title of the same `by` met before, else 'kept'.

    Only records that got as far count as met before. Keys of both kinds are dealt by themselves; copies of one url beyond the first are settled by the first step.
    """
    tagged = df.withColumn(name, first_reason(checks))
    first = F.row_number().over(W.partitionBy(url, F.col(name).isNull()).orderBy(*order)) == 1
    tagged = tagged.withColumn(name, F.coalesce(name, F.when(~first, "dup_url")))
    first = F.row_number().over(W.partitionBy(by, title, F.col(name).isNull()).orderBy(*order)) == 1
    return tagged.withColumn(name, F.coalesce(name, F.when(~first, "dup_title"), F.lit("kept")))


def gate(df: DataFrame, before: DataFrame, rules: dict[str, Column]) -> None:
    """Raise unless df has rows, fewer than before, and no row breaks a rule."""
    n, m = df.count(), before.count()
    if n == 0:
        raise AssertionError("nothing is left")
    if n >= m:
        raise AssertionError(f"nothing was dropped: {n} of {m}")
    broken = df.agg(*(F.count_if(bad).alias(name) for name, bad in rules.items())).first().asDict() if rules else {}
    if any(broken.values()):
        raise AssertionError(f"rules are broken: {broken}")
