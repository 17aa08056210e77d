"""Request tables for methods that ask a model, and what becomes of the responses; the call itself is a landed table or a hook."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons
from .ranking import keep_first, plurality


@dataclass(frozen=True)
class Method:
    """A way to ask: samples for each question, rounds, evidence pieces, and whether each piece is a request of its own."""

    name: str
    samples: int = 1
    rounds: int = 1
    evidence: int = 0
    fan_out: bool = False
    combine: str = "first"  # first, plurality


#: The battery: direct, reasoned, with evidence, with claims, self-consistent, debated, branching, reflected, ensemble, hybrid, facts.
METHODS = {m.name: m for m in (
    Method("direct"), Method("reasoned"), Method("evidence", evidence=10), Method("claims", rounds=2, evidence=10, fan_out=True), Method("consistent", samples=5, evidence=10, combine="plurality"), Method("debate", samples=3, rounds=2, evidence=10, combine="plurality"),
    Method("branches", samples=3, rounds=2, evidence=10, combine="plurality"), Method("reflected", rounds=3, evidence=10), Method("ensemble", samples=3, combine="plurality"), Method("hybrid", evidence=20), Method("facts", evidence=20),
)}


def key(*parts: Column) -> Column:
    return F.concat_ws("::", *(p.cast("string") for p in parts))


def build(questions: DataFrame, method: Method, prompt: Column, ident: str = "id", pieces: str | None = None) -> DataFrame:
    """request_id, question, round, sample, prompt for the first round; with fan_out one request for each evidence piece."""
    q = questions.withColumn("prompt", prompt)
    if method.fan_out and pieces:
        q = q.withColumn("piece", F.explode(F.slice(pieces, 1, method.evidence)))
        parts = [F.col(ident), F.lit(method.name), F.lit("r1"), F.col("piece")]
    else:
        q = q.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(method.samples))))
        parts = [F.col(ident), F.lit(method.name), F.lit("r1"), F.col("sample")]
    return q.select(key(*parts).alias("request_id"), F.col(ident).alias("question"), F.lit(1).alias("round"), "prompt")


def pending(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests that have no response yet: what a resumed run still has to send."""
    return requests.join(responses.select("request_id"), "request_id", "left_anti")


def chunks(requests: DataFrame, size: int) -> DataFrame:
    """A chunk number for each request; about `size` requests a chunk, by a hash, so that no global order is needed."""
    n = max(1, -(-requests.count() // size))
    return requests.withColumn("chunk", F.pmod(F.xxhash64("request_id"), F.lit(n)))


def send(requests: DataFrame, call: Callable, schema: str = "request_id string, content string, error string") -> DataFrame:
    """The hook: call takes an iterator of Arrow batches and gives responses; partitions are the parallel senders."""
    return requests.mapInArrow(call, schema)


def predictions(requests: DataFrame, responses: DataFrame, hypotheses: Sequence[str], combine: str) -> DataFrame:
    """question, predicted_class, parse_failed: a question without a parsed choice has failed and is never given a default."""
    hs = F.array(*map(F.lit, hypotheses))
    picks = requests.join(responses, "request_id", "left").withColumn("pick", jsons.pick(F.col("content"), hs))
    if combine == "plurality":
        out = plurality(picks, ["question"], "pick", hypotheses, every=True).select("question", F.col("choice").alias("predicted_class"))
    else:
        chosen = keep_first(picks.filter(F.col("pick").isNotNull()), ["question"], [F.col("request_id")]).select("question", F.col("pick").alias("predicted_class"))
        out = requests.select("question").distinct().join(chosen, "question", "left")
    return out.withColumn("parse_failed", F.col("predicted_class").isNull())


def routed(questions: DataFrame, contract: DataFrame, plans: dict[str, Callable[[DataFrame], DataFrame]], by: str = "benchmark") -> DataFrame:
    """Each question goes through the retrieval plan that the contract names for its benchmark; one that finds nothing goes through 'fallback'."""
    known = questions.join(contract, by, "left").withColumn("mode", F.coalesce("mode", F.lit("fallback")))
    out, columns = None, questions.columns
    for mode, plan in plans.items():
        part = plan(known.filter(F.col("mode") == mode).select(*columns)).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    if "fallback" in plans:
        ident = columns[0]
        missed = known.filter("mode <> 'fallback'").select(*columns).join(out.select(ident), ident, "left_anti")
        out = out.unionByName(plans["fallback"](missed).withColumn("mode", F.lit("fallback")))
    return out
