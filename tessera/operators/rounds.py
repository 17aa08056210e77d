"""Methods that ask in several rounds: what each round asks, from the answers of the round before, and what the last one says.

A round is a table of requests (question, slot, request_id, prompt). The hook that answers takes such a table and gives
request_id and content; it is called once for each round, and requests and answers are written before they are read again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons
from ..storage import written
from .ranking import keep_first, plurality
from .requests import METHODS, Method, key

Call = Callable[[DataFrame], DataFrame]


def from_config(config: dict[str, dict]) -> dict[str, Method]:
    """Methods by name: a known one with some of its settings changed, or with `like` a new one that takes another's settings."""
    out = {}
    for name, given in config.items():
        settings = {f: getattr(METHODS[given.get("like", name)], f) for f in Method.__dataclass_fields__}
        out[name] = Method(**{**settings, **{k: v for k, v in given.items() if k != "like"}, "name": name})
    return out


def _asked(rows: DataFrame, method: Method, r: int) -> DataFrame:
    """rows: question, slot, prompt."""
    return rows.select("question", "slot", key(F.col("question"), F.lit(method.name), F.lit(f"r{r}"), F.col("slot")).alias("request_id"), "prompt")


def _fan(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.withColumn("slot", F.explode(F.array(*map(F.lit, names))))


def first(questions: DataFrame, method: Method) -> DataFrame:
    """questions: question, prompt, and with fan_out pieces (an array of id and text). Round 0."""
    if method.fan_out:
        piece = questions.select("question", "prompt", F.explode(F.slice("pieces", 1, method.evidence)).alias("p"))
        return _asked(piece.select("question", F.col("p.id").alias("slot"), F.concat_ws("\n", "prompt", "p.text").alias("prompt")), method, 0)
    return _asked(_fan(questions.select("question", "prompt"), [f"a{i}" for i in range(method.samples)]), method, 0)


def following(questions: DataFrame, method: Method, r: int, asked: DataFrame, answers: DataFrame, width: int = 800) -> DataFrame:
    """Round r from the answers of the round before; a missing answer is an empty text."""
    given = asked.join(answers, "request_id", "left").select("question", "slot", "prompt", F.coalesce("content", F.lit("")).alias("content"))
    before = given.drop("prompt")
    base = questions.select("question", "prompt")
    if method.name == "reflected":
        last = before.filter("slot <> 'critique'").select("question", F.substring("content", 1, width).alias("said"))
        rows = base.join(last, "question")
        critique = rows.select("question", F.lit("critique").alias("slot"), F.concat(F.lit("Criticise:\n"), "said").alias("prompt"))
        return _asked(critique.unionByName(rows.select("question", F.lit("a0").alias("slot"), F.concat("prompt", F.lit("\nBefore:\n"), "said").alias("prompt"))), method, r)
    if method.name == "branches":
        # the first round asks with the question's own prompt
        grown = (given if r == 1 else before.join(base, "question")).select("question", F.col("slot").alias("parent"), "prompt", F.substring("content", 1, width).alias("said"))
        grown = _fan(grown, [f"a{i}" for i in range(method.samples)]).withColumn("slot", F.concat_ws(".", "parent", "slot"))
        return _asked(grown.select("question", "slot", F.concat("prompt", F.lit("\nThought:\n"), "said").alias("prompt")), method, r)
    if method.fan_out:
        held = before.withColumn("claims", jsons.claims(F.col("content"))).filter(F.size("claims") > 0)
        block = F.concat(F.lit("["), "slot", F.lit("]"), F.array_join(F.transform("claims", lambda c: F.concat(F.lit("\n- "), c)), ""))
    else:
        held, block = before, F.concat(F.lit("["), "slot", F.lit("]: "), F.substring("content", 1, width))
    # a question has a bounded number of slots
    peers = held.groupBy("question").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("peers"))
    rows = base.join(peers, "question", "left").select("question", F.concat_ws("\n", "prompt", F.coalesce("peers", F.lit("(nothing found)"))).alias("prompt"))
    return _asked(_fan(rows, ["a0"] if method.fan_out else [f"a{i}" for i in range(method.samples)]), method, r)


def run(questions: DataFrame, method: Method, call: Call, hypotheses: Sequence[str]) -> DataFrame:
    """question, predicted_class, n_requests: all rounds, then the choice of the last one (of several, by plurality)."""
    asked, answers, sent = None, None, None
    for r in range(method.rounds):
        asked = written(first(questions, method) if asked is None else following(questions, method, r, asked, answers), "asked")
        answers = written(call(asked).select("request_id", "content"), "answers")
        sent = asked.select("question") if sent is None else sent.unionByName(asked.select("question"))
    named = answers.select("request_id", jsons.pick(F.col("content"), F.array(*map(F.lit, hypotheses))).alias("pick"))  # before the join, which then moves no texts
    picks = asked.filter("slot <> 'critique'").join(named, "request_id", "left")
    if method.combine == "plurality":
        chosen = plurality(picks, ["question"], "pick", hypotheses).select("question", F.col("choice").alias("predicted_class"))
    else:
        chosen = keep_first(picks.filter(F.col("pick").isNotNull()), ["question"], [F.col("slot")]).select("question", F.col("pick").alias("predicted_class"))
    total = sent.groupBy("question").agg(F.count("*").alias("n_requests"))
    return questions.select("question").join(chosen, "question", "left").join(total, "question", "left")


def as_query(questions: DataFrame, articles: DataFrame, ids: str) -> DataFrame:
    """Questions in the shape that the evidence method takes: their articles as an array of id, date and text in the order of their ids."""
    rows = questions.select("question", F.posexplode(ids).alias("pos", "id")).join(articles, "id")
    evidence = rows.groupBy("question").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id", "date", "text"))), lambda e: F.struct(e["id"], e["date"], e["text"])).alias("evidence"))
    return questions.join(evidence, "question", "left")


def answered(request_id: Column, prompt: Column, hypotheses: Sequence[str]) -> Column:
    """A stand-in for a model, the same each time: one of the hypotheses by a hash of what was asked, as JSON."""
    place = F.conv(F.substring(F.md5(F.concat_ws("\n", request_id, prompt).cast("binary")), 1, 6), 16, 10).cast("int") % len(hypotheses)
    return F.concat(F.lit('{"prediction": "'), F.element_at(F.array(*map(F.lit, hypotheses)), place + 1), F.lit('"}'))
