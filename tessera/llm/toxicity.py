"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, strips accents, maps homoglyphs of other scripts to Latin letters and reads digits and
signs that stand for letters (with i, l and 1 as one class), so disguised spellings match. The lexicon
holds whole words and word beginnings with log-odds weights. It is learned from at most `max_rows` labelled
rows (the first by a hash of the id): terms that cover toxic rows and hardly any others, by greedy cover. Phrases in
which a term stands in clean rows alone become exceptions, beside those given; a match inside an exception
counts nothing. A row's score is a logistic function of its weight and its weight by length.

Everything but that fit covers all rows alike. Neither label, language, source nor id enters a score.
Defined results: null and empty texts score as texts without matches; unlabelled rows are scored as others;
repeated ids score each by its own text; without toxic training rows every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, narrow, pieces, scratch, texts, trimmed, written

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b",
    "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
# Digits and signs read as letters; i, l and 1 are one class.
SIGNS = {"0": "o", "1": "i", "l": "i", "|": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g"}


class Folding(dict):
    """A table for str.translate that works out each character once."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            for d in unicodedata.normalize("NFKD", c):
                d = HOMOGLYPHS.get(d, d)
                d = SIGNS.get(d, d)
                out += "" if unicodedata.combining(d) or unicodedata.category(d) == "Cf" else d if d.isalpha() else " "
        self[code] = out
        return out


_fold = Folding()


def folded(text: str | None) -> list[str]:
    """Words of folded letters."""
    return (text or "").translate(_fold).split()


def terms(words: list[str], shortest: int = 4, longest: int = 12) -> set[str]:
    """Whole words as ' word ', beginnings as ' begin'."""
    out = set()
    for w in set(words):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(shortest, min(len(w), longest) + 1))
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    #: bias, by weight, by weight for each word
    logistic: tuple[float, float, float] | None = None

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        out = ahocorasick.Automaton()
        for t, w in self.weights.items():
            out.add_word(t, (len(t), w))
        for e in self.exceptions:
            out.add_word(e, (len(e), None))
        out.make_automaton()
        return out

    def hits(self, line: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
        """Start of the word, end and weight; one for each word, the heaviest; none inside an exception."""
        found = list(machine.iter(line)) if machine is not None else []
        voids = [(stop - n + 1, stop) for stop, (n, w) in found if w is None]
        best: dict[int, tuple[int, float]] = {}
        for stop, (n, w) in found:
            at = stop - n + 1
            if w is not None and not any(a <= at and stop <= b for a, b in voids) and (at not in best or best[at][1] < w):
                best[at] = (stop, w)
        return [(a, b, w) for a, (b, w) in best.items()]

    def features(self, words: list[str], machine: ahocorasick.Automaton) -> tuple[float, float]:
        found = self.hits(f" {' '.join(words)} ", machine)
        weight = sum(w for _, _, w in found)
        return math.log1p(weight), math.log1p(100 * weight / max(1, len(words)))

    def score(self, x: tuple[float, float]) -> float:
        if self.logistic is None:
            return 0.0
        z = self.logistic[0] + self.logistic[1] * x[0] + self.logistic[2] * x[1]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def held_out(doc_id):
    """Rows that learning never sees: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", max_rows: int = 20_000, max_terms: int = 2_000, candidates: int = 20_000, exceptions: tuple[str, ...] = ()) -> Model:
    """Learn lexicon, exceptions and calibration from at most max_rows labelled rows outside the held-out part."""
    with scratch():
        return _fit(docs, labels, label, max_rows, max_terms, candidates, exceptions)


def _fit(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_terms: int, candidates: int, exceptions: tuple[str, ...]) -> Model:
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows pairs of numbers; copies of a text teach nothing twice
    found = texts(docs).join(F.broadcast(sample), "doc_id").filter(F.col("text").isNotNull()).select("doc_id", "y", "text", F.xxhash64("text").alias("h"))
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "toxic-found")
    first = found.groupBy("h", "y").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")  # no text is shuffled
    rows = written(found.join(F.broadcast(first), "row", "left_semi").select("y", "text"), "toxic-sample")

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()
        for whole in stream:
            for b in pieces(whole, "text", 1 << 20):
                for t in b.column(0).to_pylist():
                    n.update(terms(folded(t)))
                    if len(n) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], ["term", "n"])
                        n = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    n_pos, n_neg = (int(x or 0) for x in rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    least = max(2, math.ceil(0.004 * n_pos))
    found = rows.filter("y = 1").select("text").mapInArrow(trimmed(count), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(candidates).collect()
    pos = {r["term"]: r["n"] for r in found}
    if not pos:
        return Model({}, tuple(exceptions))
    order = sorted(pos)
    wanted = spark.sparkContext.broadcast({t: i for i, t in enumerate(order)})

    def present(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for b in pieces(whole, "text", 1 << 20):
                ids = [[i for x in terms(folded(t)) if (i := wanted.value.get(x)) is not None] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["y", "ids"])

    marked = written(rows.select("y", "text").mapInArrow(trimmed(present), "y int, ids array<int>"), "toxic-terms")
    neg = dict(marked.filter("y = 0").select(F.explode("ids").alias("i")).groupBy("i").count().collect())  # at most `candidates` rows
    odds = {i: math.log((pos[t] + 0.5) / (n_pos + 1)) - math.log((neg.get(i, 0) + 0.5) / (n_neg + 1)) for i, t in enumerate(order)}
    good = {i for i, w in odds.items() if w > 1.5 and neg.get(i, 0) <= 0.2 * pos[order[i]]}
    chosen = _cover([[i for i in r["ids"] if i in good] for r in marked.filter("y = 1").select("ids").collect()], order, odds, least, max_terms)
    model = Model({order[i]: odds[i] for i in chosen}, tuple(f" {' '.join(folded(e))} " for e in exceptions))
    return _calibrate(rows, model)


def _cover(rows: list[list[int]], order: list[str], odds: dict[int, float], least: int, most: int, depth: int = 3) -> list[int]:
    """Terms that cover the toxic rows `depth` times, widest first; of equals the longest."""
    need = np.full(len(rows), depth)
    where: dict[int, list[int]] = {}
    for k, ids in enumerate(rows):
        for i in ids:
            where.setdefault(i, []).append(k)
    places = {i: np.array(x) for i, x in where.items()}
    gain = {i: float(len(x)) for i, x in places.items()}
    chosen: list[int] = []
    while gain and len(chosen) < most:
        i = max(gain, key=lambda j: (gain[j], len(order[j]), odds[j], order[j]))
        now = float((need[places[i]] > 0).sum())
        if now < gain[i]:
            gain[i] = now
            continue
        if now < least:
            break
        chosen.append(i)
        for j in [j for j in gain if order[j].startswith(order[i].rstrip()) or order[i].startswith(order[j].rstrip())]:
            del gain[j]  # forms of one word cover a row once
        need[places[i]] -= 1
    return chosen


def _calibrate(rows: DataFrame, model: Model) -> Model:
    """Exceptions from the sample's clean rows, then the logistic fit on the sample."""

    def around(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for whole in stream:
            for b in pieces(whole, "text", 1 << 20):
                found: list[tuple[str, int]] = []
                for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    line, out = f" {' '.join(folded(t))} ", set()
                    for a, e, _ in model.hits(line, machine):
                        end = line.find(" ", max(e, a + 1))
                        if (left := line.rfind(" ", 0, a)) >= 0:
                            out.add(line[left : end + 1])
                        if (right := line.find(" ", end + 1)) > 0:
                            out.add(line[a : right + 1])
                    found += [(x, y) for x in sorted(out)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], ["phrase", "y"])

    clean = rows.select("y", "text").mapInArrow(trimmed(around), "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).filter("p = 0 and n >= 3").orderBy(F.desc("n"), "phrase").limit(1000)
    model = Model(model.weights, (*model.exceptions, *sorted(r["phrase"] for r in clean.collect())))

    def measure(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for whole in stream:
            for b in pieces(whole, "text", 1 << 20):
                x = [model.features(folded(t), machine) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array([c for _, c in x], pa.float64())], ["y", "a", "b"])

    seen = np.array([tuple(r) for r in rows.select("y", "text").mapInArrow(trimmed(measure), "y int, a double, b double").collect()])  # at most max_rows rows
    seen = seen[np.lexsort(seen.T)]
    x, y = np.column_stack([np.ones(len(seen)), seen[:, 1:]]), seen[:, 0]
    w, penalty = np.zeros(3), np.array([1e-3, 0.05, 0.05])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.weights, model.exceptions, (float(w[0]), float(w[1]), float(w[2])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, weight (of all matches), matches: one row for each document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_matches", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        machine = m.automaton()
        for whole in stream:
            for b in pieces(whole, "text"):
                rows = []
                for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = folded(t)
                    line = f" {' '.join(words)} "
                    n = len(m.hits(line, machine))
                    rows.append({"doc_id": doc_id, "score": m.score(m.features(words, machine) if n else (0.0, 0.0)), "n_matches": n})
                yield from batches(rows, schema)

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, score double, n_matches long")


def clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold."""
    narrow(docs.sparkSession)
    held, at, schema = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.schema

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        machine = m.automaton()
        for whole in stream:
            for b in pieces(whole, "text"):
                yield b.filter(pa.array([m.score(m.features(folded(t), machine)) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(trimmed(run), schema)


def judged(scores: DataFrame, threshold: float = 0.3) -> DataFrame:
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches")
