"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark texts.

Every run of `window` consecutive words of an item is a pattern of the automaton (an item with fewer words is
one pattern), with two letters for each word. A document is normalised once, the automaton scans it once, and matches are kept as
word positions, which map to offsets of the original text. The automaton's size is checked first: up to
`limit_nodes` the benchmark is one automaton; a larger one is dealt in parts of that many nodes, each broadcast and scanned in
a pass of its own over the texts. A pass writes its hits beside the texts for the next, so no worker holds two automata.

Defined results: null and empty texts have no words and no hits; an item without words is never hit; repeated
items each count by their own id, a null id as the empty string; an empty benchmark hits nothing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import batches, narrow, pieces, scratch, texts, trimmed, written

#: ASCII other than letters and digits parts words; A-Z are lower-cased; all else belongs to words.
TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE)


#: Characters of a word: a node has few children then, and finding one of them takes time by their number.
DIGITS = 2
OTHER = "\0" * DIGITS  # a word of no item; no pattern begins or goes on with it


def _letters(number: int) -> str:
    """The characters of a word's number; the first can't be taken for the second, so patterns only meet whole words."""
    return chr(0x100 + (number >> 8)) + chr(number & 0xFF)


class Machine:
    """Patterns are the letters of their words, one after another; a pattern's value: its words and items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.letters: dict[bytes, str] = {}
        found: dict[str, set] = {}
        for item, words in items:
            line = "".join([self.letters.setdefault(w, _letters(len(self.letters))) for w in words])
            for i in range(0, max(1, len(line) - DIGITS * window + 1) if line else 0, DIGITS):
                found.setdefault(line[i : i + DIGITS * window], set()).add(item)
        self.automaton = None
        if found:
            self.automaton = ahocorasick.Automaton()
            for pattern, ids in found.items():
                self.automaton.add_word(pattern, (len(pattern) // DIGITS, sorted(ids)))
            self.automaton.make_automaton()

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs of words (first, past the last), merged, and the items."""
        if not self.automaton:
            return [], set()
        runs, ids = [], set()
        for end, (n, items) in self.automaton.iter("".join(map(self.letters.get, words, repeat(OTHER)))):
            last = end // DIGITS
            runs.append((last + 1 - n, last + 1))
            ids.update(items)
        return merged(runs), ids


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching runs as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def row(doc_id: int | None, text: str | None, runs: list[tuple[int, int]], items: set[str]) -> dict:
    """Counts, items as sorted strings, and the runs as code points of the original text."""
    norm = normalised(text)
    spans = []
    if runs:
        inside = np.concatenate([[0], (np.frombuffer(norm, np.uint8) != 32).astype(np.int8), [0]])
        turn = np.diff(inside)
        begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        points = np.concatenate([[0], np.cumsum((np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)])
        spans = [{"start": int(points[begin[a]]), "stop": int(points[end[b - 1]])} for a, b in runs]
    return {"doc_id": doc_id, "n_words": len(norm.split()), "n_hit": sum(b - a for a, b in runs), "items": sorted(items), "spans": spans}


def chunks(benchmark: DataFrame, *, key: str, text: str, window: int, limit_nodes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's words by item, in parts whose automata have at most limit_nodes nodes; a longer item is cut between its windows."""
    part, free, most = [], limit_nodes // (DIGITS * window), limit_nodes // (DIGITS * window)  # in windows
    for r in benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("string").alias("t")).toLocalIterator():
        words, at = normalised(r["t"]).split(), 0
        n = max(1, len(words) - window + 1) if words else 0
        while at < n:
            if not free:
                yield part
                part, free = [], most
            to = min(n, at + free)
            part.append((r["k"], words[at : to + window - 1]))
            free -= to - at
            at = to
    yield part


def _passes(docs: DataFrame, benchmark: DataFrame, finish, schema, *, window: int, key: str, text: str, limit_nodes: int) -> DataFrame:
    """finish(batch, runs, items) for all documents, with the hits of all parts; one pass for each part."""
    if limit_nodes < DIGITS * window:
        raise ValueError("an automaton must have room for a window")
    narrow(docs.sparkSession)
    sc, columns, at = docs.sparkSession.sparkContext, docs.columns, docs.columns.index("text")
    fields = [f"hits_{k}" for k in range(len(columns) + 2) if f"hits_{k}" not in columns][:2]
    between = StructType([*docs.schema.fields, StructField(fields[0], ArrayType(ArrayType(LongType()))), StructField(fields[1], ArrayType(StringType()))])

    def scan(items, first: bool, last: bool):
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = Machine(items.value, window)
            for whole in stream:
                for b in pieces(whole, "text"):
                    found = [machine.matches(normalised(t).split()) for t in b.column(at).to_pylist()]
                    runs, ids = [r for r, _ in found], [i for _, i in found]
                    if not first:
                        before = zip(b.column(fields[0]).to_pylist(), b.column(fields[1]).to_pylist(), strict=True)
                        runs, ids = zip(*((merged([*map(tuple, r0), *r]), {*i0, *i}) for (r0, i0), r, i in zip(before, runs, ids, strict=True)), strict=True)
                        b = b.select(columns)
                    if last:
                        yield from finish(b, runs, ids)
                    else:
                        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[list(x) for x in r] for r in runs], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(i) for i in ids], pa.list_(pa.string()))], [*columns, *fields])

        return trimmed(run)

    parts = chunks(benchmark, key=key, text=text, window=window, limit_nodes=limit_nodes)
    part, k = next(parts), 0
    with scratch() as keep:
        while (further := next(parts, None)) is not None:
            held = sc.broadcast(part)
            docs = written(docs.mapInArrow(scan(held, not k, False), between), "pass")
            held.unpersist()
            part, k = further, k + 1
        if k:
            keep(docs)
    return docs.mapInArrow(scan(sc.broadcast(part), not k, True), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, key: str = "item_id", text: str = "text", limit_nodes: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), spans (code points of the original)."""

    def finish(b: pa.RecordBatch, runs, items) -> Iterator[pa.RecordBatch]:
        rows = zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), runs, items, strict=True)
        yield from batches([row(*r) for r in rows], ARROW)

    return _passes(texts(docs), benchmark, finish, SCHEMA, window=window, key=key, text=text, limit_nodes=limit_nodes)


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: int = 20, key: str = "item_id", text: str = "text", limit_nodes: int = 500_000) -> DataFrame:
    """The documents, with all their columns, of which less than one word in `share` is hit."""
    at = docs.columns.index("text")

    def finish(b: pa.RecordBatch, runs, items) -> Iterator[pa.RecordBatch]:
        hit = [sum(y - x for x, y in r) for r in runs]
        yield b.filter(pa.array([not h or share * h < len(normalised(t).split()) for h, t in zip(hit, b.column(at).to_pylist(), strict=True)], pa.bool_()))

    return _passes(docs, benchmark, finish, docs.schema, window=window, key=key, text=text, limit_nodes=limit_nodes)


def digest(found: DataFrame) -> DataFrame:
    """The columns by which results are compared; contaminated: a twentieth of the words or more is hit."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
