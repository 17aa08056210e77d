"""Substring dedup, n-gram joins and vectors against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import forest, jaccard, queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fixture(spark, sf):
    """Documents with planted cases: null, empty, short, copies, near copies, a hot passage, repeated ids, odd columns."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    passage = " ".join(f"p{i}" for i in range(40))
    base = [f"w{i % 97}x{i}" for i in range(120)]
    docs += [(1001, None), (1002, ""), (1003, "a b"), (1004, "A b"), (1005, " \t\n")]
    docs += [(2000 + i, f"{passage} " + " ".join(f"u{i}v{j}" for j in range(8))) for i in range(60)]
    docs += [(3000 + i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(40)]
    docs += [(4000, " ".join(base)), (4001, " ".join(base).upper()), (4002, " ".join(base))]
    return docs, spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, tokens string, n int")


@pytest.mark.parametrize("hot", [64, 3])
def test_substrings(spark, sf, hot):
    docs, df = fixture(spark, sf)
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    want = {}
    for d, w in words:
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digest(substrings.dedup(df, hot=hot)).collect()}
    assert got == want
    assert substrings.dedup(df.filter("false")).count() == 0


def test_automaton_against_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        refs = [[bytes([97 + x]) for x in rng.integers(0, 3, rng.integers(0, 25))] for _ in range(4)]
        text = [bytes([97 + x]) for x in rng.integers(0, 3, 30)]
        m = substrings.SuffixAutomaton()
        for doc, words in enumerate(refs):
            m.add(words, doc)
        m.close(4)
        for doc in range(5):
            hit = {j for i in range(len(text) - 3) for k, r in enumerate(refs) if k < doc and any(r[a : a + 4] == text[i : i + 4] for a in range(len(r) - 3)) for j in range(i, i + 4)}
            assert {j for a, b in m.spans(text, doc, 4) for j in range(a, b)} == hit


def brute_classes(docs):
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    for d in sets:
        for e, n in Counter(e for s in sets[d] for e in holders[s] if e > d).items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_ngram_classes(spark, sf):
    docs, df = fixture(spark, sf)
    member, _ = jaccard.join(df)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in member.collect()} == brute_classes(docs)
    kept = jaccard.keep_one(df.union(df.filter("doc_id = 3005")))
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in brute_classes(docs).items() if c == d)
    assert jaccard.join(df.filter("false"))[0].count() == 0


@pytest.mark.parametrize("hot", [256, 8])
def test_near_copies_without_their_source(spark, hot):
    """Copies that differ from each other by more than a quarter are linked through some only; tests of pairs stay linear in copies."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(90)]
    docs = []
    for d in range(400):
        w = list(base)
        for i in rng.choice(90, rng.integers(0, 5), replace=False):
            w[i] = f"d{d}i{i}"
        docs.append((d, " ".join(w)))
    member, tested = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), jaccard.Similarity(hot=hot))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in member.collect()} == brute_classes(docs)
    assert tested.count() <= 8 * len(docs)


def test_open_shingles_are_one_row_a_document(spark, monkeypatch):
    """How many shingles of a document are in large groups is summed in packed form, whatever the number of buckets that counted."""
    made = {}

    def counted(real):
        def run(found, kind, *rest):
            out = real(found, kind, *rest)
            made[kind] = out.count()
            return out

        return run

    for name in {"_spread", "_summed"} & set(vars(jaccard)):
        monkeypatch.setattr(jaccard, name, counted(getattr(jaccard, name)))
    docs = [(d, " ".join(f"d{d}" if i == d % 90 else f"c{i}" for i in range(90))) for d in range(150)]
    member, _ = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in member.collect()} == brute_classes(docs)
    assert 0 < made[jaccard.OPEN] <= len(docs)


def test_long_texts_and_ties_of_similarity(spark):
    """Texts of 20,000 words, and pairs at a similarity of exactly three quarters and just below."""
    long = [f"l{i % 9973}z{i}" for i in range(20_000)]
    docs = [(1, " ".join(long)), (2, " ".join(long[:17_000])), (3, " ".join(long[:14_000])), (4, None)]
    docs += [(10, " ".join(f"t{i}" for i in range(104))), (11, " ".join(f"t{i}" for i in range(79))), (12, " ".join(f"t{i}" for i in range(26, 104)))]
    member, _ = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in member.collect()}
    assert got == brute_classes(docs)
    assert got[11][1] == 10 and got[12][1] == 12 and got[2][1] == 1


@pytest.mark.parametrize("block", [2000, 60])
def test_vectors(spark, block):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 32)).astype("f4")
    x[300:420] = x[:1] + 0.05 * rng.standard_normal((120, 32))
    x[420:440] = x[5]
    rows = [(i, [float(v) for v in x[i]], int(i % 2) if i < 300 else 0) for i in range(700)]
    rows += [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 0), (903, [None] * 32, 0), (904, rows[0][1], None), (905, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, weight string")
    got = {r["vec_id"]: r for r in forest.near_duplicates(df, forest.Forest(leaf=64, block=block)).collect()}
    label = np.array([r[2] for r in rows[:700]])
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    links = np.array([got[i]["n_links"] for i in range(700)])
    assert (links <= hit.sum(axis=1)).all() and links.sum() >= 0.98 * hit.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))
    assert got[310]["component_id"] == 0 and not got[310]["kept"] and got[430]["n_links"] >= 19
    assert forest.near_duplicates(df.filter("false")).count() == 0


def test_queries_are_registered(spark, sf):
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert names["op7_embedding_near_dedup"](spark, sf).agg(F.count("*")).first()[0] == spark.read.parquet(f"{sf}/embeddings.parquet").count()
