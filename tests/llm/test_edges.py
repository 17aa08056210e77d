"""Empty tables, very long texts, repeated rows and ties for every operator."""

import numpy as np
import pytest

from tessera.llm import common, decontam, forest, hashing, packing, pages, pii, queries, substrings, token_counts, token_files, toxicity

LONG = [f"word{i % 7919}of{i}" for i in range(20_000)]
DOCS = "doc_id long, text string, score string"


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    model = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.weights == {} and model.logistic is None
    vocabulary = common.vocabulary("byte_bpe_50k.json")
    for out in (pii.entities(none), pii.redacted(none), toxicity.score(none, model), toxicity.clean(none, model), token_counts.histogram(none, vocabulary), packing.pack(none, vocabulary), substrings.dedup(none), token_files.read(token_files.write(none, vocabulary))):
        assert out.count() == 0
    sums = token_counts.suffix_sums(token_counts.histogram(none, vocabulary))
    assert token_counts.quantile(sums, 0.5).first()[0] is None


def test_long_texts(spark):
    shared = " ".join(f"s{i}" for i in range(30))
    text = " ".join([*LONG[:12_000], shared, "jo@mail.org", *LONG[12_000:]])
    docs = spark.createDataFrame([(1, f"x {shared} y", None), (2, text, None), (2, text, None), (3, None, None)], DOCS)
    kept = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.dedup(docs).collect())
    assert kept == [(1, 32, 0), (2, 20_031, 30), (2, 20_031, 30), (3, 0, 0)]
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.entities(docs)).collect()}
    at = text.index("jo@mail.org")
    assert spans == {1: "", 2: f"email:{at}:{at + 11}", 3: ""}
    bench = spark.createDataFrame([("b", shared), (None, "none of it")], "item_id string, text string")
    hit = sorted((r["doc_id"], r["n_hit"], r["contaminated"]) for r in decontam.digest(decontam.contamination(docs, bench)).collect())
    assert hit == [(1, 30, True), (2, 30, False), (2, 30, False), (3, 0, False)]
    model = toxicity.Model({" s7 ": 3.0}, (), (-2.0, 2.0, 0.0))
    scores = [r["score"] for r in toxicity.score(docs, model).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[1] == scores[2]
    page = f"<article><p>{' '.join(LONG)}</p></article>"
    got = pages.extract(spark.createDataFrame([(1, "http://a/1", page), (1, "http://a/1", page)], "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got] == [" ".join(LONG)] * 2


def test_a_null_item_is_the_empty_string(spark):
    docs = spark.createDataFrame([(1, "one two three", None)], DOCS)
    bench = spark.createDataFrame([(None, "two")], "item_id string, text string")
    assert decontam.contamination(docs, bench).first()["items"] == [""]


def test_repeated_vector_ids_and_ties(spark):
    near = [[1.0, 0.0, 0.01 * k] for k in range(4)]
    rows = [(1, near[0], 5), (1, near[1], 5), (2, near[2], 5), (3, near[3], 5), (9, [0.0, 1.0, 0.0], 5)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (9, 0, 9, True)]
    tie = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [3.0, 4.0], 0), (3, [-4.0, 3.0], 0)], "vec_id long, embedding array<float>, label int")
    links = {t: [r["n_links"] for r in forest.near_duplicates(tie, forest.Forest(threshold=t)).orderBy("vec_id").collect()] for t in (0.6, 0.6000001)}
    assert links == {0.6: [1, 1, 0], 0.6000001: [0, 0, 0]}


def test_recall_of_planted_pairs(spark):
    """Pairs with a cosine of 0.93 to 0.95 among vectors that are far from each other."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 800, 2):
        side = rng.standard_normal(64)
        side -= (side @ x[i]) * x[i]
        c = rng.uniform(0.931, 0.95)
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    rows = [(i, [float(v) for v in x[i].astype("f4")], 0) for i in range(len(x))]
    got = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).filter("n_links > 0").count()
    assert 0.95 * 800 <= got <= 800


def test_hashed_sets_equal_single_texts():
    texts = ["", None, "a b", "A  b\tc d e f", "x " * 40, " ".join(LONG[:300]), "é ü ß 日本"]
    tokens, at = hashing.sets(texts, 5, lower=True)
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert tokens[a:b].tolist() == np.unique(hashing.runs(hashing.words(t, lower=True), 5, short=True)).tolist()


def test_limits_must_leave_room():
    for wrong in ({"loss": 0}, {"segments": 0}, {"tokens": 0}):
        with pytest.raises(ValueError):
            packing.Limits(**wrong)


def test_queries_give_a_row_for_each_row(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, q in queries.queries().items():
        if name.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op8"):
            assert q(spark, sf).count() == n, name
