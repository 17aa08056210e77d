"""The pipeline against its stages worked out row by row."""

import zlib

import numpy as np
import pytest
from test_duplicates import brute_classes
from test_text_filters import LOWER, WORD
from tokenizers import Tokenizer

from tessera.llm import common, pii, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The small tables with rows that are null, empty, repeated, very long or of clashing names."""
    out = tmp_path_factory.mktemp("tables")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    docs += [(9001, None), (9002, ""), (9003, " ".join(f"l{i}" for i in range(20_000))), (9004, item), (9005, "mail jo [at] host [dot] org or +1 (555) 123-4567"), (9005, "mail jo [at] host [dot] org or +1 (555) 123-4567")]
    docs += [(9006, f"{item} " + " ".join(f"x{i}" for i in range(50))), (None, "a text of no id")]
    spark.createDataFrame([(d, t, None, i % 3) for i, (d, t) in enumerate(docs)], "doc_id long, text string, component_id string, hits_0 int").write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    spark.read.parquet(f"{out}/documents.parquet").filter("false").write.parquet(f"{out}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{out}/{name}.parquet").write.parquet(f"{out}/none/{name}.parquet")
    return str(out), docs


def test_run_against_row_by_row(spark, folder):
    out, docs = folder
    table = common.table(spark, out, "documents")
    model = toxicity.fit(table, common.table(spark, out, "labels"))
    machine = model.automaton()
    left = [(d, t) for d, t in docs if model.score(model.features(toxicity.folded(t), machine)) < 0.3]
    assert 0 < len(left) < len(docs)
    classes = brute_classes([(-1 if d is None else d, t) for d, t in left])
    one = {}
    for d, t in left:
        if classes[-1 if d is None else d][1] == (-1 if d is None else d):
            one.setdefault(d, t)
    windows = {tuple(w[i : i + 13]) for r in common.table(spark, out, "benchmark").collect() if (w := WORD.findall((r["text"] or "").translate(LOWER))) for i in range(max(1, len(w) - 12))}
    clean = {}
    for d, t in one.items():
        w = WORD.findall((t or "").translate(LOWER))
        hit = {j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            clean[d] = t
    assert 9004 in one and 9004 not in clean and len(clean) < len(one)
    tokenizer, want = Tokenizer.from_file(common.vocabulary("byte_bpe_50k.json")), {}
    for d, t in clean.items():
        spans = sorted((a, b, k) for x in pii.find(t, pii.trained()) for k, a, b in x)
        end, parts = 0, []
        for a, b, k in spans:
            if a >= end:
                parts += [(t or "")[end:a], f"<{pii.KINDS[k]}>"]
            end = max(end, b)
        want[d] = [*tokenizer.encode("".join([*parts, (t or "")[end:]]), add_special_tokens=False).ids, 1]
    placed, sequences = {}, {}
    for r in corpus_pipeline.run(spark, out).collect():
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        placed.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert placed.keys() == want.keys()
    for parts, size in [(x, len(want[d])) for d, x in placed.items()] + [(x, None) for x in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == size if size else at <= 2048


def test_stages_keep_columns_and_bear_an_empty_table(spark, folder):
    out, _ = folder
    docs = common.table(spark, out, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, out).schema == docs.schema, name
    assert corpus_pipeline.run(spark, f"{out}/none").count() == 0
    assert len(corpus_pipeline.STAGES) == 5
