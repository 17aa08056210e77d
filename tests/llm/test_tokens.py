"""Encoding, packing, token files and counts against the tokenizers library itself."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, token_counts, token_files, tokens

ODD = ["", "a  b", "x \n y", " lead", "trail ", "it's don't 'tis", "ß İ ǅ Σας", "á é", "日本語 テスト 123 4.5", "a\tb", "a\n\nb c", "a\x1cb \x85 c\xa0d", "x\r\ny", "a　b", "éa_b-c d1e2", "a!'s b", "A\nB's c\n\n", "ª º µ"]
DOCS = [(3, "one two three.", "x"), (1, None, "x"), (2, "", "y"), (2, "again the same id", "y"), (5, "word " * 3000, "z"), (4, "one two three.", "z"), (None, "no id", None)]
SCHEMA = "doc_id long, text string, start string"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(spark, sf, name):
    enc, whole = tokens.Encoder(P.path(name)), Tokenizer.from_file(P.path(name))
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for t in texts + texts:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids


def ids_of(name, text, end):
    return [*Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids, end]


def test_packing_places_every_id_once(spark):
    limits = packing.Limits(tokens=64, segments=4, loss=64, pool=8)
    rows = packing.pack(spark.createDataFrame(DOCS, SCHEMA), P.path("byte_bpe_50k.json"), limits=limits).collect()
    texts = {}
    for doc, text, _ in DOCS:
        texts.setdefault(doc, []).append(ids_of("byte_bpe_50k.json", text, 1))
    assert sum(r["length"] for r in rows) == sum(len(i) for x in texts.values() for i in x)
    by = {}
    for r in rows:
        assert any(zlib.crc32(np.array(i[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and len(i) == r["doc_tokens"] for i in texts[r["doc_id"]])
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64 and len(pieces) <= 4


def test_packing_respects_loss():
    packer = packing.Packer(packing.Limits(tokens=10, segments=3, loss=4, pool=4), 0)
    rows = []
    for d in range(6):
        rows += packer.add(d, np.arange(7), np.arange(7) >= 4)
    rows += packer.end()
    loss, n = {}, {}
    for r in rows:
        loss[r["sequence_id"]] = loss.get(r["sequence_id"], 0) + r["loss_tokens"]
        n[r["sequence_id"]] = n.get(r["sequence_id"], 0) + r["length"]
    assert max(loss.values()) <= 4 and max(n.values()) <= 10 and sum(n.values()) == 42


def test_token_files_round_trip(spark, tmp_path):
    manifest = token_files.write(spark.createDataFrame(DOCS, SCHEMA), P.path("word_bpe_49k.json"), f"file://{tmp_path}", sequence_length=16).cache()
    rows = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read(manifest).collect())
    order = sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[1] for r in rows] == [d[0] for d in order]
    at = 0
    for (start, doc, n, crc), _ in zip(rows, order, strict=True):
        assert start == at
        candidates = [ids_of("word_bpe_49k.json", t, 2) for d, t, _ in DOCS if d == doc]
        assert any(len(i) == n and zlib.crc32(np.array(i, "<u4").tobytes()) == crc for i in candidates)
        at += n
    first = manifest.orderBy("shard").first()
    ids, mask = token_files.sequence(first["path"], 0)
    assert len(ids) == len(mask) == 16
    assert token_files.read(token_files.write(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json"), f"file://{tmp_path}")).count() == 0


def test_counts(spark):
    sums = token_counts.suffix_sums(token_counts.histogram(spark.createDataFrame(DOCS, SCHEMA), P.path("byte_bpe_50k.json")))
    lengths = sorted(len(ids_of("byte_bpe_50k.json", t, 1)) - 1 for _, t, _ in DOCS)
    for r in sums.collect():
        n = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths) and r["all_tokens"] == sum(lengths)
    assert token_counts.truncated_total(sums, 5).first()[0] == sum(min(x, 5) for x in lengths)
    assert token_counts.quantile(sums, 0.5).first()[0] == lengths[3]
