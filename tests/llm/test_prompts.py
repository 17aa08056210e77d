"""Packing of documents that begin with a prompt."""

from collections import Counter

from tessera.llm import common, packing


def test_prompts_bear_no_loss(spark):
    docs = [(i, "one two three four five six seven eight nine ten", 8 if i % 2 else None) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n int").coalesce(1)
    rows = packing.pack(df, common.vocabulary("byte_bpe_50k.json"), limits=packing.Limits(tokens=64, segments=8, loss=16, pool=8), prompt="n").collect()
    loss, bearing, placed, size = Counter(), Counter(), Counter(), {}
    for r in rows:
        loss[r["sequence_id"]] += r["loss_tokens"]
        bearing[r["doc_id"]] += r["loss_tokens"]
        placed[r["doc_id"]] += r["length"]
        size[r["doc_id"]] = r["doc_tokens"]
    assert max(loss.values()) <= 16 and placed == size
    assert all(bearing[i] == size[i] - (8 if i % 2 else 0) for i in size)
