"""Different runs of words with one bucket and token."""

import numpy as np

from tessera.llm import hashing, substrings


def test_a_run_is_removed_where_an_earlier_one_has_its_token(spark):
    r, s = ([str(k) for k in range(a, a + 13)] for a in (833149, 1881596))
    keys = []
    for w in (r, s):
        raw = [x.encode() for x in w]
        keys.append((int(hashing.mix(hashing.runs(raw, 5).min(keepdims=True))[0] >> np.uint64(32)) % 16, int(hashing.runs(raw, 13)[0]) & 0xFFFFFFFF))
    assert keys[0] == keys[1]  # with the 16 buckets of 4 partitions
    docs = [(2, " ".join(["a", *s, "b"])), (5, " ".join(["c", *r, "d"])), (9, " ".join(["e", *r, "f"]))]
    got = {x["doc_id"]: (x["n_removed"], x["kept"]) for x in substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {2: (0, docs[0][1]), 5: (0, docs[1][1]), 9: (13, "e f")}
