"""Queries over whole tables by brute force, beside their SQL."""

import datetime
import random
import re
from collections import Counter, defaultdict

import duckdb

from tessera.functions import texts
from tessera.plans import catalog


def rows(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def test_bigrams_of_all_languages(spark, sf):
    def grams(text):
        w = [x for x in re.findall(r"\b[a-z][a-z0-9\-]+\b", text.lower()) if len(x) > 2 and x not in texts.STOP]
        return {*zip(w, w[1:], strict=False)}

    items = [(r["item_id"], grams(r["text"])) for r in rows(spark, sf, "benchmark")]
    want, lang = {}, {r["doc_id"]: r["lang"] for r in rows(spark, sf, "documents")}
    for r in rows(spark, sf, "documents"):
        g = grams(r["text"])
        want |= {(r["doc_id"], i): n for i, b in items if (n := len(g & b)) >= 5}
    got = catalog.queries()["bigram_overlap_join"](spark, sf).collect()
    assert {(r["doc_id"], r["item_id"]): r["shared"] for r in got} == want and len(got) == len(want)
    assert {lang[d] for d, _ in want} - {"en"}


def test_signatures_of_all_documents_are_counted(spark, sf):
    want = Counter()
    for r in rows(spark, sf, "documents"):
        s = r["text"] or ""
        for old, new in ((r"fact\[\d+\]", "fact[N]"), (r"\b\d{4}-\d{2}-\d{2}\b", "<DATE>"), (r"\b[0-9a-f]{8,}\b", "<HASH>"), (r"\b\d+\b", "<N>")):
            s = re.sub(old, new, s)
        want[s[:160]] += 1
    got = catalog.queries()["error_signature"](spark, sf).collect()
    assert {r["signature"]: r["n"] for r in got} == want and sum(r["n"] for r in got) == 200


def test_different_texts_stay_apart(spark, sf):
    groups = defaultdict(list)
    for r in rows(spark, sf, "documents"):
        groups[r["text"]].append(r)
    want = {t: (len(g), ",".join(sorted({r["source"] for r in g}))) for t, g in groups.items()}
    got = catalog.queries()["dedup_merge_whole"](spark, sf).collect()
    assert {r["text"]: (r["n_records"], r["provenance"]) for r in got} == want
    assert len({r["id"] for r in got}) == len(got) == len(want)


def test_collisions_of_whole_texts(spark, sf):
    want = Counter(r["text"].strip(" ").lower() for r in rows(spark, sf, "documents"))
    got = catalog.queries()["text_collisions"](spark, sf).collect()
    assert {r["title"]: r["n"] for r in got} == {t: n for t, n in want.items() if n >= 2}


def test_every_order_gets_evidence(spark, sf):
    events = defaultdict(list)
    for r in rows(spark, sf, "events"):
        events[r["user_id"]].append((-r["ts"].timestamp(), r["event_id"], r["ts"].date()))
    want = set()
    for r in rows(spark, sf, "orders"):
        cutoff = datetime.date(2024, 1, 1) + datetime.timedelta(r["o_orderkey"] % 30)
        hit = sorted(e for e in events[r["o_custkey"] % 150] if 0 <= (cutoff - e[2]).days <= 7)
        want |= {(r["o_orderkey"], e[1], k) for k, e in enumerate(hit[:5], 1)}
    got = [tuple(r) for r in catalog.queries()["interval_topk_join"](spark, sf).collect()]
    assert set(got) == want and len(got) == len(want)


def test_mentions_of_null_keys_are_summed(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    events = [(1, None, "a", day, 60.0), (2, None, "a", day, 40.0), (3, 7, None, day, 120.0), (4, 7, "a", None, 130.0), (5, 7, "a", day, 99.0)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["daily_mentions_filter"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 100.0), (2, 100.0), (3, 120.0), (4, 130.0)]


def test_mentions_are_added_in_the_order_of_events(spark, tmp_path):
    """Keys of three to five rows that sum to 100.00 or, by their order, a little less; sums with five decimals, and a very large one."""
    draw, day, path = random.Random(3), datetime.datetime(2024, 1, 1), f"{tmp_path}/events.parquet"
    parts = []
    for user in range(4000):
        cuts = sorted(draw.randrange(10001) for _ in range(draw.randrange(2, 5)))
        parts += [(user, (b - a) / 100) for a, b in zip([0, *cuts], [*cuts, 10000], strict=True)]
    parts += [(-user, draw.randrange(10**6, 10**8) / 1e4 + 5e-5) for user in range(1, 2001)] + [(-3000, 1e305)]
    draw.shuffle(parts)
    want = defaultdict(float)
    for user, value in parts:
        want[user] += value
    assert 100 < sum(m < 100 for u, m in want.items() if u >= 0) < 1000
    events = spark.createDataFrame([(i, u, "a", day, v) for i, (u, v) in enumerate(parts)], "event_id long, user_id long, event_type string, ts timestamp_ntz, value double")
    events.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    got = sorted(map(tuple, catalog.queries()["daily_mentions_filter"](spark, str(tmp_path)).collect()))
    assert [e for e, _ in got] == [i for i, (u, _) in enumerate(parts) if want[u] >= 100]
    c = duckdb.connect(config={"threads": 1})  # more threads add in any order
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(c.execute(catalog.oracle_sql()["daily_mentions_filter"]).fetchall())
