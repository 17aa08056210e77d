"""Contamination, personal data, toxicity, pages and the pipeline."""

import functools
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, pages, pii, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_contamination_against_brute_force(spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, "Short one"), (901, None), (902, "!!"), (903, "Short one")]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(5000, None), (5001, ""), (5002, "a SHORT,one b"), (5003, items[0][1].upper() + " é tail"), (5004, "shortone"), (5003, "other text")]
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    want = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    ids |= found
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (500_000, 6000):  # one automaton, and several passes
        got = decontam.digest(decontam.contamination(df, bench, limit_nodes=limit))
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    spans = decontam.contamination(df, bench).filter("doc_id = 5002").first()["spans"]
    assert [(s["start"], s["stop"]) for s in spans] == [(2, 11)]
    for limit in (500_000, 6000):
        kept = decontam.clean(df, bench, limit_nodes=limit)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if not w[5])
    parts = list(decontam.chunks(bench, key="item_id", text="text", window=13, limit_nodes=6000))
    assert len(parts) > 1 and all(sum(max(1, len(w) - 12) for _, w in p) * 26 <= 6000 for p in parts)
    cut = list(decontam.chunks(bench, key="item_id", text="text", window=13, limit_nodes=52))
    assert max(len(w) for p in cut for _, w in p) <= 14
    assert decontam.contamination(df.filter("false"), bench).count() == 0
    assert decontam.contamination(df, bench.filter("false")).agg(F.sum("n_hit")).first()[0] == 0


@pytest.fixture(scope="module")
def field():
    return pii.Field().fit(pii.examples())


def test_base_rules():
    rules = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def good(kind, s):
        n = len(re.sub(r"[^0-9]", "", s))
        return kind == 0 or (kind == 1 and all(int(p) <= 255 for p in s.split("."))) or (kind == 2 and 13 <= n <= 19 and pii.luhn(re.sub(r"[^0-9]", "", s))) or (kind == 3 and 9 <= n <= 15)

    for text in ("a@b.c@d.ef x@y z@@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 +12 +1-2-3 +123456789012345678", "@ a@ @b.c a.@b-.c-", "é1.2.3.4ü x4111111111111111y"):
        want = [(k, *m.span()) for k, r in enumerate(rules) for m in re.finditer(r, text) if good(k, m[0])]
        assert pii.base(text) == want


def test_field(spark, field):
    held = pii.examples(200, seed=77)
    hit = sum(len(set(field.best(t, pii.tokens(t, 0, len(t)))) & set(s)) for t, s in held)
    said, true = sum(len(field.best(t, pii.tokens(t, 0, len(t)))) for t, s in held), sum(len(s) for _, s in held)
    assert hit >= 0.95 * true and hit >= 0.95 * said
    text = "Write to jo [at] mail [dot] com or call (555) 123-4567. Version 2.0, ISBN 978-0-1234-5678-9."
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find(text, field)[1]] == [("email", "jo [at] mail [dot] com"), ("phone", "(555) 123-4567")]
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", None), (3, "me@x.org", "z")], "doc_id long, text string, base string")
    rows = sorted(tuple(r) for r in pii.digest(pii.entities(df, field)).select("doc_id", "n_email", "spans").collect())
    assert rows == [(1, 0, "email:9:31,phone:40:54"), (2, 0, ""), (3, 0, ""), (3, 1, "email:0:8")]
    assert pii.redacted(df, field).filter("doc_id = 3 and base = 'z'").first()["text"] == "<email>"


def test_stretches_equal_the_whole_text(field):
    """What find() decodes around seeds is what the whole gaps between base spans give."""
    rng = np.random.default_rng(9)
    parts = [t for t, _ in pii.examples(60, seed=5)] + ["lorem ipsum dolor " * 20, "\n", "mail " + "x" * 30 + "_" + "y" * 70 + " (at) host (dot) org", "at 12 dot 7 ", "+1 1.1.1.1 555-123-4567 x", "a_b-1é9 "]
    for _ in range(60):
        text = " ".join(parts[i] for i in rng.integers(0, len(parts), 12))
        sure, more = pii.find(text, field)
        want = [x for a, b in pii.gaps([(a, b) for _, a, b in sure], len(text)) for x in field.best(text, pii.tokens(text, a, b), pii.seeds_of(text, a, b))]
        assert more == want
        assert all(b <= x or y <= a for _, a, b in sure for _, x, y in more)
    assert pii.find("mail " + "x" * 30 + "_" + "y" * 70 + " (at) host (dot) org", field)[1]
    assert pii.find("+1 1.1.1.1 555-123-4567 x", field) == ([(1, 3, 10), (3, 0, 23)], [])


def test_best_against_all_segmentations(field):
    """The dynamic program against an enumeration of every way to choose segments and kinds."""
    for text in ("call (555) 123-4567 or 12 34 56 78 90", "jo @ mail . com x 10.0.0.1", "card 4111 1111 1111 1111 no"):
        toks = pii.tokens(text, 0, len(text))
        scored = [(i, j, field.w[f].sum(axis=0)) for i, j, f in field.lattice(text, toks, False)]

        @functools.cache
        def most(at, scored=tuple((i, j, float(w.max())) for i, j, w in scored)):
            best = 0.0
            for i, j, w in scored:
                if i >= at:
                    best = max(best, w + most(j + 1))
            return best

        chosen = {(a, b): k for k, a, b in field.best(text, toks)}
        total = sum(float(w[chosen[toks[i][1], toks[j][2]]]) for i, j, w in scored if (toks[i][1], toks[j][2]) in chosen)
        assert total == pytest.approx(most(0))


def test_toxicity(spark):
    clean = ["the river runs over stone", "a garden of green leaves", "rain on the harbour wall", "the class met at noon"]
    docs = [(i, f"{clean[i % 4]} number{i} " + ("you id1оt truly" if i % 5 == 0 else "you friend truly")) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "ID10T! go"), (1000, "again")]
    df = spark.createDataFrame([(*d, "t") for d in docs], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(1000, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    rows = {r["doc_id"]: r for r in toxicity.judged(toxicity.score(df, model)).filter("doc_id <> 1000").collect()}
    assert all(rows[i]["predicted"] == (i % 5 == 0) and rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    assert rows[1002]["predicted"] == 1 and rows[1001]["predicted"] == 0
    assert toxicity.clean(df, model).columns == df.columns
    assert toxicity.fit(df, labels.filter("toxic = 0")).score((0.0, 0.0)) == 0.0
    excused = toxicity.Model(model.weights, (" go idiot ",), model.logistic)
    assert excused.hits(" go idiot now idiot ", excused.automaton())[0][0] == 13


HTML = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><div class="top-links"><a>Home</a></div>
<article><header><h1>A &amp; B</h1></header><p><b>one<br><p>two&nbsp; three</p><aside>side</aside><div class="comments"><p>hate it</p></div><ul><li>x<li>y</ul><form>f</form><p>open</article>
<div id="cookie-banner">We use</div><footer>&copy;</footer>"""


def test_pages(spark):
    rows = [(1, "http://a.org/1", HTML), (2, None, None), (3, "::", ""), (3, "http://a.org/3", "plain <i>text")]
    rows += [(10 + i, f"https://u@B.org:80/{i}", f"<body><div><p>Site menu</p><p>Follow us</p></div><p>Story {i} is new.</p><!-- c") for i in range(12)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    for limit in (1000, 0):  # templates broadcast, and joined
        got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in pages.digest(pages.extract(df, limit=limit)).collect())
        want = [(1, "A & B\none\ntwo three\nx\ny\nopen", 30), (2, "", 0), (3, "", 0), (3, "plain text", 10)] + [(10 + i, f"Story {i} is new.", len(f"Story {i} is new.")) for i in range(12)]
        want[0] = (1, want[0][1], len(want[0][1]))
        assert got == sorted(want)
    assert pages.extract(df.filter("false")).count() == 0


def test_copies_of_an_article_are_no_template(spark):
    df = spark.createDataFrame([(i, "http://a/x", "<nav>n</nav><article><p>The same story.</p></article>") for i in range(30)], "page_id long, url string, html string")
    assert {r["text"] for r in pages.extract(df).collect()} == {"The same story."}
    bare = df.withColumn("html", F.lit("<div>n</div><p>The same story.</p>"))
    assert {r["text"] for r in pages.extract(bare).collect()} == {"n\nThe same story."}
