"""Recurrence inside main content."""

from collections import Counter

from tessera.llm import pages


def page(i, text, more=""):
    return (i, f"http://a.org/{i}", f"<nav>n</nav><article><h1>Story {i}</h1><p>{text}<br>end {i}</p>{more}</article>")


def test_boilerplate_in_articles_goes_and_near_copies_stay(spark):
    promise = '<div class="x1"><p>We follow our own rules.</p></div>'
    rows = [page(i, f"News {i}.", promise) for i in range(20)] + [page(100 + i, f"One story, copy {i}.", promise + "<p>A shared line.</p>") for i in range(9)]
    rows += [(200 + i, "http://b.org/x", f"<div>top {i}</div><main><p>The same story.</p></main>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Story {i}\nNews {i}.\nend {i}" for i in range(20)} | {100 + i: f"Story {100 + i}\nOne story, copy {i}.\nend {100 + i}\nA shared line." for i in range(9)}
    want |= {200 + i: "The same story." for i in range(30)}
    for limit in (1000, 0):  # templates broadcast, and joined
        assert {r["page_id"]: r["text"] for r in pages.extract(df, limit=limit).collect()} == want


def test_shapes_decide_beside_articles(spark):
    """Menus, adverts and footers whose words differ on every page go by their shape, whatever they are called."""
    def beside(i, host):
        return (i, f"http://{host}/{i}", f'<div class="q"><ul>{"<li>m</li>" * (i % 3 + 1)}<li>menu {i}</li></ul></div><div class="z">buy {i}</div><article><p>Story {i} of {host}.</p><p>More {i}.</p></article><section>all rights {i}</section>')

    rows = [beside(i, "big.org") for i in range(30)] + [beside(100 + i, f"small{i}.org") for i in range(3)]
    rows.append((200, "http://lone.org/1", "<nav>n</nav><article>Teaser</article><section><p>The whole of a long story beside it.</p></section>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Story {i} of {h}.\nMore {i}." for i, h in [*((i, "big.org") for i in range(30)), *((100 + i, f"small{i}.org") for i in range(3))]}
    want[200] = "Teaser\nThe whole of a long story beside it."
    for limit in (1000, 0):
        assert {r["page_id"]: r["text"] for r in pages.extract(df, limit=limit).collect()} == want
    found = pages.templates(df.selectExpr("html", "split(url, '/')[2] as host"))
    counted = Counter()
    for _, url, html in rows:
        page = pages.parse(html)
        counted.update((url.split("/")[2], c) for c in set(pages.codes(page)[1]))
    shapes = {(r["host"], r["code"]) for r in found.filter("host is not null").collect() if r["code"] & 3 == pages.SHAPE}
    assert shapes == {k for k, n in counted.items() if n >= 8}


def test_templates_decide_on_the_tables(spark, sf):
    """Without the templates, what they delete on the tables is in the text."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    shapes = {c for r in rows for c in pages.codes(pages.parse(r["html"]))[1]}
    changed = 0
    for r in rows:
        page = pages.parse(r["html"])
        pages.codes(page)
        text = pages.text_of(page, pages.Templates(known=frozenset(shapes)))
        changed += text != got[r["page_id"]]
        assert got[r["page_id"]] in text
    assert changed >= 0.9 * len(rows)


def test_deep_pages_have_templates():
    deep = pages.parse("<div>" * 3000 + "x" + "</div>" * 3000)
    assert len(pages.codes(deep)[0]) == 3000
