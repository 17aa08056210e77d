"""Main text of web pages by removal of site templates.

A page is parsed leniently into a tree. All its subtrees are hashed twice: exactly (tags, classes and text), and by shape (the
path to them, tags and classes, without text, a row of like children as one). Both are counted for each host over
pages of different main content (article or main, where a page has one, else the whole page), so copies of an
article count once, and by shape also over all hosts.

Recurrence decides. A subtree goes where its exact form is on many of its host's pages. Beside an article or main its
shape alone will do, as menus, adverts and footers keep their shape while their words change: on many of the host's
pages or, where a host has it on too few to tell, on many pages of all hosts. Inside an article or main a subtree is a template only
where its exact form has text and stands in at least half of the host's different articles: near copies of
one article recur too, and paragraphs all have one shape.

What a page says of itself counts where recurrence can't: markup, forms, hidden parts and readers' comments always, and menus,
banners, adverts and notices (by tag, role or words of classes and ids) where too few pages have their shape, or inside
an article, or where a page has no article or main. Of what else stands beside an article in a shape of too few pages, only
what holds more text than the article is kept: such an article is a teaser.

The counts are summed before the shuffle and hold a row for each host and subtree; hosts and templates of any size are only
ever joined by keys that are salted by page.

Defined results: null and empty html give an empty text; a null or malformed url is the host ''; repeated page_ids
give a row each; an unclosed or truncated page is read as far as it goes; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, narrow, pieces, scratch, written

# Fixed values of HTML: elements without content, with raw content, and those that end a paragraph or part text into blocks.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# Elements and roles that aren't the article, and words of classes and ids that say so.
MARKUP = RAW | {"head", "form", "button", "select", "option", "datalist", "input", "svg", "canvas", "object", "audio", "video", "map", "math"}
READERS = {"comment", "comments", "disqus", "replies"}
DECLARED = {"nav", "aside", "footer", "dialog", "menu", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
SAYS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "disclaimer", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "paywall", "menu", "nav", "navbar", "navigation",
    "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "aside", "widget", "related", "recommended", "recommendations", "trending", "share", "sharing", "social",
    "footer", "header", "masthead", "comment", "comments", "disqus", "replies", "toolbar", "skip", "topbar", "copyright", "sitemap",
}
#: An open element of the first kind is closed by a start tag of its set.
IMPLIED = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
#: Nothing beyond these is closed by a stray end tag or an implied end.
WALLS = {"table", "td", "th", "article", "main", "section", "aside", "nav", "body", "html", "ul", "ol", "dl", "div", "blockquote", "form"}

TAG = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"[a-z]+|\d+")


class Element:
    __slots__ = ("tag", "says", "role", "hidden", "items", "code", "shape", "size")

    def __init__(self, tag: str, rest: str = ""):
        self.tag, self.says, self.role, self.hidden, self.items, self.code, self.shape, self.size = tag, frozenset(), "", False, [], None, None, 0
        if rest and not rest.isspace():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
            words = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower()
            self.says, self.role = frozenset(TOKEN.findall(words)), found.get("role", "").lower()
            self.hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()


def parse(source: str | None) -> Element:
    """A tree of elements and strings (character references decoded); anything unclosed ends with its parent."""
    root = Element("#root")
    stack, at, source = [root], 0, source or ""
    while m := TAG.search(source, at):
        if m.start() > at:
            stack[-1].items.append(entities.unescape(source[at : m.start()]))
        at = m.end()
        if not (name := m["name"]):
            continue
        name = name.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag in WALLS and name not in WALLS:
                    break
            continue
        if name == "plaintext":
            break
        while (closers := IMPLIED.get(stack[-1].tag)) and name in closers:
            stack.pop()
        if name in BLOCKS and name != "br":  # a paragraph also ends where inline elements in it are open
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        e = Element(name, m["rest"])
        stack[-1].items.append(e)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif name not in VOID and not m["rest"].endswith("/"):
            stack.append(e)
    if at < len(source):
        stack[-1].items.append(entities.unescape(source[at:]))
    return root


PLAIN = {"html", "body", "article", "main", "h1", "b", "i", "em", "strong"}


def _never(e: Element) -> bool:
    """Whether an element is no text of the page's author."""
    return e.tag in MARKUP or e.role == "form" or e.hidden or (e.tag not in PLAIN and bool(e.says & READERS))


def _says(e: Element, inside: bool) -> bool:
    """Whether an element is, by its own words, not part of the article; an article may have a header of its own."""
    if e.tag in DECLARED or e.role in ROLES or (e.tag == "header" and not inside):
        return True
    return e.tag not in PLAIN and bool(e.says & (SAYS - {"header"} if inside else SAYS))


def roots(page: Element) -> list[Element]:
    """The page's outermost articles, or else main; none where it has neither."""
    for name in ("article", "main"):
        found, stack = [], [page]
        while stack:
            e = stack.pop()
            if e.tag == name or e.role == name:
                found.append(e)
            else:
                stack += [x for x in reversed(e.items) if isinstance(x, Element) and not _never(x) and not _says(x, False)]
        if found:
            return found
    return []


def _hash(parts: list[str]) -> str:
    return hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _number(form: str) -> int:
    return int(form, 16) - (1 << 63)


#: The two lowest bits of a hash: which of these it is.
BESIDE, INSIDE, SHAPE = 0, 1, 2


def codes(page: Element) -> tuple[list[int], list[int]]:
    """Exact hashes and hashes of shapes of the subtrees; sets `code` and `shape` on each, and on the page the hash of its main content.

    What holds main content, or is it, is no template and has no hash; only what lies beside main content has a shape.
    """
    own, exact, shapes, main = {id(e) for e in roots(page)}, [], [], []
    done: dict[int, tuple[str, str, bool]] = {}  # exact form, shape, whether it holds main content
    stack: list[tuple[Element, bool, str, bool]] = [(page, False, "", False)]
    while stack:
        e, inside, path, closing = stack.pop()
        label = f"{e.tag}.{','.join(sorted(e.says))}"
        if not closing:
            stack.append((e, inside, path, True))
            stack += [(x, inside or id(x) in own, f"{path}/{label}", False) for x in reversed(e.items) if isinstance(x, Element)]
            continue
        form, shape, holds = [label], [label], False
        for x in e.items:
            if isinstance(x, str):
                form.append(SPACE.sub(" ", x).strip())
                e.size += len(form[-1])
                continue
            f, sh, h = done.pop(id(x))
            holds |= h or id(x) in own
            e.size += x.size
            form.append("" if id(x) in own else f)
            if shape[-1] != sh:
                shape.append(sh)
        done[id(e)] = form, shape, holds = _hash(form), _hash(shape), holds
        if id(e) in own:
            main.append(form)
        elif not holds and e.tag not in ("#root", "html", "body") and e.tag not in MARKUP and e.size:
            e.code = _number(form) & ~3 | (INSIDE if inside else BESIDE)
            exact.append(e.code)
            if own and not inside:
                e.shape = _number(_hash([path, shape])) & ~3 | SHAPE
                shapes.append(e.shape)
    page.code = _number(_hash(main)) if main else _number(done[id(page)][0])
    return exact, shapes


@dataclass(frozen=True)
class Templates:
    """Of one host: templates, exact and by shape; and shapes of which enough pages were seen to tell."""

    deleted: frozenset[int] = frozenset()
    known: frozenset[int] = frozenset()


def text_of(page: Element, templates: Templates = Templates()) -> str:
    """Blocks in page order, without templates and what isn't the article. Takes what codes() has set."""
    blocks: list[str] = []
    line: list[str] = []
    main = {id(e): e.size for e in roots(page)}

    def end() -> None:
        if block := SPACE.sub(" ", "".join(line)).strip():
            blocks.append(block)
        line.clear()

    def goes(x: Element, inside: bool) -> bool:
        if x is page or id(x) in main:
            return False
        if _never(x) or x.code in templates.deleted or x.shape in templates.deleted:
            return True
        if x.shape is None:
            return _says(x, inside)
        return x.shape not in templates.known and (_says(x, inside) or x.size <= sum(main.values()))

    stack: list = [(page, False)]
    while stack:
        x, inside = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif not goes(x, inside):
            if x.tag in BLOCKS:
                end()
                stack.append((None, inside))
            stack += [(y, inside or id(x) in main) for y in reversed(x.items)]
    end()
    return "\n".join(blocks)


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, *, least: int = 8, share: float = 0.02, inside: float = 0.5) -> DataFrame:
    """host, code, deleted: subtrees, exact or by shape, on at least `least` of the host's different pages; deleted where on a share of them, in articles the share `inside`.

    The host null stands for all hosts; its shapes are deleted where the host itself has them on fewer than `least` pages.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for b in pieces(whole, "html"):
                n: set[tuple] = set()
                for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                    page = parse(source)
                    exact, shapes = codes(page)
                    n.update((host, page.code, c) for c in {None, *exact, *shapes})
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*n), (pa.string(), pa.int64(), pa.int64()), strict=True)] if n else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())], ["host", "page", "code"])

    found = pages.select("host", "html").mapInArrow(run, "host string, page long, code long").distinct()
    kind = F.col("code").bitwiseAND(3)
    by_host = found.groupBy("host", "code").agg(F.count("*").alias("n")).filter(F.col("code").isNull() | (kind == SHAPE) | (F.col("n") >= least))
    by_host = written(by_host, "subtrees")
    total = by_host.filter("code is null").select("host", F.col("n").alias("pages"))
    often = by_host.filter("code is not null").join(total, "host")
    at = F.when(kind == INSIDE, inside).otherwise(share) * F.col("pages")
    own = often.filter(F.col("n") >= least).select("host", "code", (F.col("n") >= at).alias("deleted"))
    # a page belongs to one host, so the counts of hosts add up
    anywhere = often.filter(kind == SHAPE).groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select(F.lit(None).cast("string").alias("host"), "code", F.lit(True).alias("deleted"))
    return own.filter((F.col("code").bitwiseAND(3) == SHAPE) | F.col("deleted")).unionByName(anywhere)


def _judged(own: Iterable[tuple[int, bool]], anywhere: Iterable[int]) -> Templates:
    """From a host's codes with whether they are deleted, and shapes that are templates where the host can't tell."""
    own, anywhere = dict(own), frozenset(anywhere)
    return Templates(frozenset(c for c, d in own.items() if d) | (anywhere - own.keys()), anywhere | own.keys())


def extract(table: DataFrame, *, limit: int = 500_000) -> DataFrame:
    """page_id, url, text: the main text of every page. `limit`: templates up to which they are broadcast, after a count."""
    spark = table.sparkSession
    narrow(spark)
    pages = table.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", _host(F.col("url")))
    with scratch() as keep:
        found = keep(written(templates(pages), "templates"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    small = found.count() <= limit
    by_host: dict[str | None, list] = {}
    if small:
        for r in found.toLocalIterator():
            by_host.setdefault(r["host"], []).append((r["code"], r["deleted"]))
    sent = spark.sparkContext.broadcast(by_host)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anywhere, judged = frozenset(c for c, _ in sent.value.get(None, ())), {}

        def of(host: str) -> Templates:
            if host not in judged:
                if len(judged) > 1000:
                    judged.clear()
                judged[host] = _judged(sent.value.get(host, ()), anywhere)
            return judged[host]

        for whole in stream:
            for b in pieces(whole, "html"):
                rows = []
                for r in b.to_pylist():
                    page = parse(r["html"])
                    codes(page)
                    mine = r.get("codes") or ()
                    known = of(r["host"]) if small else _judged([(x["code"], x["deleted"]) for x in mine if x["own"]], [x["code"] for x in mine if not x["own"]])
                    rows.append({"page_id": r["page_id"], "url": r["url"], "text": text_of(page, known)})
                yield from batches(rows, schema)

    if not small:
        pages = pages.withColumn("row", F.xxhash64("page_id", "url", "html"))

        def subtrees(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in stream:
                for host, row, source in zip(b.column("host").to_pylist(), b.column("row").to_pylist(), b.column("html").to_pylist(), strict=True):
                    exact, shapes = codes(parse(source))
                    own = list({*exact, *shapes})
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(own), pa.string()), pa.array(own, pa.int64()), pa.array([row] * len(own), pa.int64())], ["host", "code", "row"])

        salts = F.explode(F.sequence(F.lit(0), F.lit(63)))  # each template meets a hot host's pages in 64 tasks
        own = pages.select("host", "row", "html").mapInArrow(subtrees, "host string, code long, row long").withColumn("salt", F.pmod("row", F.lit(64)).cast("int"))
        salted = found.withColumn("salt", salts)
        hit = own.join(salted.filter("host is not null"), ["host", "code", "salt"]).select("row", "code", "deleted", F.lit(True).alias("own"))
        hit = hit.unionByName(own.join(salted.filter("host is null").drop("host"), ["code", "salt"]).select("row", "code", "deleted", F.lit(False).alias("own")))
        pages = pages.join(hit.groupBy("row").agg(F.collect_set(F.struct("code", "deleted", "own")).alias("codes")), "row", "left").drop("row")
    return pages.mapInArrow(run, "page_id long, url string, text string")


def digest(texts: DataFrame) -> DataFrame:
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
