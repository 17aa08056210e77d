"""Addresses: identifiers, hosts, slugs, dates in paths, and domain predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sites whose pages are no articles, and words that news hosts have in their names.
SOCIAL = ("facebook.com", "instagram.com", "linkedin.com", "reddit.com", "t.co", "tiktok.com", "twitter.com", "x.com", "youtube.com")
NEWS_WORDS = ("bbc", "cnn", "herald", "news", "post", "press", "reuters", "times", "tribune")


def article_id(url: Column, prefix: str = "art_") -> Column:
    """Stable for a url: the prefix and 12 hex digits of its SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(url.cast("binary")), 1, 12))


def dated_id(url: Column, date: Column) -> Column:
    """10 hex digits of the MD5 of url and date."""
    return F.substring(F.md5(F.concat_ws("|", url, date).cast("binary")), 1, 10)


def authority(url: Column) -> Column:
    """What stands between the scheme's slashes and the path, with its port; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def hostname(url: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")


def host_or_word(url: Column) -> Column:
    """The host; '(no-host)' where there is none, '(parse-fail)' where a bracket of an address is not closed."""
    broken = F.contains(authority(url), F.lit("[")) != F.contains(authority(url), F.lit("]"))
    return F.when(broken, "(parse-fail)").when(F.coalesce(hostname(url), F.lit("")) == "", "(no-host)").otherwise(hostname(url))


def domain(url: Column) -> Column:
    """The authority with every 'www.' taken out, port kept."""
    return F.replace(authority(url), F.lit("www."), F.lit(""))


def site(url: Column) -> Column:
    """The host without one leading 'www.'."""
    return F.regexp_replace(hostname(url), r"^www\.", "")


def stripped_site(url: Column) -> Column:
    """The host without any leading w or dot: what stripping the characters of 'www.' leaves."""
    return F.regexp_replace(hostname(url), r"^[w.]+", "")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit(""))


def key(url: Column) -> Column:
    """Scheme, lower-case host and path without closing slashes; no query or fragment."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), F.when(authority(url) != "", F.concat(F.lit("//"), authority(url))).otherwise(F.lit("")), F.regexp_replace(path(url), r"/+$", ""))


def slug(url: Column) -> Column:
    """Path and query, decoded, with runs of -, _ and / as one space, in lower case."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.lower(F.regexp_replace(F.coalesce(F.try_url_decode(F.concat_ws(" ", path(url), query)), F.concat_ws(" ", path(url), query)), r"[-_/]+", " "))


def path_date(url: Column) -> Column:
    """yyyy-MM-dd from a path like /2026/3/1/; '' where there is none or month or day is out of range."""
    pattern = r"/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|\.|$)"
    y, m, d = (F.regexp_extract(url, pattern, k) for k in (1, 2, 3))
    good = (y != "") & F.coalesce(m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31), F.lit(False))
    return F.when(good, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(F.lit(""))


def parents(host: Column) -> Column:
    """The host and every parent domain except the last label: a.b.c gives [a.b.c, b.c]."""
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def in_domains(host: Column, domains: Iterable[str]) -> Column:
    """Whether the host is one of the domains or below one of them."""
    return F.arrays_overlap(parents(host), F.array(*map(F.lit, domains)))


def looks_like_news(url: Column, skip: Iterable[str] = SOCIAL, hints: Iterable[str] = NEWS_WORDS) -> Column:
    """Two path parts or more on a site that isn't skipped, and a news host or a long slug with two hyphens."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    news = F.lit(False)
    for h in hints:
        news = news | domain(url).contains(h)
    skipped = F.lit(False)
    for s in skip:
        skipped = skipped | domain(url).endswith(s)
    article = (F.length(last) > 20) & (F.length(last) - F.length(F.replace(last, F.lit("-"), F.lit(""))) >= 2)
    return (domain(url) != "") & ~skipped & (F.size(parts) >= 2) & (news | article)
