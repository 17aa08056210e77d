"""Strings: n-grams, shingles, normal forms, quality checks, signatures and templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that n-grams leave out.
STOP = ("will", "the", "a", "of", "to", "in", "on", "for", "at", "by", "an", "from", "and", "or", "when", "with", "which", "be", "is", "are", "was", "were", "have", "has", "had", "that", "this")
# Corporate endings, in the order in which they are stripped.
ENDINGS = (
    " corporation", " incorporated", " inc.", " inc", " corp.", " corp", " company", " co.", " plc", " ltd.", " ltd", " holdings", " group", " international",
    " industries", " technologies", " solutions", " communications", " systems", ", inc", ",inc",
)
# Phrases of pages that are no article, with their tags.
BLOCKERS = (
    ("cloudflare", "cf_challenge"), ("please enable javascript", "js_required"), ("enable javascript to continue", "js_required"), ("access denied", "access_denied"),
    ("403 forbidden", "http_403"), ("404 not found", "http_404"), ("this page isn't available", "http_404"), ("page not found", "http_404"), ("verify you are human", "bot_check"),
    ("checking your browser", "cf_wait"), ("just a moment", "cf_wait"), ("subscribe to continue reading", "paywall"), ("you have reached your article", "paywall"),
    ("sign in to continue reading", "paywall"), ("subscribe now to read", "paywall"), ("this content is available to", "paywall"), ("your browser is unsupported", "browser_unsupported"),
)


def _runs(words: Column, n: int, glue: str) -> Column:
    """Distinct runs of n elements. Shifted copies are zipped, as a lambda that captured `words` would work it out for every run."""
    out = words
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), F.size(words)), lambda a, b: F.concat(a, F.lit(glue), b))
    return F.array_distinct(F.array_compact(out))


def ngrams(text: Column, n: int = 2, stop: tuple[str, ...] = STOP) -> Column:
    """Distinct n-grams of lower-case words of three letters or more that aren't stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b[a-z][a-z0-9\-]+\b"), F.lit(0))
    return _runs(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop)), n, " ")


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k characters of the lower-case text with white space collapsed."""
    s = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.array_distinct(F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def keywords(text: Column, stop: tuple[str, ...], limit: int = 5, proper: int = 4) -> Column:
    """Capitalised words first (up to `proper`), then others in lower case, each once, in order."""
    words = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b[A-Za-z][A-Za-z0-9\-]{2,}\b"), F.lit(0)), lambda w: ~F.lower(w).isin(*stop))
    names = F.array_distinct(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    common = F.array_distinct(F.filter(words, lambda w: ~w.rlike("^[A-Z]")))
    common = F.array_distinct(F.transform(common, F.lower))
    picks = F.concat(F.slice(names, 1, proper), F.slice(common, F.lit(1), F.lit(limit) - F.least(F.size(names), F.lit(proper))))
    return F.array_join(F.slice(picks, 1, limit), " ")


def company(name: Column) -> Column:
    """Lower case without corporate endings, closing punctuation and a leading article."""
    n = F.lower(name)
    for e in ENDINGS:
        n = F.regexp_replace(n, re.escape(e) + "$", "")
    n = F.trim(F.regexp_replace(F.trim(n), r"[,.]+$", ""))
    return F.trim(F.regexp_replace(n, r"^the ", ""))


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def statement(text: Column) -> Column:
    """Without quotes around it, white space collapsed, closed by punctuation."""
    s = F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, "^[\"'\\s]+|[\"'\\s]+$", "")), r"\s+", " "))
    return F.when((s == "") | s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))


def statement_id(text: Column, article: Column, run: Column) -> Column:
    return F.sha1(F.concat_ws("|", text, article, run).cast("binary"))


def signature(detail: Column, width: int = 160) -> Column:
    """An error message with indices, dates, hashes and numbers taken out."""
    s = F.regexp_replace(F.coalesce(detail, F.lit("")), r"fact\[\d+\]", "fact[N]")
    s = F.regexp_replace(s, r"\b\d{4}-\d{2}-\d{2}\b", "<DATE>")
    s = F.regexp_replace(s, r"\b[0-9a-f]{8,}\b", "<HASH>")
    return F.substring(F.regexp_replace(s, r"\b\d+\b", "<N>"), 1, width)


def quality(text: Column, *, chars: int = 400, words: int = 50, sentences: int = 3, sentence_words: float = 4.0, diversity: float = 0.15, menu: float = 0.6) -> Column:
    """The first check that an extracted text fails, or 'ok'."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    # a struct in an array that a lambda takes apart, so that each measure is worked out once and not in every branch
    measures = F.struct(
        F.regexp_count(text, F.lit(r"\S+")).alias("n"),
        F.regexp_count(text, F.lit("[.!?]")).alias("ends"),
        F.size(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""))).alias("distinct"),
        F.size(lines).alias("lines"),
        F.size(F.filter(lines, lambda x: ~F.regexp_like(x, F.lit(r"\S\s+\S+\s+\S")))).alias("short"),
        F.lower(F.substring(text, 1, 1000)).alias("head"),
    )

    def judge(m: Column) -> Column:
        out = F.when(text.isNull() | (text == ""), "empty").when(F.length(text) < chars, "too_short")
        for phrase, tag in BLOCKERS:
            out = out.when(m["head"].contains(phrase), f"blocker:{tag}")
        return (
            out.when(m["n"] < words, "too_few_words")
            .when(m["distinct"] / m["n"] < diversity, "low_diversity")
            .when(m["ends"] < sentences, "too_few_sentences")
            .when(m["n"] / F.greatest(m["ends"], F.lit(1)) < sentence_words, "avg_sentence_too_short")
            .when((m["lines"] > 0) & (m["short"] / m["lines"] > menu), "nav_dump")
            .otherwise("ok")
        )

    return F.transform(F.array(measures), lambda m: judge(m))[0]


def evidence(position: Column, date: Column, source: Column, title: Column, body: Column, chars: int = 900) -> Column:
    """A numbered heading and the text's beginning."""
    return F.concat(F.format_string("[%d] %s (%s, %s)\n", position, title, source, date), F.substring(body, 1, chars))


def n_tokens(text: Column) -> Column:
    """An estimate: a token is four characters."""
    return F.floor(F.length(text) / 4)


def query_key(*parts: Column) -> Column:
    """A stable name for a query: the MD5 of its parts, one to a line; a missing part is empty."""
    return F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def actor_query(names: Column, actors: Column, question: Column, width: int = 120) -> Column:
    """Two quoted names, or else two actors' codes, or else the question's beginning."""
    one = lambda a, i: F.try_element_at(a, F.lit(i))
    named = F.when((F.coalesce(one(names, 1), F.lit("")) != "") & (F.coalesce(one(names, 2), F.lit("")) != ""), F.format_string('"%s" "%s"', one(names, 1), one(names, 2)))
    return F.coalesce(named, F.when(F.size(actors) >= 2, F.concat_ws(" ", one(actors, 1), one(actors, 2))), F.substring(F.coalesce(question, F.lit("")), 1, width))


def prior_sentence(benchmark: Column, prior: Column, stability: Column, events: Column, lookback: Column) -> Column:
    """What is expected if nothing changes, in the words of the question's benchmark; '' without a prior."""
    share = F.floor(stability * 100)
    out = F.when(benchmark == "events", F.format_string("Over the past %d days the actors' usual class was '%s' (%d%% of %d events).", lookback, prior, share, events))
    out = out.when(benchmark == "company", F.format_string("In recent quarters the company mostly reported '%s' (%d%% of %d quarters).", prior, share, events))
    out = out.when(benchmark == "market", F.format_string("The crowd's majority answer was '%s' (strength %.2f).", prior, stability))
    return F.when(F.coalesce(prior, F.lit("")) == "", "").otherwise(out.otherwise(F.format_string("The expectation is '%s'.", prior)))


def confidence_weight(raw: Column) -> Column:
    """A weight from a word, or from a number clamped to [0, 1]; 0.5 for anything else."""
    number = raw.try_cast("double")
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))).when(raw == "high", 0.9).when(raw == "medium", 0.6).when(raw == "low", 0.3).otherwise(0.5)
