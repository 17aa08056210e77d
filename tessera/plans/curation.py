"""Questions and evidence: merging, cascades, look-ahead, quality, domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, texts, urls
from ..operators import cascade, merging, ranking
from .registry import query, table


def linked_evidence(spark, sf_dir: str, policy: cascade.LookAhead) -> DataFrame:
    """Orders as questions (cutoff: 14 days after the order), their lines as dated evidence that the policy allows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.date_add(F.col("o_orderdate").cast("date"), 45).alias("cutoff"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity", F.col("l_shipdate").cast("date").alias("day"))
    return o.join(e, "o_orderkey").filter(policy.allows(F.col("day"), F.col("cutoff")))


_EVIDENCE = """
 o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) + 45 AS cutoff FROM orders),
 e AS (SELECT o.*, l_linenumber, l_partkey, l_quantity, CAST(l_shipdate AS DATE) AS day FROM o JOIN lineitem ON l_orderkey = o_orderkey)"""


def _measured(spark, sf_dir: str) -> DataFrame:
    kept = linked_evidence(spark, sf_dir, cascade.POLICIES["quality"]).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"), F.sum("l_quantity").alias("mass"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.join(kept, "o_orderkey", "left").fillna(0, ["n", "days", "mass"])


def _checks() -> cascade.Checks:
    few_days = F.when(F.col("o_orderstatus") == "P", 3).otherwise(2)  # a group may have a minimum of its own
    return [("n_articles", F.col("n") < 3), ("day_spread", F.col("days") < few_days), ("char_count", F.col("mass") < 60), ("question_len", F.length(F.regexp_replace(F.trim("o_orderpriority"), r"\s+", " ")) < 6)]


_MEASURED = f"""WITH {_EVIDENCE},
 m AS (SELECT o.o_orderkey, o.o_orderstatus, o.o_orderpriority, count(e.day) AS n, count(DISTINCT e.day) AS days, coalesce(sum(e.l_quantity), 0) AS mass
       FROM o LEFT JOIN e ON e.o_orderkey = o.o_orderkey AND e.day < o.cutoff GROUP BY ALL),
 r AS (SELECT *, list_filter([CASE WHEN n < 3 THEN 'n_articles' END, CASE WHEN days < CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 2 END THEN 'day_spread' END,
       CASE WHEN mass < 60 THEN 'char_count' END, CASE WHEN length(regexp_replace(trim(o_orderpriority), '\\s+', ' ', 'g')) < 6 THEN 'question_len' END], lambda x: x IS NOT NULL) AS reasons FROM m)"""


@query(_MEASURED + " SELECT o_orderkey, n AS n_evidence, days AS n_days, round(mass, 2) AS mass, array_to_string(reasons, '|') AS drop_reasons, len(reasons) = 0 AS accepted FROM r")
def quality_cascade(spark, sf_dir):
    """Evidence before the cutoff, measured for each question; every failing check is kept as a reason."""
    r = _measured(spark, sf_dir).withColumn("r", cascade.all_reasons(_checks()))
    return r.select("o_orderkey", F.col("n").alias("n_evidence"), F.col("days").alias("n_days"), F.round("mass", 2).alias("mass"), F.array_join("r", "|").alias("drop_reasons"), (F.size("r") == 0).alias("accepted"))


@query(_MEASURED + " SELECT array_to_string(reasons, '|') AS pattern, count(*) AS n FROM r WHERE len(reasons) > 0 GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10")
def drop_reason_patterns(spark, sf_dir):
    dropped = cascade.split(_measured(spark, sf_dir), cascade.all_reasons(_checks()))[1]
    return dropped.groupBy(F.array_join("drop_reasons", "|").alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(10)


@query(f"""WITH {_EVIDENCE} SELECT p.policy, count(*) AS n_kept, count(DISTINCT o_orderkey) AS n_questions FROM e JOIN (VALUES
 ('quality', 0, NULL), ('fetch', 1, NULL), ('earnings_link', 1, 90), ('relevance', 0, 90), ('editorial', 0, NULL), ('horizon', 0, NULL), ('rebuild', 1, NULL), ('relink', 0, NULL), ('attach', 0, 90)) p(policy, closed, back)
 ON (day < cutoff OR (closed = 1 AND day = cutoff)) AND (back IS NULL OR day >= cutoff - back) GROUP BY 1""")
def leakage_variants(spark, sf_dir):
    """What each of the nine look-ahead policies keeps, in one pass over the links."""
    links = linked_evidence(spark, sf_dir, cascade.LookAhead("until", True))
    flags = [F.struct(F.lit(n).alias("policy"), p.allows(F.col("day"), F.col("cutoff")).alias("ok")) for n, p in cascade.POLICIES.items()]
    return links.select("o_orderkey", F.inline(F.array(*flags))).filter("ok").groupBy("policy").agg(F.count("*").alias("n_kept"), F.countDistinct("o_orderkey").alias("n_questions"))


@query("""SELECT d.doc_id, CASE WHEN lang <> 'en' THEN 'language' WHEN n_chars < 200 THEN 'short' WHEN quality = 0 THEN 'quality' WHEN toxic = 1 THEN 'toxic' ELSE 'kept' END AS reason
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def first_fail_filter(spark, sf_dir):
    """Only the first failing check is named; a check without data does not fail."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    checks = [("language", F.col("lang") != "en"), ("short", F.col("n_chars") < 200), ("quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)]
    return d.select("doc_id", cascade.first_reason(checks, "kept").alias("reason"))


_KEYED = "SELECT page_id, html, 'art_' || substr(sha1(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) || regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*(.*)$', 1), '[?#].*$', ''), '/+$', '')), 1, 12) AS id, split_part(url, ':', 1) AS source, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'l' || page_id % 4 END AS lang FROM pages"


@query(f"""SELECT id, md5(arg_max(html, (length(html), -page_id))) AS text, arg_max(page_id, (length(html), -page_id)) AS longest, coalesce(arg_min(lang, page_id) FILTER (lang <> ''), '') AS lang, array_to_string(list_sort(list_distinct(list(source))), ',') AS provenance, count(*) AS n_records FROM ({_KEYED}) GROUP BY 1""")
def dedup_merge(spark, sf_dir):
    """Pages of one address become one: the longest text, the first language there is, the union of sources."""
    p = table(spark, sf_dir, "pages").select("page_id", "html", urls.article_id(urls.key(F.col("url"))).alias("id"), F.split("url", ":")[0].alias("source"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("l"), F.col("page_id") % 4)).alias("lang"))
    m = merging.dedup_merge(p.withColumn("sources", F.array("source")).withColumn("longest", F.col("page_id")), "id", "page_id", "html", ["longest"], ["lang"], ["sources"])
    return m.select("id", F.md5(F.col("html").cast("binary")).alias("text"), "longest", "lang", F.array_join("sources", ",").alias("provenance"), "n_records")


@query("""SELECT 'art_' || sha256(text) AS id, text, arg_max(n_chars, (length(text), -doc_id)) AS n_chars, arg_min(lang, doc_id) AS lang, array_to_string(list_sort(list_distinct(list(source))), ',') AS provenance, count(*) AS n_records FROM documents GROUP BY text""")
def dedup_merge_whole(spark, sf_dir):
    """Records with one text become one; the id is the whole text's SHA-256."""
    return _merged(table(spark, sf_dir, "documents").withColumn("id", F.concat(F.lit("art_"), F.sha2(F.col("text").cast("binary"), 256))))


def _merged(documents: DataFrame) -> DataFrame:
    d = documents.withColumn("sources", F.array("source"))
    m = merging.dedup_merge(d, "id", "doc_id", "text", ["n_chars"], ["lang"], ["sources"])
    return m.select("id", "text", "n_chars", "lang", F.array_join("sources", ",").alias("provenance"), "n_records")


@query("SELECT count(*) AS n_groups, coalesce(sum(n - 1), 0) AS excess FROM (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def exact_dup_excess(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.count("*").alias("n")).filter("n > 1")
    return g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


@query("""SELECT lower(trim(p_name)) AS title, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 2""")
def title_collisions(spark, sf_dir):
    """Titles that several records have."""
    return table(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_name")).alias("title")).agg(F.count("*").alias("n")).filter("n >= 2")


@query("""SELECT lower(trim(text)) AS title, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 2""")
def text_collisions(spark, sf_dir):
    """Whole texts that several records have, whatever their case."""
    return table(spark, sf_dir, "documents").groupBy(F.lower(F.trim("text")).alias("title")).agg(F.count("*").alias("n")).filter("n >= 2")


_HOST = "regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


@query(f"""SELECT page_id, 'art_' || substr(sha1(url), 1, 12) AS id, replace({_HOST}, 'www.', '') AS domain, regexp_replace({_HOST}, '^www\\.', '') AS site, regexp_replace({_HOST}, '^[w.]+', '') AS stripped,
 regexp_extract(lower(url), '^([a-z]+):', 1) || '://' || {_HOST} || regexp_replace({_PATH}, '/+$', '') AS url_key, substr(md5(url || '|' || '2026-01-01'), 1, 10) AS dated_id FROM pages""")
def url_features(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.article_id(u).alias("id"), urls.domain(u).alias("domain"), urls.site(u).alias("site"), urls.stripped_site(u).alias("stripped"), urls.key(u).alias("url_key"), urls.dated_id(u, F.lit("2026-01-01")).alias("dated_id"))


@query(f"""SELECT page_id, lower(regexp_replace({_PATH} || ' ' || regexp_extract(url, '\\?([^#]*)', 1), '[-_/]+', ' ', 'g')) AS slug,
 len(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) >= 2 AND (replace({_HOST}, 'www.', '') SIMILAR TO '.*(bbc|cnn|herald|news|post|press|reuters|times|tribune).*'
  OR (length(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')[-1]) > 20 AND length(regexp_replace(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')[-1], '[^-]', '', 'g')) >= 2)) AS news FROM pages""")
def url_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.slug(F.col("url")).alias("slug"), urls.looks_like_news(F.col("url")).alias("news"))


_LISTED = ("tionble.example.org", "example.net")


@query(f"""SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS host, regexp_replace({_HOST}, '^www\\.', '') IN ('tionble.example.org', 'example.net')
 OR {_HOST} LIKE '%.tionble.example.org' OR {_HOST} LIKE '%.example.net' AS listed FROM pages""")
def spam_domain_filter(spark, sf_dir):
    """A domain list by exact host or parent: spam, aggregators and allow lists share this test."""
    host = urls.site(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), urls.in_domains(host, _LISTED).alias("listed"))


@query("""WITH u AS (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/2026/3/1/a' WHEN 1 THEN '/2026/13/01/' WHEN 2 THEN '/2024/12/31.html' WHEN 3 THEN '/2024/2/30' ELSE '' END AS url FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)),
 p AS (SELECT page_id, regexp_extract(url, '/(20\\d{2})/(\\d{1,2})/(\\d{1,2})(?:/|\\.|$)', 1) AS y, regexp_extract(url, '/(20\\d{2})/(\\d{1,2})/(\\d{1,2})(?:/|\\.|$)', 2) AS m, regexp_extract(url, '/(20\\d{2})/(\\d{1,2})/(\\d{1,2})(?:/|\\.|$)', 3) AS d FROM u)
 SELECT page_id, CASE WHEN y <> '' AND try_cast(m AS INT) BETWEEN 1 AND 12 AND try_cast(d AS INT) BETWEEN 1 AND 31 THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') ELSE '' END AS publish_date FROM p""")
def url_dates(spark, sf_dir):
    """Dates in paths, planted in five shapes on the given urls."""
    tail = F.element_at(F.array(*map(F.lit, ("/2026/3/1/a", "/2026/13/01/", "/2024/12/31.html", "/2024/2/30", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", urls.path_date(F.concat(F.regexp_replace("url", "[?#].*$", ""), tail)).alias("publish_date"))


@query("""WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w, len(regexp_extract_all(text, '[.!?]')) AS ends,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents)
 SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN length(text) < 400 THEN 'too_short' WHEN len(w) < 50 THEN 'too_few_words' WHEN len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) < 0.15 THEN 'low_diversity'
  WHEN ends < 3 THEN 'too_few_sentences' WHEN len(w) / greatest(ends, 1) < 4 THEN 'avg_sentence_too_short'
  WHEN len(lines) > 0 AND len(list_filter(lines, lambda x: len(regexp_split_to_array(x, '\\s+')) <= 2)) / len(lines) > 0.6 THEN 'nav_dump' ELSE 'ok' END AS verdict FROM t""")
def text_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.quality(F.col("text")).alias("verdict"))


@query("""SELECT p_partkey, CASE WHEN p_name SIMILAR TO '(?i).*(small|steel|tin|plated).*' OR regexp_matches(p_type, '(?i)promo|economy') THEN true ELSE false END AS denied FROM part""")
def topic_deny(spark, sf_dir):
    """Topics by one case-insensitive pattern."""
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_name").rlike("(?i)small|steel|tin|plated") | F.col("p_type").rlike("(?i)promo|economy")).alias("denied"))


@query("""SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - 14, '%Y-%m-%d') AS forecast_point, 'Q' || quarter(o_orderdate) || '-' || year(o_orderdate) AS quarter,
 CASE o_orderkey % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' ELSE 'unknown' END AS precision FROM orders""")
def date_projections(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    partial = F.element_at(F.array(day, F.substring(day, 1, 7), F.substring(day, 1, 4), F.lit("soon")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.horizon(day, 14).alias("forecast_point"), dates.quarter(F.col("o_orderdate")).alias("quarter"), dates.precision(partial).alias("precision"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS published, CAST(l_shipdate AS DATE) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
 SELECT l_orderkey, l_linenumber, t - published >= 0 AND t - published <= 1095 AND len(list_filter([0,1,2,3,7,14,30,60,90,180,365], lambda a: abs(t - published - a) <= 1)) > 0 AS canonical FROM p""")
def anchor_dates(spark, sf_dir):
    """Whether a day lies within a day of an anchor offset of another."""
    p = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return p.select("l_orderkey", "l_linenumber", dates.canonical(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("canonical"))


@query(f"""WITH {_EVIDENCE}, k AS (SELECT * FROM e WHERE day < cutoff)
 SELECT o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS article_ids, strftime(any_value(cutoff), '%Y-%m-%d') AS forecast_point FROM k GROUP BY o_orderkey""")
def experiment_horizon(spark, sf_dir):
    """Links under another horizon, in their order; questions without evidence fall away."""
    kept = linked_evidence(spark, sf_dir, cascade.POLICIES["horizon"])
    g = kept.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"), F.first("cutoff").alias("cutoff"))
    return g.select("o_orderkey", F.array_join(F.transform("s", lambda s: s["l_partkey"].cast("string")), ",").alias("article_ids"), F.date_format("cutoff", "yyyy-MM-dd").alias("forecast_point"))


@query("""WITH s AS (SELECT user_id, event_type, value, ts, event_id, sum(value) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS mass FROM events) SELECT event_id, round(mass, 4) AS mass FROM s WHERE mass >= 100""")
def daily_mentions_filter(spark, sf_dir):
    """Rows whose composite key of user, type and day sums to a minimum; a key's values are added one by one in the order of events, as sums of doubles depend on it."""
    key = W.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("event_id", "value").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = table(spark, sf_dir, "events").withColumn("mass", F.sum("value").over(key)).filter("mass >= 100")
    scaled = F.col("mass") * 10000  # the SQL's round takes the product too, and leaves what would overflow
    return e.select("event_id", F.when(scaled < float("inf"), F.round(scaled) / 10000).otherwise(F.col("mass")).alias("mass"))


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, min(CAST(ts AS DATE)) OVER (PARTITION BY user_id, event_type) AS d0 FROM events) WHERE CAST(ts AS DATE) = d0""")
def first_seen_day(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id", "event_type").agg(F.min(F.to_date("ts")).alias("d0"))
    return e.join(first, ["user_id", "event_type"]).filter(F.to_date("ts") == F.col("d0")).select("event_id", "user_id", "event_type")


@query("""SELECT doc_id, source, lang, rank FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS rank FROM documents) WHERE rank <= 3""")
def stratified_sample(spark, sf_dir):
    return ranking.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["lang", "source"], "doc_id", 3, "42")


@query("""SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents WHERE n_chars >= 300) WHERE n = 1""")
def diverse_picks(spark, sf_dir):
    """The first sufficient record of each source and class."""
    return ranking.keep_first(table(spark, sf_dir, "documents").filter("n_chars >= 300").select("source", "lang", "doc_id"), ["source", "lang"], [F.col("doc_id")])


@query(f"""WITH {_EVIDENCE}, k AS (SELECT * FROM e WHERE day < cutoff), g AS (SELECT o_orderkey, any_value(o_orderstatus) AS st, count(*) AS n, count(DISTINCT day) AS days, sum(l_quantity) AS mass FROM k GROUP BY 1)
 SELECT st AS status, CASE WHEN n < 2 THEN 'links' WHEN days < 2 THEN 'days' WHEN mass < 80 THEN 'mass' ELSE 'selected' END AS outcome, count(*) AS n FROM g GROUP BY ALL""")
def gold_selection(spark, sf_dir):
    """An ordered selection with the outcome of each question, counted by class."""
    g = linked_evidence(spark, sf_dir, cascade.POLICIES["quality"]).groupBy("o_orderkey").agg(F.first("o_orderstatus").alias("status"), F.count("*").alias("n"), F.countDistinct("day").alias("days"), F.sum("l_quantity").alias("mass"))
    outcome = cascade.first_reason([("links", F.col("n") < 2), ("days", F.col("days") < 2), ("mass", F.col("mass") < 80)], "selected")
    return g.groupBy("status", outcome.alias("outcome")).agg(F.count("*").alias("n"))
