"""Projections into common shapes, selections with reasons and counters, rebuilt links, small joins and profiles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import jsons, texts, urls
from ..operators import cascade, linking, ranking
from .registry import query, table


@query("""SELECT doc_id AS id, coalesce(text, '') AS text, trim(split_part(coalesce(text, ''), '.', 1) || ' ' || coalesce(text, '')) AS title_text, length(coalesce(text, '')) AS char_count, CAST(n_chars AS DOUBLE) / 10 AS tone, coalesce(lang, '') AS lang FROM documents""")
def article_projection(spark, sf_dir):
    """Records in the common shape: no nulls in texts, title and text in one, lengths, tone as a number."""
    d = table(spark, sf_dir, "documents").withColumn("body", F.coalesce("text", F.lit("")))
    title = F.substring_index("body", ".", 1)
    return d.select(F.col("doc_id").alias("id"), F.col("body").alias("text"), F.trim(F.concat_ws(" ", title, "body")).alias("title_text"), F.length("body").alias("char_count"), (F.col("n_chars").cast("double") / 10).alias("tone"), F.coalesce("lang", F.lit("")).alias("lang"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus || '|x y' WHEN 1 THEN o_orderstatus WHEN 2 THEN '' ELSE '' END AS actors FROM orders""")
def news_projection(spark, sf_dir):
    """A cell of actors that is a list, a value alone, empty or null, as a list."""
    cell = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("['"), F.col("o_orderstatus"), F.lit("', 'x y']"))).when(F.col("o_orderkey") % 4 == 1, F.col("o_orderstatus")).when(F.col("o_orderkey") % 4 == 2, "")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(jsons.cell_list(cell), "|").alias("actors"))


@query("""SELECT 'earn_' || substr(sha1('http://q/' || p_partkey), 1, 12) AS id, upper(p_brand) AS actors, p_name AS title, p_retailprice AS price FROM part""")
def earnings_projection(spark, sf_dir):
    """Company news: the ticker is the only actor."""
    return table(spark, sf_dir, "part").select(urls.article_id(F.concat(F.lit("http://q/"), F.col("p_partkey")), "earn_").alias("id"), F.array_join(F.array(F.upper("p_brand")), "|").alias("actors"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))


_CODED = """SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m%d') AS day, strftime(l_shipdate + INTERVAL (l_linenumber % 3 // 2) DAY, '%Y%m%d') AS added, l_suppkey % 27 AS a1, l_partkey % 27 AS a2, CASE WHEN l_quantity >= 45 THEN '--' ELSE lpad(CAST(l_linenumber * 30 AS VARCHAR), 3, '0') END AS code FROM lineitem"""


def _coded(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    day, later = F.col("l_shipdate").cast("date"), F.floor(F.col("l_linenumber") % 3 / 2).cast("int")
    code = F.when(F.col("l_quantity") >= 45, "--").otherwise(F.lpad((F.col("l_linenumber") * 30).cast("string"), 3, "0"))
    return l.select("l_orderkey", "l_linenumber", F.date_format(day, "yyyyMMdd").alias("day"), F.date_format(F.date_add(day, later), "yyyyMMdd").alias("added"), (F.col("l_suppkey") % 27).alias("a1"), (F.col("l_partkey") % 27).alias("a2"), code.alias("code"))


_KEPT = f"SELECT * FROM ({_CODED}) WHERE day = added AND a1 IN (SELECT n_nationkey FROM nation) AND a2 IN (SELECT n_nationkey FROM nation) AND a1 <> a2 AND code <> '--' AND code IN ('030', '060', '120', '180', '210')"


def _kept(spark, sf_dir):
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("known"))
    codes = spark.createDataFrame([(c,) for c in ("030", "060", "120", "180", "210")], "code string")
    e = _coded(spark, sf_dir).filter("day = added and a1 <> a2 and code <> '--'")
    for side in ("a1", "a2"):
        e = e.join(F.broadcast(known), F.col(side) == F.col("known"), "left_semi")
    return e.join(F.broadcast(codes), "code", "left_semi")


@query(f"SELECT l_orderkey, l_linenumber, code FROM ({_KEPT})")
def event_row_filter(spark, sf_dir):
    """Events of the day they were added, between two known countries, with a known code."""
    return _kept(spark, sf_dir).select("l_orderkey", "l_linenumber", "code")


@query(f"""SELECT l_orderkey, l_linenumber, substr(day, 1, 4) || '-' || substr(day, 5, 2) || '-' || substr(day, 7, 2) AS date_str, x.n_name AS name1, y.n_name AS name2, 'Q' || CAST(code AS INT) // 60 || '_' || code AS quad_event FROM ({_KEPT}) LEFT JOIN nation x ON x.n_nationkey = a1 AND a1 % 5 <> 0 LEFT JOIN nation y ON y.n_nationkey = a2""")
def derived_event_columns(spark, sf_dir):
    """Names by a lookup (null where it has none), dates in another spelling, a code of two parts."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    e = _kept(spark, sf_dir)
    e = e.join(F.broadcast(n.filter("n_nationkey % 5 <> 0").withColumnsRenamed({"n_nationkey": "a1", "n_name": "name1"})), "a1", "left").join(F.broadcast(n.withColumnsRenamed({"n_nationkey": "a2", "n_name": "name2"})), "a2", "left")
    quad = F.concat(F.lit("Q"), F.floor(F.col("code").cast("int") / 60).cast("string"))
    return e.select("l_orderkey", "l_linenumber", F.date_format(F.to_date("day", "yyyyMMdd"), "yyyy-MM-dd").alias("date_str"), "name1", "name2", F.concat_ws("_", quad, "code").alias("quad_event"))


_LINKED = """q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) + 30 END AS t FROM orders), l AS (SELECT l_orderkey, l_linenumber AS pos, l_suppkey, l_partkey * 1000 + l_linenumber AS id, l_partkey % 8 = 1 AS dangling, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_shipdate AS DATE) END AS d FROM lineitem)"""


def _linked(spark, sf_dir):
    """Questions (cutoff, ids in order) and dated articles, some of them missing or undated."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").cast("date").alias("day"), "l_suppkey")
    ids = linking.collected(l.withColumn("at", F.struct("l_linenumber", "id", "l_suppkey")), ["l_orderkey"], "at", "id", "ids").withColumnRenamed("l_orderkey", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.date_add(F.col("o_orderdate").cast("date"), 30)).alias("t"))
    found = l.filter("l_partkey % 8 <> 1").groupBy("id").agg(F.max(F.when(F.col("l_partkey") % 5 != 0, F.col("day"))).alias("day"), F.lit(True).alias("there"))
    return o.join(ids, "o_orderkey"), found


_FOUND = "f AS (SELECT id, max(d) AS day FROM l WHERE NOT dangling GROUP BY 1), j AS (SELECT q.o_orderkey, t, pos, l.id, l_suppkey, f.id IS NOT NULL AS there, f.day FROM q JOIN l ON l_orderkey = o_orderkey LEFT JOIN f ON f.id = l.id)"


@query(f"""WITH {_LINKED}, {_FOUND}, k AS (SELECT * FROM j WHERE t IS NULL OR (there AND (day IS NULL OR day < t)))
 SELECT o_orderkey, coalesce(string_agg(CAST(k.id AS VARCHAR), ',' ORDER BY pos, k.id, l_suppkey), '') AS ids FROM (SELECT DISTINCT o_orderkey FROM j) LEFT JOIN k USING (o_orderkey) GROUP BY 1""")
def leakage_rewrite(spark, sf_dir):
    """Ids of articles from after the cutoff, and of none at all, leave the question's list; without a cutoff it stays as it was."""
    q, a = _linked(spark, sf_dir)
    out = linking.relinked(q, "o_orderkey", "ids", a, F.col("t").isNull() | (F.col("there") & (F.col("day").isNull() | (F.col("day") < F.col("t")))))
    return out.select("o_orderkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"""WITH {_LINKED}, {_FOUND}, k AS (SELECT * FROM j WHERE t IS NOT NULL AND there AND day <= t - 14)
 SELECT o_orderkey, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT -1, count(*) FROM j WHERE t IS NOT NULL AND NOT there""")
def horizon_rebuild(spark, sf_dir):
    """Questions with a cutoff, which is set two weeks earlier: those that keep a dated article until then, and in row -1 the dangling links."""
    q, a = _linked(spark, sf_dir)
    q = q.filter("t is not null").withColumn("t", F.date_sub("t", 14))
    kept = linking.relinked(q, "o_orderkey", "ids", a, cascade.POLICIES["rebuild"].allows(F.col("day"), F.col("t"))).filter(F.size("ids") > 0)
    dangling = linking.exploded(q, "ids", "o_orderkey").join(a, "id", "left_anti").agg(F.count("*").alias("n"))
    return kept.select("o_orderkey", F.size("ids").cast("long").alias("n")).unionByName(dangling.select(F.lit(-1).cast("long").alias("o_orderkey"), "n"))


@query(f"""WITH {_LINKED}, {_FOUND} SELECT o_orderkey, string_agg(CASE WHEN there THEN coalesce(strftime(day, '%Y-%m-%d'), 'undated') ELSE 'none' END, ',' ORDER BY pos, id, l_suppkey) AS days FROM j GROUP BY 1""")
def ordered_articles(spark, sf_dir):
    """Every id of a question's list with what it refers to, in the list's order."""
    q, a = _linked(spark, sf_dir)
    rows = linking.exploded(q, "ids", "o_orderkey").join(a, "id", "left")
    day = F.when(F.col("there"), F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("undated"))).otherwise("none")
    return linking.collected(rows.withColumn("shown", day), ["o_orderkey"], "pos", "shown", "days").select("o_orderkey", F.array_join("days", ",").alias("days"))


@query("SELECT c_custkey, c_nationkey, CAST(NULL AS VARCHAR) AS missing FROM customer")
def shipped_fields(spark, sf_dir):
    """Only fields on the list leave, in its order; one that a record lacks is null."""
    return cascade.shipped(table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey", "missing"])


_TYPED = """SELECT o_orderkey, CASE WHEN p IS NULL THEN 'unknown' WHEN p = o_orderstatus THEN 'stability' ELSE 'change' END AS fd_type FROM (SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)"""


@query(f"SELECT fd_type AS slice, o_orderkey FROM ({_TYPED}) WHERE fd_type IN ('change', 'stability')")
def change_slices(spark, sf_dir):
    """The slices of questions whose outcome changed and of those whose outcome stayed."""
    prior = F.lag("o_orderstatus").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.when(prior.isNull(), "unknown").when(prior == F.col("o_orderstatus"), "stability").otherwise("change").alias("fd_type"))
    parts = [t.filter(F.col("fd_type") == s).select(F.lit(s).alias("slice"), "o_orderkey") for s in ("change", "stability")]
    return parts[0].unionByName(parts[1])


@query("""SELECT s_suppkey, s_nationkey IN (1, 3, 8, 12, 24) AS significant, s_nationkey IN (1, 3, 8, 12, 24) OR s_suppkey % 25 IN (1, 3, 8, 12, 24) AS involved FROM supplier""")
def significant_actors(spark, sf_dir):
    """Membership of one value, and of any of several, in a fixed set."""
    chosen = [1, 3, 8, 12, 24]
    both = F.array(F.col("s_nationkey").cast("long"), (F.col("s_suppkey") % 25).cast("long"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").isin(*chosen).alias("significant"), F.arrays_overlap(both, F.array(*(F.lit(c).cast("long") for c in chosen))).alias("involved"))


_HOSTS = "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'feeds.aggregator.net' WHEN page_id % 3 = 1 THEN NULL ELSE 'paper.org' END AS domain, regexp_extract(url, '://([^/?#:]*)', 1) AS host FROM pages"


@query(f"SELECT page_id FROM ({_HOSTS}) WHERE NOT regexp_matches(lower(coalesce(domain, host)), '(^|\\.)(aggregator\\.net|example\\.net)$')")
def aggregator_filter(spark, sf_dir):
    """Articles of aggregators go; the domain field counts before the url's host."""
    domain = F.when(F.col("page_id") % 3 == 0, "feeds.aggregator.net").when(F.col("page_id") % 3 == 2, "paper.org")
    p = table(spark, sf_dir, "pages").select("page_id", F.lower(F.coalesce(domain, urls.hostname(F.col("url")))).alias("host"))
    return p.filter(~urls.in_domains(F.col("host"), ("aggregator.net", "example.net"))).select("page_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'ation') OR contains(lower(text), 'schr') OR contains(lower(text), 'eaux')")
def subject_keywords(spark, sf_dir):
    """Texts with any of some keywords in them."""
    words = F.array(*map(F.lit, ("ation", "schr", "eaux")))
    return table(spark, sf_dir, "documents").filter(F.exists(words, lambda w: F.contains(F.lower("text"), w))).select("doc_id")


_RESOLVED = """r AS (SELECT l_orderkey, l_linestatus = 'F' AS settled, l_discount * 12 AS value, l_shipdate, l_linenumber FROM lineitem), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY settled DESC, l_shipdate DESC, l_linenumber DESC, value) AS n FROM r) WHERE n = 1),
 x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'source' WHEN NOT settled THEN 'unresolved' WHEN value < 0 OR value > 1 THEN 'probability' END AS reason, value FROM orders JOIN b ON l_orderkey = o_orderkey)"""


def _questions(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linestatus") == "F").alias("settled"), (F.col("l_discount") * 12).alias("value"), "l_shipdate", "l_linenumber")
    best = linking.resolved(r, "l_orderkey", "settled", [F.desc("l_shipdate"), F.desc("l_linenumber"), F.col("value")])
    j = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(best, F.col("o_orderkey") == F.col("l_orderkey"))
    reason = cascade.first_reason([("source", F.col("o_orderstatus") == "P"), ("unresolved", ~F.col("settled")), ("probability", ~F.col("value").between(0, 1))])
    return j.select("o_orderkey", reason.alias("reason"), "value")


@query(f"WITH {_RESOLVED} SELECT o_orderkey, value >= 0.5 AS truth FROM x WHERE reason IS NULL")
def resolved_questions(spark, sf_dir):
    """Questions with the resolution that counts (settled before others, then the latest), and their truth."""
    return _questions(spark, sf_dir).filter("reason is null").select("o_orderkey", (F.col("value") >= 0.5).alias("truth"))


@query(f"WITH {_RESOLVED} SELECT coalesce(reason, 'kept') AS outcome, count(*) AS n FROM x GROUP BY 1")
def resolved_counters(spark, sf_dir):
    """How many questions each check of the cascade drops."""
    return _questions(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey, l_partkey, 'u' || l_partkey % 500 || l_shipmode AS url, 't' || l_quantity AS title, l_orderkey % 50 AS fd, CASE WHEN l_shipdate > DATE '1994-01-01' + CAST(l_orderkey % 2000 AS INT) THEN 'leak' WHEN l_suppkey % 17 = 0 THEN 'spam' END AS r FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'x' ELSE 'y' END AS l_shipmode FROM lineitem)),
 a AS (SELECT *, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY url, r IS NULL ORDER BY id, l_suppkey, l_partkey) > 1 THEN 'dup_url' ELSE r END AS s FROM f), b AS (SELECT *, CASE WHEN s IS NULL AND row_number() OVER (PARTITION BY fd, title, s IS NULL ORDER BY id, l_suppkey, l_partkey) > 1 THEN 'dup_title' ELSE s END AS o FROM a)
 SELECT coalesce(o, 'kept') AS outcome, count(*) AS n FROM b GROUP BY 1""")
def fetch_counters(spark, sf_dir):
    """What becomes of fetched records: leaks, spam, urls met before, titles met before for one question, kept."""
    l = table(spark, sf_dir, "lineitem")
    url = F.concat(F.lit("u"), F.col("l_partkey") % 500, F.when(F.col("l_returnflag") == "A", "x").otherwise("y"))
    f = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_suppkey", "l_partkey", url.alias("url"), F.col("l_quantity").alias("title"), (F.col("l_orderkey") % 50).alias("fd"), F.col("l_shipdate").cast("date").alias("day"), F.date_add(F.lit("1994-01-01").cast("date"), (F.col("l_orderkey") % 2000).cast("int")).alias("t"))
    checks = [("leak", F.col("day") > F.col("t")), ("spam", F.col("l_suppkey") % 17 == 0)]
    return cascade.fetch_outcomes(f, checks, "url", "title", "fd", [F.col("id"), F.col("l_suppkey"), F.col("l_partkey")]).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def orphan_selection(spark, sf_dir):
    """Questions without any article."""
    links = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderkey").alias("ids"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(links, "c_custkey", "left")
    return c.filter(F.coalesce(F.size("ids"), F.lit(0)) <= 0).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE (p_partkey % 3 = 0 OR p_brand = 'Brand#11') AND p_size % 4 IN (0, 1)")
def related_news(spark, sf_dir):
    """News whose list of related tickers has the question's, of two categories."""
    p = table(spark, sf_dir, "part").withColumn("related", F.concat_ws(",", F.lit("x"), F.when(F.col("p_partkey") % 3 == 0, F.lower("p_brand")), F.lit("Brand#11")))
    category = F.element_at(F.array(*map(F.lit, ("company", "earnings", "top", "forex"))), (F.col("p_size") % 4 + 1).cast("int"))
    return p.filter(F.array_contains(F.split(F.upper("related"), ","), F.upper("p_brand")) & category.isin("company", "earnings")).select("p_partkey")


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20') WHERE n <= 5""")
def window_first_few(spark, sf_dir):
    """The first five records of each key in a half-open window."""
    e = table(spark, sf_dir, "events").filter((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp")))
    return ranking.top_k(e, ["user_id"], [F.col("ts"), F.col("event_id")], 5).select("event_id")


@query("""SELECT k AS question, string_agg(DISTINCT u, ' ' ORDER BY u) AS urls FROM (SELECT o_custkey AS k, 'a' || o_orderkey % 40 AS u FROM orders UNION ALL SELECT c_custkey, 'b' || c_nationkey FROM customer) GROUP BY 1""")
def question_urls(spark, sf_dir):
    """The urls of each question from two files, each once."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question"), F.concat(F.lit("a"), F.col("o_orderkey") % 40).alias("u"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question"), F.concat(F.lit("b"), F.col("c_nationkey")).alias("u"))
    return a.unionByName(b).groupBy("question").agg(F.array_join(F.array_sort(F.collect_set("u")), " ").alias("urls"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def facts_on_benchmark(spark, sf_dir):
    """Facts that are linked to a question of one benchmark."""
    q = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(q, "l_orderkey", "left_semi")


@query("""SELECT doc_id, quality, strlen(text) AS bytes FROM (SELECT l.doc_id, quality, text, row_number() OVER (ORDER BY md5(l.doc_id || ':7'), l.doc_id) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id) WHERE n <= 20""")
def fact_text_sample(spark, sf_dir):
    """A seeded sample of facts with the texts they come from."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return j.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7")).cast("binary")), "doc_id").limit(20).select("doc_id", "quality", F.octet_length("text").alias("bytes"))


_EVENTS = "p AS (SELECT event_id, CAST(ts AS DATE) AS day, least(user_id % 12, (event_id * 7) % 12) AS a, greatest(user_id % 12, (event_id * 7) % 12) AS b, 'u' || event_id % 300 AS url FROM events)"


@query(f"""WITH {_EVENTS}, q AS (SELECT DISTINCT a, b, DATE '2024-01-12' + CAST((a * b) % 12 AS INT) AS t FROM p), j AS (SELECT q.a, q.b, url, min(event_id) AS event_id FROM q JOIN p ON p.a = q.a AND p.b = q.b AND day >= t - 8 AND day < t GROUP BY ALL)
 SELECT a || '-' || b AS pair, url, event_id FROM j WHERE url NOT IN (SELECT 'u' || x * 7 FROM range(0, 43) r(x))""")
def pair_attach(spark, sf_dir):
    """Events of a pair in the days before its cutoff, each url once, without urls that are attached already."""
    e = table(spark, sf_dir, "events")
    p = e.select("event_id", F.to_date("ts").alias("day"), linking.pair(F.col("user_id") % 12, (F.col("event_id") * 7) % 12).alias("pair"), F.concat(F.lit("u"), F.col("event_id") % 300).alias("url"))
    q = p.select("pair").distinct().withColumn("t", F.date_add(F.lit("2024-01-12").cast("date"), ((F.col("pair")[0] * F.col("pair")[1]) % 12).cast("int")))
    hit = p.join(q, "pair").filter((F.col("day") >= F.date_sub("t", 8)) & (F.col("day") < F.col("t")))
    there = spark.range(0, 43).select(F.concat(F.lit("u"), F.col("id") * 7).alias("url"))
    first = hit.groupBy("pair", "url").agg(F.min("event_id").alias("event_id")).join(F.broadcast(there), "url", "left_anti")
    return first.select(F.array_join(F.transform("pair", lambda x: x.cast("string")), "-").alias("pair"), "url", "event_id")


@query("""WITH r AS (SELECT o_custkey || '::m::' || o_orderkey AS custom_id, o_totalprice FROM orders) SELECT c_custkey AS fd, arg_min(custom_id, custom_id) AS first_id FROM customer JOIN r ON split_part(custom_id, '::', 1) = CAST(c_custkey AS VARCHAR) WHERE c_custkey % 4 = 0 GROUP BY 1""")
def first_result_lookup(spark, sf_dir):
    """For failed questions the first result whose id begins with theirs."""
    r = table(spark, sf_dir, "orders").select(F.concat_ws("::", "o_custkey", F.lit("m"), "o_orderkey").alias("custom_id"))
    first = r.groupBy(F.split("custom_id", "::")[0].cast("long").alias("fd")).agg(F.min("custom_id").alias("first_id"))
    return table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("fd")).join(first, "fd")


@query("""WITH f AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT l_orderkey AS fd, count(*) AS n_facts, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS facts FROM f WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1""")
def gold_facts(spark, sf_dir):
    """The facts of the chosen questions, each once, grouped by question."""
    chosen = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(chosen, "l_orderkey", "left_semi").dropDuplicates(["l_orderkey", "l_partkey"])
    return f.groupBy(F.col("l_orderkey").alias("fd")).agg(F.count("*").alias("n_facts"), F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("facts"))


@query("SELECT lang, count_if(quality = 0) AS q0, count_if(quality = 1) AS q1, count_if(toxic = 1) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def nested_counters(spark, sf_dir):
    """Counts by two keys, one of them across."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    across = j.groupBy("lang").pivot("quality", [0, 1]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"0": "q0", "1": "q1"})
    return across.join(j.groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("toxic")), "lang")


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds, string_agg(DISTINCT substr(event_type, 1, 2), ',' ORDER BY substr(event_type, 1, 2)) AS roots FROM events GROUP BY 1""")
def ordered_codes(spark, sf_dir):
    """All codes of a key in order, repeats included, and their roots, each once and sorted."""
    row = F.struct("ts", "event_id", "event_type")
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.array_sort(F.collect_set(F.substring("event_type", 1, 2))).alias("roots"))
    return g.select("user_id", F.array_join(F.transform("rows", lambda r: r["event_type"]), ",").alias("kinds"), F.array_join("roots", ",").alias("roots"))


@query("""SELECT s_nationkey AS query, root, string_agg(code, ' ' ORDER BY code) AS codes FROM (SELECT DISTINCT s_nationkey, substr(lpad(CAST(s_suppkey % 200 AS VARCHAR), 3, '0'), 1, 2) AS root, lpad(CAST(s_suppkey % 200 AS VARCHAR), 3, '0') AS code FROM supplier) GROUP BY ALL""")
def codes_by_root(spark, sf_dir):
    """The codes of each query as a map from roots to sorted codes, one row for each entry."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("query"), F.lpad((F.col("s_suppkey") % 200).cast("string"), 3, "0").alias("code"))
    by = s.groupBy("query", F.substring("code", 1, 2).alias("root")).agg(F.array_sort(F.collect_set("code")).alias("codes"))
    maps = by.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("root", "codes"))).alias("m"))
    return maps.select("query", F.explode("m").alias("root", "codes")).select("query", "root", F.array_join("codes", " ").alias("codes"))


@query("""SELECT l_orderkey AS fd, count(*) AS n, count(DISTINCT l_shipdate) AS days, sum(l_quantity) AS mass, round(avg(l_quantity), 6) AS mean, count(DISTINCT l_suppkey % 10) AS domains, count(*) - count(DISTINCT l_partkey % 7) AS repeated_titles FROM lineitem GROUP BY 1""")
def evidence_metrics(spark, sf_dir):
    """What a question's evidence amounts to."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fd"))
    return g.agg(F.count("*").alias("n"), F.count_distinct("l_shipdate").alias("days"), F.sum("l_quantity").alias("mass"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.count_distinct(F.col("l_suppkey") % 10).alias("domains"), (F.count("*") - F.count_distinct(F.col("l_partkey") % 7)).alias("repeated_titles"))


@query("""SELECT least(floor(l_discount * 125 + 0.001), 9) AS bin, count(*) AS n FROM lineitem GROUP BY 1""")
def half_open_bins(spark, sf_dir):
    """A histogram of half-open bins, of which the last takes what lies above."""
    return table(spark, sf_dir, "lineitem").groupBy(F.least(F.floor(F.col("l_discount") * 125 + 0.001), F.lit(9)).cast("double").alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT 'b' || l_suppkey % 13 AS name, CASE l_linenumber % 2 WHEN 0 THEN 'place' ELSE 'person' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL""")
def entity_counts(spark, sf_dir):
    """Names and kinds in a column of JSON arrays, counted."""
    entity = F.struct(F.concat(F.lit("b"), F.col("l_suppkey") % 13).alias("name"), F.when(F.col("l_linenumber") % 2 == 0, "place").otherwise("person").alias("kind"))
    cells = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(entity)).alias("cell"))
    e = cells.select(F.inline(F.from_json("cell", "array<struct<name:string,kind:string>>")))
    return e.groupBy("name", "kind").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, sum(CASE event_type WHEN 'view' THEN 0.5 WHEN 'click' THEN 1.0 ELSE 0 END) AS verbal, sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 0 END) AS material FROM events GROUP BY 1)
 SELECT user_id, CAST(verbal AS DOUBLE) AS verbal, CAST(material AS DOUBLE) AS material, CASE WHEN material > verbal THEN 'Material' ELSE 'Verbal' END AS side FROM s""")
def score_sums(spark, sf_dir):
    """Two conditional sums and the larger side; of equals the verbal one."""
    kind = F.col("event_type")
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when(kind == "view", 0.5).when(kind == "click", 1.0).otherwise(0.0)).alias("verbal"), F.sum(F.when(kind == "purchase", 1.0).when(kind == "click", 0.5).otherwise(0.0)).alias("material"))
    return g.withColumn("side", F.when(F.col("material") > F.col("verbal"), "Material").otherwise("Verbal"))


@query("""WITH k AS (SELECT c_custkey, c_nationkey AS source, count(o_orderkey) AS before, count(o_orderkey) FILTER (o_orderstatus <> 'P') AS after FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
 SELECT source, count_if(before > 0) AS with_before, count_if(after > 0) AS with_after, count_if(after = 0) AS without_after, round(100.0 * count_if(after > 0) / count(*), 4) AS pct, round(avg(after), 6) AS avg_k FROM k GROUP BY 1""")
def link_profile(spark, sf_dir):
    """Questions with and without articles by source, before and after a filter."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("before"), F.count_if(F.col("o_orderstatus") != "P").alias("after"))
    k = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("source")).join(o, "c_custkey", "left").na.fill(0, ["before", "after"])
    return k.groupBy("source").agg(F.count_if(F.col("before") > 0).alias("with_before"), F.count_if(F.col("after") > 0).alias("with_after"), F.count_if(F.col("after") == 0).alias("without_after"), F.round(100.0 * F.count_if(F.col("after") > 0) / F.count("*"), 4).alias("pct"), F.round(F.avg("after"), 6).alias("avg_k"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS pos FROM lineitem), h AS (SELECT * FROM r WHERE pos <= 6),
 u AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 9 ORDER BY pos) AS again FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, pos DESC) AS late FROM u WHERE again = 1)
 SELECT l_orderkey, string_agg(l_partkey % 9 || '@' || strftime(l_shipdate, '%Y-%m-%d'), ' ' ORDER BY l_shipdate, pos) AS block FROM k WHERE late <= 3 GROUP BY 1""")
def articles_block(spark, sf_dir):
    """Of the first 2 x 3 articles of a question those with a title of their own, the last three of them, in the order of time."""
    l = table(spark, sf_dir, "lineitem").withColumn("title", F.col("l_partkey") % 9)
    first = ranking.top_k(l, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")], 6, "pos")
    own = ranking.keep_first(first, ["l_orderkey", "title"], [F.col("pos")])
    last = ranking.top_k(own, ["l_orderkey"], [F.desc("l_shipdate"), F.desc("pos")], 3)
    piece = F.struct("l_shipdate", "pos", F.concat_ws("@", F.col("title").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("s"))
    return last.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["s"]), " ").alias("block"))


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '42'), o_orderkey LIMIT 100")
def seeded_sample(spark, sf_dir):
    """A hundred rows in the order of a hash with a seed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("42")).cast("binary")), "o_orderkey").limit(100)


@query("SELECT user_id, max(CAST(ts AS DATE)) AS resolved, row_number() OVER (ORDER BY max(CAST(ts AS DATE)), user_id) AS place FROM events GROUP BY 1 ORDER BY resolved, user_id LIMIT 50")
def by_resolution(spark, sf_dir):
    """The first fifty questions by the day of their resolution."""
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("resolved"))
    top = g.orderBy("resolved", "user_id").limit(50)
    return top.withColumn("place", F.row_number().over(W.orderBy("resolved", "user_id")))


@query("""WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS w FROM part) SELECT a.p_partkey, array_to_string(list_sort(list_intersect(a.w, b.w)), ' ') AS shared, len(list_intersect(a.w, b.w)) > 0 AS overlap, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS title_overlap FROM w a JOIN w b ON b.p_partkey = a.p_partkey + 1""")
def set_intersections(spark, sf_dir):
    """Words that neighbouring titles share, and their overlap."""
    w = table(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.split("p_name", " ")).alias("w"))
    j = w.join(w.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("w").alias("v")), "p_partkey")
    return j.select("p_partkey", F.array_join(F.array_sort(F.array_intersect("w", "v")), " ").alias("shared"), F.arrays_overlap("w", "v").alias("overlap"), F.round(texts.jaccard(F.col("w"), F.col("v")), 6).alias("title_overlap"))


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, count_if(CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) + 90) AS late, count(DISTINCT l_suppkey % 10) AS domains, sum(l_quantity) AS mass, any_value(o_orderstatus) AS st FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
 SELECT l_orderkey, CASE WHEN n < 3 THEN 'links' WHEN late > 0.2 * n THEN 'horizon' WHEN domains < 2 THEN 'domains' WHEN mass < 60 THEN 'mass' WHEN st = 'P' THEN 'open' ELSE 'selected' END AS outcome FROM g""")
def gold_tolerance(spark, sf_dir):
    """An ordered selection in which up to a fifth of a question's articles may be late."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.date_add(F.col("o_orderdate").cast("date"), 90).alias("t"))
    l = table(spark, sf_dir, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    g = l.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_shipdate").cast("date") > F.col("t")).alias("late"), F.count_distinct(F.col("l_suppkey") % 10).alias("domains"), F.sum("l_quantity").alias("mass"), F.first("o_orderstatus").alias("st"))
    checks = [("links", F.col("n") < 3), ("horizon", F.col("late") > 0.2 * F.col("n")), ("domains", F.col("domains") < 2), ("mass", F.col("mass") < 60), ("open", F.col("st") == "P")]
    return g.select("l_orderkey", cascade.first_reason(checks, "selected").alias("outcome"))


@query("""SELECT lang, count(*) AS requests, CAST(sum(n_chars // 4) AS BIGINT) AS tokens, round(sum(n_chars // 4) * 0.15 / 1e6 + count(*) * 300 * 0.6 / 1e6, 8) AS cost, round((sum(n_chars // 4) * 0.15 / 1e6 + count(*) * 300 * 0.6 / 1e6) / 2, 8) AS batch_cost FROM documents GROUP BY 1""")
def cost_estimate(spark, sf_dir):
    """What asking about every text would cost, by prices a million tokens; in batches half of it."""
    cost = F.sum(F.floor(F.col("n_chars") / 4)) * 0.15 / 1e6 + F.count("*") * 300 * 0.6 / 1e6
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("requests"), F.sum(F.floor(F.col("n_chars") / 4)).alias("tokens"), F.round(cost, 8).alias("cost"), F.round(cost / 2, 8).alias("batch_cost"))
