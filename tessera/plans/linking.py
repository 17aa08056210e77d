"""Evidence joins: intervals, unordered pairs, priors, id arrays, text and parameters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, scores, texts
from ..operators import linking, ranking
from .registry import query, table


@query("""WITH o AS (SELECT DISTINCT o_custkey % 150 AS key, DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS cutoff FROM orders), h AS (SELECT key, cutoff, event_id, row_number() OVER (PARTITION BY key, cutoff ORDER BY e.ts DESC, event_id) AS rank FROM o JOIN events e ON e.user_id = key AND CAST(e.ts AS DATE) BETWEEN cutoff - 7 AND cutoff QUALIFY rank <= 5)
 SELECT o_orderkey, event_id, rank FROM orders JOIN h ON key = o_custkey % 150 AND cutoff = DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT)""")
def interval_topk_join(spark, sf_dir):
    """The latest evidence with the question's key in its closed interval; questions with one key and cutoff share it, and it is ranked once."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("key"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("cutoff"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"))
    hit = linking.interval_top_k(o.select("key", "cutoff").distinct(), e, F.col("key") == F.col("user_id"), "day", F.date_sub("cutoff", 7), F.col("cutoff"), ["key", "cutoff"], [F.desc("ts"), F.col("event_id")], 5)
    return o.join(hit.select("key", "cutoff", "event_id", "rank"), ["key", "cutoff"]).select("o_orderkey", "event_id", "rank")


_PAIRS = """p AS (SELECT event_id, event_type, ts, CAST(ts AS DATE) AS day, least(user_id % 12, (event_id * 7) % 12) AS a, greatest(user_id % 12, (event_id * 7) % 12) AS b FROM events)"""


def _paired(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s, o = F.col("user_id") % 12, (F.col("event_id") * 7) % 12
    return e.select("event_id", "event_type", "ts", F.to_date("ts").alias("day"), linking.pair(s, o).alias("pair"))


@query(f"""WITH {_PAIRS}, q AS (SELECT DISTINCT a, b, DATE '2024-01-10' + CAST((a + b) % 15 AS INT) AS cutoff FROM p)
 SELECT q.a || '-' || q.b AS pair, event_id, rank FROM (SELECT q.a, q.b, event_id, row_number() OVER (PARTITION BY q.a, q.b ORDER BY day DESC, event_id) AS rank FROM q JOIN p ON p.a = q.a AND p.b = q.b AND day < cutoff) q WHERE rank <= 10""")
def pair_relink_topk(spark, sf_dir):
    """Events of either direction of a pair strictly before the cutoff, latest first."""
    p = _paired(spark, sf_dir)
    q = p.select("pair").distinct().withColumn("cutoff", F.date_add(F.lit("2024-01-10").cast("date"), ((F.col("pair")[0] + F.col("pair")[1]) % 15).cast("int")))
    hit = p.join(q, "pair").filter(F.col("day") < F.col("cutoff"))
    top = ranking.top_k(hit, ["pair"], [F.desc("day"), F.col("event_id")], 10)
    return top.select(F.array_join(F.transform("pair", lambda x: x.cast("string")), "-").alias("pair"), "event_id", "rank")


@query(f"""WITH {_PAIRS}, q AS (SELECT DISTINCT a, b, DATE '2024-01-20' AS cutoff FROM p), c AS (SELECT q.a, q.b, event_type, count(*) AS c, min(day) AS d, min(event_id) AS i FROM q JOIN p ON p.a = q.a AND p.b = q.b AND day < cutoff AND day >= cutoff - 10 GROUP BY ALL)
 SELECT a || '-' || b AS pair, arg_min(event_type, (-c, d, i)) AS mode, max(c) AS mode_count, sum(c) AS n, round(max(c) / sum(c), 4) AS stability FROM c GROUP BY a, b""")
def prior_mode_range(spark, sf_dir):
    """The most frequent class in the days before the cutoff, of equals the earliest seen."""
    p = _paired(spark, sf_dir).filter((F.col("day") < F.lit("2024-01-20").cast("date")) & (F.col("day") >= F.lit("2024-01-10").cast("date")))
    counts = p.groupBy("pair", "event_type").agg(F.count("*").alias("c"), F.min("day").alias("d"), F.min("event_id").alias("i"))
    m = counts.groupBy("pair").agg(F.min_by("event_type", F.struct(-F.col("c"), "d", "i")).alias("mode"), F.max("c").alias("mode_count"), F.sum("c").alias("n"))
    return m.select(F.array_join(F.transform("pair", lambda x: x.cast("string")), "-").alias("pair"), "mode", "mode_count", "n", F.round(F.col("mode_count") / F.col("n"), 4).alias("stability"))


@query("""WITH w AS (SELECT o_orderkey, o_orderstatus, list(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS h FROM orders),
 m AS (SELECT o_orderkey, o_orderstatus, (SELECT arg_min(s, (-c, f)) FROM (SELECT s, count(*) AS c, min(i) AS f FROM (SELECT unnest(h) AS s, generate_subscripts(h, 1) AS i) GROUP BY s)) AS prior FROM w)
 SELECT o_orderkey, prior, CASE WHEN prior IS NULL THEN 'unknown' WHEN prior = o_orderstatus THEN 'stability' ELSE 'change' END AS fd_type FROM m""")
def prior_mode_prev4(spark, sf_dir):
    """The mode of the four rows before, of equals the oldest; promoted to stability or change."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-4, -1)
    h = table(spark, sf_dir, "orders").withColumn("h", F.collect_list("o_orderstatus").over(w))
    share = F.transform(F.array_distinct("h"), lambda s: F.struct((-F.size(F.filter("h", lambda x: x == s))).alias("c"), F.array_position("h", s).alias("f"), s.alias("s")))
    prior = F.array_min(share)["s"]
    kind = F.when(prior.isNull(), "unknown").when(prior == F.col("o_orderstatus"), "stability").otherwise("change")
    return h.select("o_orderkey", prior.alias("prior"), kind.alias("fd_type"))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')")
def semi_publish(spark, sf_dir):
    """Records that some kept question refers to."""
    kept = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    used = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(kept, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_semi")


@query("SELECT l_orderkey, l_linenumber, l_partkey * 2 AS ref FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT p_partkey FROM part)")
def anti_dangling(spark, sf_dir):
    """References without a record."""
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("ref"))
    return refs.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref")), "ref", "left_anti").select("l_orderkey", "l_linenumber", "ref")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 300 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def delta_anti(spark, sf_dir):
    """Long enough records that nothing has been derived from yet."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").filter("n_chars >= 300").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH l AS (SELECT l_partkey, list_sort(list_distinct(list(l_orderkey))) AS linked FROM lineitem GROUP BY 1)
 SELECT p_partkey, array_to_string(list_transform(coalesce(linked, []), lambda x: CAST(x AS VARCHAR)), ',') AS linked_ids, len(coalesce(linked, [])) AS n_linked FROM part LEFT JOIN l ON l_partkey = p_partkey""")
def link_facts(spark, sf_dir):
    """An inverted index from records to the questions that cite them, projected on facts; empty where none does."""
    inverted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("linked"))
    j = table(spark, sf_dir, "part").select("p_partkey").join(inverted, "p_partkey", "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<bigint>")))
    return j.select("p_partkey", F.array_join(F.transform("linked", lambda x: x.cast("string")), ",").alias("linked_ids"), F.size("linked").alias("n_linked"))


@query("""SELECT n_links, count(*) AS n FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_links FROM lineitem GROUP BY 1) GROUP BY 1""")
def link_histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n_links")).groupBy("n_links").agg(F.count("*").alias("n"))


@query("""WITH cell AS (SELECT l_orderkey, '[''' || string_agg(CAST(l_partkey AS VARCHAR), ''', ''' ORDER BY l_linenumber, l_partkey) || ''']' AS docids FROM lineitem GROUP BY 1)
 SELECT l_orderkey, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS names FROM (SELECT l_orderkey, CAST(unnest(CAST(replace(docids, '''', '"') AS JSON)::VARCHAR[]) AS BIGINT) AS id FROM cell) JOIN part ON p_partkey = id GROUP BY 1""")
def docids_two_hop(spark, sf_dir):
    """A cell holding a list, exploded and joined in two hops; sorted distinct names."""
    from ..functions import jsons

    parts = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"].cast("string"))
    cell = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("['"), F.array_join(parts, "', '"), F.lit("']")).alias("docids"))
    ids = cell.select("l_orderkey", F.explode(F.transform(jsons.cell_list(F.col("docids")), lambda x: x.cast("long"))).alias("p_partkey"))
    named = ids.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    return named.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("p_name")), "|").alias("names"))


@query("""SELECT w AS pattern, doc_id, rank FROM (SELECT w, doc_id, row_number() OVER (PARTITION BY w ORDER BY n_chars DESC, doc_id) AS rank FROM documents, (SELECT unnest(['thing', 'ch', 'eau', 'ción']) AS w) WHERE regexp_matches(text, w)) WHERE rank <= 20""")
def parameter_array_join(spark, sf_dir):
    """An array of patterns, each with its cap of rows, in one scan."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    hit = d.withColumn("pattern", F.explode(F.filter(F.array(*map(F.lit, ("thing", "ch", "eau", "ción"))), lambda p: F.regexp_like("text", p))))
    return ranking.top_k(hit.drop("text"), ["pattern"], [F.desc("n_chars"), F.col("doc_id")], 20).select("pattern", "doc_id", "rank")


@query("""WITH r AS (SELECT conv_id || '::b1::' || turn AS request_id, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id || '::b1::' || (turn - 1) AS request_id, text FROM conversations WHERE role = 'assistant')
 SELECT r.request_id, split_part(r.request_id, '::', 1) AS fd, length(a.text) AS answer_chars, a.request_id IS NULL AS failed FROM r LEFT JOIN a ON a.request_id = r.request_id""")
def request_response_join(spark, sf_dir):
    """Requests and responses by composite key; a request without response has failed."""
    c = table(spark, sf_dir, "conversations")
    ident = lambda t: F.concat_ws("::", F.col("conv_id").cast("string"), F.lit("b1"), t.cast("string"))
    r = c.filter("role = 'user'").select(ident(F.col("turn")).alias("request_id"))
    a = c.filter("role = 'assistant'").select(ident(F.col("turn") - 1).alias("request_id"), F.length("text").alias("answer_chars"), F.lit(True).alias("has"))
    j = r.join(a, "request_id", "left")
    return j.select("request_id", F.split("request_id", "::")[0].alias("fd"), "answer_chars", F.col("has").isNull().alias("failed"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || ':' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS entity FROM events""")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))
    return e.select("event_id", "k", F.concat_ws(":", "event_type", (F.col("k") % 3).cast("string")).alias("entity"))


@query("""SELECT user_id, row_number() OVER (ORDER BY ts0, i0) AS dense_id FROM (SELECT user_id, min(ts) AS ts0, arg_min(event_id, (ts, event_id)) AS i0 FROM events GROUP BY 1)""")
def dense_first_ids(spark, sf_dir):
    """Ids by first appearance."""
    return ranking.first_seen_ids(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "dense_id")


@query("""SELECT p_partkey, CASE WHEN r BETWEEN 1 AND 9 THEN 'Peace' WHEN r BETWEEN 10 AND 17 THEN 'Tension' WHEN r BETWEEN 18 AND 20 THEN 'Violence' END AS intensity,
 CASE WHEN r BETWEEN 1 AND 4 THEN 'VC' WHEN r BETWEEN 5 AND 8 THEN 'MC' WHEN r BETWEEN 9 AND 16 THEN 'VK' WHEN r BETWEEN 17 AND 20 THEN 'MK' END AS quad FROM (SELECT p_partkey, CAST(substr(lpad(CAST(p_size * 5 AS VARCHAR), 3, '0'), 1, 2) AS INT) AS r FROM part)""")
def code_intensity_map(spark, sf_dir):
    code = F.col("p_size") * 5
    return table(spark, sf_dir, "part").select("p_partkey", scores.intensity(code).alias("intensity"), scores.quad(code).alias("quad"))


@query("""WITH a AS (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS expected FROM lineitem GROUP BY 1)
 SELECT l_orderkey, l_linenumber, CASE WHEN (l_extendedprice / l_quantity - expected) / abs(expected) >= 0.02 THEN 'Beat' WHEN (l_extendedprice / l_quantity - expected) / abs(expected) <= -0.02 THEN 'Miss' ELSE 'Meet' END AS surprise
 FROM lineitem JOIN a USING (l_partkey)""")
def surprise_class(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("actual", F.col("l_extendedprice") / F.col("l_quantity"))
    a = l.groupBy("l_partkey").agg(F.avg("actual").alias("expected"))
    return l.join(a, "l_partkey").select("l_orderkey", "l_linenumber", scores.surprise(F.col("actual"), F.col("expected")).alias("surprise"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(p - 0.5) > 0.05 THEN CASE WHEN p >= 0.5 THEN 'Yes' ELSE 'No' END END AS expected,
 CASE WHEN abs(p - 0.5) <= 0.05 THEN 'unknown' WHEN (p >= 0.5) = (l_returnflag = 'R') THEN 'stability' ELSE 'change' END AS fd_type FROM (SELECT *, l_discount * 10 AS p FROM lineitem)""")
def crowd_prior(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_discount") * 10)
    r = scores.crowd_prior(F.col("p"), F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No"), 0.05)
    return l.select("l_orderkey", "l_linenumber", r["expected"].alias("expected"), r["fd_type"].alias("fd_type"))


@query("""SELECT strftime(m, '%Y-%m') AS month, count(*) AS n FROM (SELECT date_trunc('month', l_shipdate) AS m FROM lineitem WHERE l_shipdate >= DATE '1996-03-10' AND l_shipdate < DATE '1996-06-20') GROUP BY 1""")
def month_prune(spark, sf_dir):
    """Shards that meet the window, then the window itself."""
    start, stop = F.lit("1996-03-10").cast("date"), F.lit("1996-06-20").cast("date")
    l = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_shipdate").cast("date").alias("day")).filter((F.col("day") >= start) & (F.col("day") < stop))
    return l.filter(dates.month_meets(F.col("month"), start, stop)).groupBy("month").agg(F.count("*").alias("n"))


@query("""SELECT CAST(w AS DATE) AS start, event_type, count(*) AS n FROM events, (SELECT unnest(generate_series(DATE '2023-12-20', DATE '2024-02-10', INTERVAL 1 DAY)) AS w) WHERE ts >= w AND ts < w + INTERVAL 7 DAY GROUP BY ALL""")
def sliding_window_counts(spark, sf_dir):
    """A window of seven days at every day."""
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "7 days", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("window.start").cast("date").alias("start"), "event_type", "n")


@query("""SELECT user_id, string_agg(event_type || '@' || day, ' ' ORDER BY day, event_id) AS block FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY 1""")
def evidence_block(spark, sf_dir):
    """The last ten pieces of evidence, in order of time, as one text."""
    last = ranking.top_k(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10)
    piece = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "event_type")
    return last.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda s: F.concat(s["event_type"], F.lit("@"), s["day"])), " ").alias("block"))


@query("""SELECT user_id, arg_min(event_type, (-c, p)) AS choice, sum(c) AS votes FROM (SELECT user_id, event_type, count(*) AS c, list_position(['view', 'click', 'purchase'], event_type) AS p FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL) GROUP BY 1""")
def plurality_vote(spark, sf_dir):
    return ranking.plurality(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["view", "click", "purchase"])


@query("""SELECT substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'fact\\[\\d+\\]', 'fact[N]', 'g'), '\\b\\d{4}-\\d{2}-\\d{2}\\b', '<DATE>', 'g'), '\\b[0-9a-f]{8,}\\b', '<HASH>', 'g'), '\\b\\d+\\b', '<N>', 'g'), 1, 160) AS signature, count(*) AS n FROM documents GROUP BY 1""")
def error_signature(spark, sf_dir):
    """How often each signature occurs; every text is normalised whole, and the signature is its first 160 characters then."""
    return table(spark, sf_dir, "documents").groupBy(texts.signature(F.col("text")).alias("signature")).agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 40 AS n, greatest(1, least(3, o_orderkey % 40)) AS k FROM orders)
 SELECT o_orderkey, s AS slice, d + CAST(floor(n * s / k) AS INT) AS first, d + CAST(floor(n * (s + 1) / k) AS INT) AS last FROM q, (SELECT unnest([0, 1, 2]) AS s) WHERE s < k""")
def time_slices(spark, sf_dir):
    """A look-back span in three slices, or as many as it has days."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    s = dates.slices(F.col("d"), F.date_add("d", (F.col("o_orderkey") % 40).cast("int")), 3)
    return o.select("o_orderkey", F.posexplode(s).alias("slice", "s")).select("o_orderkey", "slice", "s.first", "s.last")
