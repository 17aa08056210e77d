"""Audits: histograms, percentiles, shares, rates, duplicates, timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, texts
from ..operators import ranking
from .registry import query, table


@query("SELECT CASE WHEN n_chars < 100 THEN '<100' WHEN n_chars < 500 THEN '<500' WHEN n_chars < 2000 THEN '<2000' ELSE '>=2000' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def bucket_hist(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(ranking.bucket(F.col("n_chars"), [100, 500, 2000]).alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
 SELECT source, max(n_chars) FILTER (i = floor(n * 0.5)) AS p50, max(n_chars) FILTER (i = floor(n * 0.9)) AS p90, max(n_chars) FILTER (i = floor(n * 0.95)) AS p95 FROM r GROUP BY 1""")
def nearest_rank(spark, sf_dir):
    """Exact percentiles by position, not interpolated."""
    d = table(spark, sf_dir, "documents").select("source", "n_chars")
    p50, p90, p95 = (ranking.nearest_rank(d, ["source"], "n_chars", q, n) for q, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95")))
    return p50.join(p90, "source").join(p95, "source")


@query("""WITH r AS (SELECT o_orderpriority, n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n) AS i FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL))
 SELECT o_orderpriority, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM r GROUP BY 1""")
def gini(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    return ranking.gini(c, ["o_orderpriority"], "n").select("o_orderpriority", F.round("gini", 6).alias("gini"))


@query("SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, round(median(n_chars), 4) AS median_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars FROM documents GROUP BY 1")
def source_profile(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.median("n_chars"), 4).alias("median_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def month_timeline(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, CAST(max(CAST(l_shipdate AS DATE)) - min(CAST(l_shipdate AS DATE)) AS INT) AS spread FROM lineitem GROUP BY 1 HAVING count(DISTINCT CAST(l_shipdate AS DATE)) >= 2")
def day_spread(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).alias("spread"), F.countDistinct(F.col("l_shipdate").cast("date")).alias("days"))
    return g.filter("days >= 2").select("l_orderkey", "spread")


@query("""SELECT coalesce(l.toxic, -1) AS toxic, CASE WHEN n_chars < 500 THEN '<500' ELSE '>=500' END AS bucket, count(*) AS n, round(count(*) FILTER (quality = 0) / count(*), 6) AS error_rate FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL""")
def error_rates(spark, sf_dir):
    """A rate whose denominator is all rows of the bucket."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy(F.coalesce("toxic", F.lit(-1)).alias("toxic"), ranking.bucket(F.col("n_chars"), [500]).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("quality") == 0) / F.count("*"), 6).alias("error_rate"))


@query("SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY lang, source")
def share_per_group(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return g.join(g.groupBy("lang").agg(F.sum("n").alias("all")), "lang").select("lang", "source", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(count(*) / count(DISTINCT user_id), 6) AS per_user FROM events GROUP BY 1")
def per_source_rate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.count("*") / F.countDistinct("user_id"), 6).alias("per_user"))


@query("SELECT n_facts, count(*) AS n_articles FROM (SELECT conv_id, count(*) AS n_facts FROM conversations GROUP BY 1) GROUP BY 1")
def density_histogram(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_facts")).groupBy("n_facts").agg(F.count("*").alias("n_articles"))


@query("""SELECT count_if(l_shipdate IS NULL) AS undated, count_if(CAST(l_shipdate AS DATE) > DATE '1998-06-01') AS future, count_if(CAST(l_shipdate AS DATE) < DATE '1998-06-01' - 365) AS old FROM lineitem""")
def date_sanity(spark, sf_dir):
    day, now = F.col("l_shipdate").cast("date"), F.lit("1998-06-01").cast("date")
    return table(spark, sf_dir, "lineitem").agg(F.count_if(day.isNull()).alias("undated"), F.count_if(day > now).alias("future"), F.count_if(day < F.date_sub(now, 365)).alias("old"))


@query("SELECT array_to_string(list_sort(list_distinct(list(event_type))), '|') AS combo, count(*) OVER () * 0 + 1 AS one FROM events GROUP BY user_id")
def provenance_combos(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("combo"))
    return c.select("combo", F.lit(1).cast("long").alias("one"))


@query("SELECT role, CAST(sum(floor(length(text) / 4)) AS BIGINT) AS tokens, count(*) AS n FROM conversations GROUP BY 1")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(texts.n_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(2 * l_discount - 0.1))), 6) AS calibrated, round(exp(-0.05 * abs(l_quantity)), 6) AS decayed, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.6 ELSE 0.5 END AS confidence FROM lineitem")
def score_maps(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", F.round(scores.sigmoid(F.col("l_discount"), 2.0, -0.1), 6).alias("calibrated"), F.round(scores.decay(F.col("l_quantity"), 0.05), 6).alias("decayed"), scores.words_to_number(F.col("l_returnflag"), {"a": 1.0, "n": 0.6}, 0.5).alias("confidence"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'steel ' || p_brand WHEN p_partkey % 3 = 1 THEN lower(p_brand) ELSE 'the ' || lower(p_brand) END IS NOT NULL AS named, lower(p_brand) AS company FROM part""")
def company_names(spark, sf_dir):
    """Corporate endings and the article are stripped."""
    dressed = F.element_at(F.array(F.concat(F.lit("The "), F.col("p_brand"), F.lit(" Holdings Inc.")), F.concat(F.col("p_brand"), F.lit(" Corp.")), F.concat(F.col("p_brand"), F.lit(" International Ltd."))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", dressed.isNotNull().alias("named"), texts.company(dressed).alias("company"))
