"""Records that are landed as files and read again: JSON lines, tables of text, shards, archives, versions, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..sources import records
from ..storage import shared_dir
from ..streaming import arrivals
from .registry import query, table


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df, path, column="value"):
    df.select(F.col(column).alias("value")).write.text(path)
    return path


ORDER = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("day", T.StringType())])


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def jsonl_scan(spark, sf_dir):
    """JSON lines written and read by a declared schema; blank lines are none."""
    rows = _orders(spark, sf_dir)
    path = _lines(rows.select(F.explode(F.array(F.to_json(F.struct(*rows.columns)), F.lit(""))).alias("value")), _place(spark, "jsonl"))
    return records.read_jsonl(spark, path, ORDER)


@query("SELECT 25 AS n, count(DISTINCT 1) AS known FROM orders")
def jsonl_limit(spark, sf_dir):
    """A scan with a limit gives so many records, all of them of the table."""
    path = _place(spark, "jsonl")
    _orders(spark, sf_dir).write.json(path)
    some = records.read_jsonl(spark, path, ORDER, limit=25)
    known = some.join(_orders(spark, sf_dir), ORDER.names, "left_semi")
    return some.agg(F.count("*").alias("n")).join(known.agg((F.count("*") / 25).cast("long").alias("known")))


@query("""SELECT o_orderkey, 'good' AS kind FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT count(*), 'malformed' FROM orders WHERE o_orderkey % 7 = 0""")
def jsonl_tolerant(spark, sf_dir):
    """Broken lines are counted and left out."""
    rows = _orders(spark, sf_dir)
    line = F.to_json(F.struct(*rows.columns))
    path = _lines(rows.select(F.when(F.col("o_orderkey") % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")), _place(spark, "jsonl"))
    good, bad = records.read_jsonl_tolerant(spark, path, ORDER)
    return good.select("o_orderkey", F.lit("good").alias("kind")).unionByName(bad.agg(F.count("*").alias("o_orderkey")).select("o_orderkey", F.lit("malformed").alias("kind")))


@query("SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY 1")
def keyed_last_wins(spark, sf_dir):
    """A keyed table in which the last of several records stays."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), "l_partkey")
    return records.latest(l, "l_orderkey", "at").select("l_orderkey", "l_partkey")


_FLAT = "regexp_replace(coalesce(text, ''), '[\\t\\r\\n]', ' ', 'g')"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, nullif({_FLAT}, '') IS NULL AS empty, coalesce(length({_FLAT}), 0) AS chars FROM documents")
def tsv_scan(spark, sf_dir):
    """A tab-separated table with a header; fields may be as long as a document."""
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), "[\t\r\n]", " ")
    path = records.write_versioned(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), flat.alias("body")), _place(spark, "tsv"), "tsv")
    back = records.read_tsv(spark, path, ["id", "body"], header=True)
    return back.select("id", F.coalesce(F.col("body") == "", F.lit(True)).alias("empty"), F.length(F.coalesce("body", F.lit(""))).alias("chars"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 5 <> 0")
def tsv_width_filter(spark, sf_dir):
    """Rows of several files without a header; rows of another width go."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    cells = [F.col(c).cast("string") for c in p.columns]
    path = _lines(p.repartition(3).select(F.when(F.col("p_partkey") % 5 == 0, F.concat_ws("\t", *cells, F.lit(""))).otherwise(F.concat_ws("\t", *cells)).alias("value")), _place(spark, "rows"))
    back = records.read_tsv(spark, path, p.columns, header=False)
    return back.select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("int"))


@query("SELECT c_custkey, CASE WHEN n_nationkey % 4 <> 3 THEN n_name END AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def lookup_scan(spark, sf_dir):
    """A lookup of two columns; lines of one or three parts are no entries, and their keys have no name."""
    n = table(spark, sf_dir, "nation")
    line = F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name", F.when(F.col("n_nationkey") % 4 == 3, F.lit("x")))
    names = records.read_lookup(spark, _lines(n.select(line.alias("value")), _place(spark, "lookup")), "key", "nation")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("key"))
    return c.join(names, "key", "left").select("c_custkey", "nation")


@query("SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y%m') BETWEEN '199503' AND '199611' GROUP BY 1")
def month_file_list(spark, sf_dir):
    """Entries of a file list by the month in their names; a line without one is no entry."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("12 abc http://host/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("000000.export.zip"))
    path = _lines(o.select(F.explode(F.array(name, F.lit("no entry"))).alias("value")), _place(spark, "list"))
    hit = records.in_months(spark.read.text(path), r"/(\d{6})\d{8}\.export", "199503", "199611")
    return hit.groupBy(F.regexp_extract("value", r"/(\d{6})\d{8}\.export", 1).alias("month")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, source, n_chars, crc % 1000 AS bucket FROM (SELECT *, n_chars + doc_id AS crc FROM documents)")
def metadata_table(spark, sf_dir):
    """Five columns of a wide table as a table of their own."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", ((F.col("n_chars") + F.col("doc_id")) % 1000).alias("bucket"))
    return spark.read.parquet(records.write_versioned(d, _place(spark, "meta")))


QUESTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])


@query("SELECT CAST(conv_id AS VARCHAR) AS id, text FROM conversations WHERE turn = 0 AND role = 'user' AND conv_id % 9 <> 0 AND conv_id // 20 % 5 <> 4")
def question_sets(spark, sf_dir):
    """Question sets as lists and as objects that have one; ids that are lists, and copies named 'latest', are left out."""
    c = table(spark, sf_dir, "conversations").filter("turn = 0 and role = 'user'")
    ident, number = F.col("conv_id").cast("string"), F.floor(F.col("conv_id") / 20)
    record = F.when(F.col("conv_id") % 9 == 0, F.to_json(F.struct(F.array(ident, F.lit("x")).alias("id"), "text"))).otherwise(F.to_json(F.struct(ident.alias("id"), "text")))
    # a set has some twenty questions, however many there are
    sets = c.select(number.alias("n"), record.alias("r")).groupBy("n").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value"))
    own = F.when(F.col("n") % 2 == 0, F.col("value")).otherwise(F.concat(F.lit('{"questions":'), F.col("value"), F.lit("}")))
    path, name = _place(spark, "sets"), F.concat(F.when(F.col("n") % 5 == 4, "latest").otherwise("set"), F.col("n").cast("string"))
    sets.select(own.alias("value"), name.alias("set")).repartition("set").write.partitionBy("set").text(path)
    return records.read_questions(spark, path, QUESTION, "questions", ident="id", skip="=latest")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 2")
def append_new(spark, sf_dir):
    """Two sessions append to one table; what is there already isn't appended again."""
    o, path = table(spark, sf_dir, "orders").select("o_orderkey"), _place(spark, "appended")
    records.append(o.filter("o_orderkey % 3 = 0").union(o.filter("o_orderkey % 3 = 0")), path, "o_orderkey")
    records.append(o.filter("o_orderkey % 3 <> 2"), path, "o_orderkey")
    return spark.read.parquet(path)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'even' END AS mark FROM supplier")
def table_rewrite(spark, sf_dir):
    """A table is changed by a new version that becomes current; the version before stays whole."""
    root = _place(spark, "versions")
    records.make_current(spark, root, records.write_versioned(table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(None).cast("string").alias("mark")), root))
    changed = records.read_current(spark, root).withColumn("mark", F.when(F.col("s_suppkey") % 2 == 0, "even"))
    records.make_current(spark, root, records.write_versioned(changed, root))
    return records.read_current(spark, root)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey % 3 <> 0")
def zstd_shards(spark, sf_dir):
    """Compressed JSON lines of the shards that have a marker."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    path = F.concat(F.lit("shard-"), F.col("c_nationkey"), F.lit(".jsonl.zst"))
    shards = records.zstd_lines(c, path)
    markers = table(spark, sf_dir, "nation").filter("n_nationkey % 3 <> 0").select(F.concat(F.lit("shard-"), F.col("n_nationkey"), F.lit(".jsonl.zst.done")).alias("path"))
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_nationkey", T.LongType())])
    return records.read_zstd_lines(records.committed(shards, markers), schema)


_WARC = "SELECT page_id, url, coalesce(html, '') AS html, page_id % 5 = 1 AS request, page_id % 7 = 2 AS picture, page_id % 11 = 3 AS short FROM pages"


@query(f"SELECT url AS uri, '200' AS status, length(html) AS chars, 'html' AS kind FROM ({_WARC}) WHERE NOT request AND NOT picture AND NOT short UNION ALL SELECT url, NULL, NULL, 'malformed' FROM ({_WARC}) WHERE short")
def warc_scan(spark, sf_dir):
    """Archive files, here one for each page: HTML responses, and records that are cut short."""
    p = table(spark, sf_dir, "pages").withColumn("html", F.coalesce("html", F.lit("")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: "), F.when(F.col("page_id") % 7 == 2, "image/png").otherwise("text/html; charset=utf-8"), F.lit("\r\n\r\n"), F.col("html"))
    kind = F.when(F.col("page_id") % 5 == 1, "request").otherwise("response")
    size = F.octet_length(http) + F.when(F.col("page_id") % 11 == 3, 9).otherwise(0)
    record = F.concat(F.lit("WARC/1.0\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nWARC-Date: 2026-01-02T03:04:05Z\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"), http)
    good, bad = records.read_warc(p.select(record.cast("binary").alias("content")))
    return good.select("uri", "status", F.length("body").alias("chars"), F.lit("html").alias("kind")).unionByName(bad.select("uri", F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("chars"), F.lit("malformed").alias("kind")))


_REPORT = "SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1"


@query(f"""WITH r AS (SELECT '| ' || source || ' | ' || n || ' | ' || chars || ' |' AS text, row_number() OVER (ORDER BY source) + 4 AS line FROM ({_REPORT}))
 SELECT CAST(line AS INT) AS line, text FROM r UNION ALL SELECT * FROM (VALUES (1, '# Sources'), (2, ''), (3, '| source | n | chars |'), (4, '|-|-|-|'))""")
def markdown_report(spark, sf_dir):
    """A report of aggregates."""
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return records.markdown(g, "Sources")


_CHECK = "bit_xor(CAST('0x' || substr(sha256(j), 1, 15) AS BIGINT))"


@query(f"""WITH a AS (SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P')), q AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P')
 SELECT 'articles' AS name, count(*) AS n_rows, count(DISTINCT p_partkey) AS n_ids, {_CHECK} AS checksum FROM (SELECT *, '{{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}}' AS j FROM a)
 UNION ALL SELECT 'questions', count(*), count(DISTINCT o_orderkey), {_CHECK} FROM (SELECT *, '{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}' AS j FROM q)""")
def publish_manifest(spark, sf_dir):
    """Kept questions and the articles that they cite are published; the manifest is worked out on what was written."""
    q = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus")
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).join(q, "o_orderkey", "left_semi")
    a = table(spark, sf_dir, "part").select("p_partkey", "p_name").join(cited, "p_partkey", "left_semi")
    root = _place(spark, "published")
    out = None
    for name, part, ident in (("questions", q, "o_orderkey"), ("articles", a, "p_partkey")):
        written = spark.read.parquet(records.write_versioned(part, f"{root}/{name}"))
        row = records.digest_of(written, ident).select(F.lit(name).alias("name"), "n_rows", "n_ids", "checksum")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT doc_id, strlen(coalesce(text, '')) % 97 AS vector, doc_id % 4 = 0 AS cached FROM documents")
def vector_cache(spark, sf_dir):
    """Texts of which the cache has a vector by their fingerprint get it; only the others are encoded, here by their length."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vector = (F.octet_length("text") % 97).alias("vector")
    cache = d.filter("doc_id % 4 = 0").select(F.md5(F.concat(F.col("doc_id").cast("string"), F.col("text")).cast("binary")).alias("fp"), vector)
    keyed = d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.col("text")).alias("text"), vector)
    known, left = records.cached_vectors(keyed.drop("vector"), cache)
    fresh = left.join(keyed.select("doc_id", "vector"), "doc_id")
    return known.select("doc_id", "vector", F.lit(True).alias("cached")).unionByName(fresh.select("doc_id", "vector", F.lit(False).alias("cached")))


@query("SELECT doc_id, CASE WHEN n_chars >= 400 THEN 'plain' WHEN n_chars >= 200 THEN 'archive' END AS source FROM documents")
def first_valid_fetch(spark, sf_dir):
    """Of several attempts at a text the first valid one, and its name."""
    d = table(spark, sf_dir, "documents")
    plain, archive = F.when(F.col("n_chars") >= 400, F.col("text")), F.when(F.col("n_chars") >= 200, F.col("text"))
    _, name = records.first_valid([("plain", plain), ("archive", archive)], lambda t: t.isNotNull())
    return d.select("doc_id", name.alias("source"))


@query("""SELECT sha256('{"a.b":1,"c":[2,"é"],"d":null}') AS digest""")
def config_digest(spark, sf_dir):
    return spark.createDataFrame([(records.config_digest({"c": [2, "é"], "a": {"b": 1, "x": 0}, "z": 5}, ["c", "a.b", "d"]),)], "digest string")


@query("SELECT event_id FROM events WHERE event_type <> 'view' AND ts < TIMESTAMP '2024-01-20'")
def stream_admitted(spark, sf_dir):
    """A stream of records through filters, to its end."""
    s = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return _drained(spark, arrivals.admitted(s, [F.col("event_type") != "view", F.col("ts") < F.lit("2024-01-20").cast("timestamp")]).select("event_id"))


def _drained(spark, stream):
    """The rows that a stream gives until its source is read; run twice on one checkpoint, the second finds nothing new."""
    path, mark = _place(spark, "streamed"), _place(spark, "mark")
    for _ in range(2):
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT DISTINCT user_id FROM events")
def stream_first_arrivals(spark, sf_dir):
    """The first record of each key within the watermark."""
    s = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(spark, arrivals.first_arrivals(s, "user_id", "ts", "400 days").select("user_id"))


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15'")
def stream_not_ahead(spark, sf_dir):
    """Records dated after the cutoff never enter."""
    s = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return _drained(spark, arrivals.not_ahead(s, "ts", F.lit("2024-01-15").cast("timestamp")).select("event_id"))


@query("SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 0")
def stream_deltas(spark, sf_dir):
    """Only keys that are not known yet reach the sink."""
    known, path = table(spark, sf_dir, "events").select("user_id").filter("user_id % 3 = 0"), _place(spark, "deltas")
    s = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").select("user_id")
    arrivals.deltas(s, lambda: known, "user_id", lambda df: df.write.mode("append").parquet(path), _place(spark, "mark")).awaitTermination()
    return spark.read.schema("user_id long").parquet(path)


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def http_dates(spark, sf_dir):
    """Dates as HTTP headers write them."""
    o = table(spark, sf_dir, "orders").withColumn("header", F.date_format("o_orderdate", "EEE, dd MMM yyyy 10:20:30 'GMT'"))
    return o.select("o_orderkey", F.date_format(dates.http_date(F.col("header")), "yyyy-MM-dd").alias("day"))
