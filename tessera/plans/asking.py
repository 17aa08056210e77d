"""Requests, rounds, responses and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsons
from ..operators import cascade, facts, linking, requests, rounds
from .registry import query, table


def _said(*parts: str) -> str:
    """The stand-in's choice among Yes and No, in SQL."""
    return f"CASE WHEN CAST('0x' || substr(md5({' || chr(10) || '.join(parts)}), 1, 6) AS BIGINT) % 2 = 0 THEN 'Yes' ELSE 'No' END"


def _answer(asked):
    return asked.select("request_id", rounds.answered(F.col("request_id"), F.col("prompt"), ["Yes", "No"]).alias("content"))


def _questions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("question"), F.concat(F.lit("Will "), "o_orderkey", F.lit(" be "), "o_orderstatus", F.lit("?")).alias("prompt"))


_Q = "q AS (SELECT o_orderkey AS question, 'Will ' || o_orderkey || ' be ' || o_orderstatus || '?' AS prompt FROM orders), s AS (SELECT unnest([0, 1, 2]) AS a)"
_JSON = "'{\"prediction\": \"' || said || '\"}'"
_VOTE = "count(*) FILTER (said = 'Yes') AS y, count(*) FILTER (said = 'No') AS n"


@query(f"""WITH c AS (SELECT o_orderkey AS question, o_orderkey || '::consistent::r1::' || s AS id FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)), p AS (SELECT question, CASE WHEN md5(id) < '4' THEN NULL ELSE {_said('id', "'p'")} END AS said FROM c), v AS (SELECT question, {_VOTE} FROM p GROUP BY 1)
 SELECT question, CASE WHEN y + n = 0 THEN NULL WHEN y >= n THEN 'Yes' ELSE 'No' END AS predicted_class, y + n = 0 AS parse_failed FROM v""")
def self_consistency(spark, sf_dir):
    """Five samples for each question, joined by key, parsed, and put to the vote; a quarter of the answers is broken."""
    asked = requests.build(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), requests.METHODS["consistent"], F.lit("p"))
    content = F.when(F.md5(F.col("request_id").cast("binary")) < "4", "{oops").otherwise(rounds.answered(F.col("request_id"), F.col("prompt"), ["Yes", "No"]))
    return requests.predictions(asked, asked.select("request_id", content.alias("content")), ["Yes", "No"], "plurality")


@query("""SELECT conv_id || '::consistent::r1::' || s AS request_id FROM conversations, (SELECT unnest([1, 2, 3, 4, 5]) AS s) WHERE turn = 0 AND (conv_id + s * conv_id) % 5 = 4""")
def pending_requests(spark, sf_dir):
    """What is still to be sent, where broken answers don't count."""
    q = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("id"))
    asked = requests.build(q, requests.METHODS["consistent"], F.lit("?"))
    n = F.pmod(F.col("question") + F.split("request_id", "::")[3].cast("long") * F.col("question"), F.lit(5))
    return requests.pending(asked, asked.filter(n != 4)).select("request_id")


@query(f"""WITH {_Q}, r0 AS (SELECT question, prompt, a, {_said("question || '::debate::r0::a' || a", "prompt")} AS said FROM q, s), p AS (SELECT question, prompt || chr(10) || string_agg('[a' || a || ']: ' || {_JSON}, chr(10) || chr(10) ORDER BY a) AS prompt FROM r0 GROUP BY question, r0.prompt),
 r1 AS (SELECT question, {_said("question || '::debate::r1::a' || a", "prompt")} AS said FROM p, s), v AS (SELECT question, {_VOTE} FROM r1 GROUP BY 1) SELECT question, CASE WHEN y >= n THEN 'Yes' ELSE 'No' END AS predicted_class, 6 AS n_requests FROM v""")
def debate_rounds(spark, sf_dir):
    """Three agents in two rounds; in the second each has the answers of all."""
    return rounds.run(_questions(spark, sf_dir), requests.METHODS["debate"], _answer, ["Yes", "No"])


@query(f"""WITH {_Q}, r0 AS (SELECT question, prompt, {_said("question || '::reflected::r0::a0'", "prompt")} AS said FROM q), r1 AS (SELECT question, prompt, {_said("question || '::reflected::r1::a0'", f"prompt || chr(10) || 'Before:' || chr(10) || {_JSON}")} AS said FROM r0),
 r2 AS (SELECT question, {_said("question || '::reflected::r2::a0'", f"prompt || chr(10) || 'Before:' || chr(10) || {_JSON}")} AS said FROM r1) SELECT question, said AS predicted_class, 5 AS n_requests FROM r2""")
def reflected_rounds(spark, sf_dir):
    """An answer, then twice a critique and a better one."""
    return rounds.run(_questions(spark, sf_dir), requests.METHODS["reflected"], _answer, ["Yes", "No"])


@query(f"""WITH {_Q}, r0 AS (SELECT question, prompt, a, {_said("question || '::branches::r0::a' || a", "prompt")} AS said FROM q, s), r1 AS (SELECT question, {_said("question || '::branches::r1::a' || r0.a || '.a' || s.a", f"prompt || chr(10) || 'Thought:' || chr(10) || {_JSON}")} AS said FROM r0, s),
 v AS (SELECT question, {_VOTE} FROM r1 GROUP BY 1) SELECT question, CASE WHEN y >= n THEN 'Yes' ELSE 'No' END AS predicted_class, 12 AS n_requests FROM v""")
def branch_rounds(spark, sf_dir):
    """Three thoughts, three more on each of them, and a vote of the nine."""
    return rounds.run(_questions(spark, sf_dir), requests.METHODS["branches"], _answer, ["Yes", "No"])


@query(f"""WITH l AS (SELECT DISTINCT l_orderkey AS question, l_linenumber AS n, min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS p FROM lineitem), q AS (SELECT DISTINCT l.question, 'Will ' || l.question || '?' AS prompt FROM l),
 c AS (SELECT question, string_agg('[p' || n || ']' || chr(10) || '- part ' || p, chr(10) || chr(10) ORDER BY 'p' || n) FILTER (p % 3 <> 0) AS peers, count(*) AS asked FROM l GROUP BY 1)
 SELECT question, {_said("question || '::claims::r1::a0'", "prompt || chr(10) || coalesce(peers, '(nothing found)')")} AS predicted_class, asked + 1 AS n_requests FROM q JOIN c USING (question)""")
def claims_rounds(spark, sf_dir):
    """A request for each question and article that extracts claims, then one with all of them."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    piece = F.struct(F.concat(F.lit("p"), "l_linenumber").alias("id"), F.concat(F.lit("part "), "p").alias("text"))
    q = l.groupBy(F.col("l_orderkey").alias("question")).agg(F.sort_array(F.collect_list(piece)).alias("pieces")).withColumn("prompt", F.concat(F.lit("Will "), "question", F.lit("?")))

    def call(asked):
        text = F.substring_index("prompt", "\n", -1)
        found = F.when(F.regexp_extract(text, r"(\d+)$", 1).cast("long") % 3 != 0, F.to_json(F.struct(F.array(text).alias("claims")))).otherwise('{"claims": []}')
        return asked.select("request_id", F.when(F.contains("request_id", F.lit("::r0::")), found).otherwise(rounds.answered(F.col("request_id"), F.col("prompt"), ["Yes", "No"])).alias("content"))

    return rounds.run(q, requests.METHODS["claims"], call, ["Yes", "No"])


@query("""SELECT * FROM (VALUES ('direct', 1, 1, 0, 'first'), ('debate5', 5, 2, 10, 'plurality'), ('claims', 1, 2, 4, 'first')) t(name, samples, rounds, evidence, combine)""")
def method_registry(spark, sf_dir):
    """Methods from a configuration: as they are, changed, and new ones like another."""
    found = rounds.from_config({"direct": {}, "debate5": {"like": "debate", "samples": 5}, "claims": {"evidence": 4}})
    return spark.createDataFrame([(m.name, m.samples, m.rounds, m.evidence, m.combine) for m in found.values()], "name string, samples int, rounds int, evidence int, combine string")


@query("SELECT o_orderkey AS question, o_orderstatus AS label, count(DISTINCT l_linenumber) AS n_evidence, string_agg(strftime(d, '%Y-%m-%d'), ' ' ORDER BY n) AS days FROM orders JOIN (SELECT l_orderkey, l_linenumber AS n, min(l_shipdate) AS d, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey GROUP BY ALL")
def evidence_queries(spark, sf_dir):
    """Questions in the evidence method's shape."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("day"))
    a = l.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.date_format("day", "yyyy-MM-dd").alias("date"), F.lit("t").alias("text"))
    ids = l.groupBy(F.col("l_orderkey").alias("question")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")))), lambda s: s["id"]).alias("ids"))
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question"), F.col("o_orderstatus").alias("label")).join(ids, "question")
    e = rounds.as_query(q, a, "ids")
    return e.select("question", "label", F.size("evidence").cast("long").alias("n_evidence"), F.array_join(F.transform("evidence", lambda x: x["date"]), " ").alias("days"))


@query("""SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'join' WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'scoped' ELSE 'fallback' END ELSE 'fallback' END AS mode FROM customer""")
def routed_retrieval(spark, sf_dir):
    """Each benchmark has its own way to evidence; one that finds nothing, and a benchmark without one, takes the general way."""
    q = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("benchmark"))
    contract = spark.createDataFrame([(0, "join"), (1, "scoped")], "benchmark int, mode string")
    plans = {"join": lambda d: d, "scoped": lambda d: d.filter("c_custkey % 2 = 0"), "fallback": lambda d: d}
    return requests.routed(q, contract, plans).select("c_custkey", "mode")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids, 4 AS chunks FROM orders")
def request_chunks(spark, sf_dir):
    """Every request is in one chunk, and there are as many chunks as their size asks for."""
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("request_id"))
    c = requests.chunks(r, -(-r.count() // 4))
    return c.agg(F.count("*").alias("n"), F.count_distinct("request_id").alias("ids"), F.count_distinct("chunk").alias("chunks"))


_STATED = """SELECT l_orderkey, l_linenumber, l_suppkey, l_linenumber % 7 AS k, CAST(o_orderdate AS DATE) AS pub, CAST(o_orderdate AS DATE) + CAST(l_suppkey % 40 AS INT) - 30 AS day, l_partkey % 4 = 0 AS told FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
_CANONICAL = "EXISTS (SELECT 1 FROM (SELECT unnest([0, 1, 2, 3, 7, 14, 30, 60, 90, 180, 365]) AS a) WHERE abs(pub - day - a) <= 1)"


def _stated(spark, sf_dir):
    """Answers with one dated fact, of which some are empty, broken or of another shape; a quarter of the articles has the day in it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("pub"))
    l = table(spark, sf_dir, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    day = F.date_format(F.date_add("pub", (F.col("l_suppkey") % 40 - 30).cast("int")), "yyyy-MM-dd")
    k = F.col("l_linenumber") % 7
    good = F.to_json(F.struct(F.array(F.struct(F.lit("it happened").alias("fact"), day.alias("time"))).alias("facts")))
    content = F.when(k == 0, "").when(k == 1, "not json").when(k == 2, F.to_json(F.struct(F.array(F.struct(F.lit("").alias("fact"), day.alias("time"))).alias("facts")))).otherwise(good)
    body = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("On "), day, F.lit(" it happened"))).otherwise("no day")
    return l.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey").alias("id"), F.date_format("pub", "yyyy-MM-dd").alias("publish_date"), body.alias("body"), content.alias("content"))


_OUTCOME = f"CASE k WHEN 0 THEN 'empty' WHEN 1 THEN 'json' WHEN 2 THEN 'schema' ELSE CASE WHEN day > pub THEN 'leak' WHEN NOT told AND NOT {_CANONICAL} THEN 'anchor' ELSE 'ok' END END"


@query(f"SELECT l_orderkey || ':' || l_linenumber || ':' || l_suppkey AS id, {_OUTCOME} AS outcome FROM ({_STATED})")
def fact_validation(spark, sf_dir):
    """Facts of a response, valid or with the first reason against them."""
    good, bad = facts.validated(_stated(spark, sf_dir))
    return good.select("id", F.lit("ok").alias("outcome")).unionByName(bad.select("id", F.col("reason").alias("outcome")))


@query(f"WITH x AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_suppkey AS id, {_OUTCOME} AS outcome FROM ({_STATED})) SELECT id FROM x WHERE outcome = 'anchor' AND id NOT IN (SELECT id FROM x WHERE outcome = 'ok')")
def fact_recovery(spark, sf_dir):
    """Facts that were only held against for their day come back, unless they are there already."""
    good, bad = facts.validated(_stated(spark, sf_dir))
    return facts.recovered(bad, good).select("id")


@query("""SELECT 'passes' AS kind, 'passed' AS word UNION ALL SELECT 'keeps all', 'nothing was dropped' UNION ALL SELECT 'is empty', 'nothing is left' UNION ALL SELECT 'breaks a rule', 'rules are broken'""")
def quality_gate(spark, sf_dir):
    """The gate on what a cascade leaves: rows, fewer than before, and none that breaks a rule."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    cases = {"passes": ("o_orderstatus <> 'P'", {}), "keeps all": ("true", {}), "is empty": ("false", {}), "breaks a rule": ("o_orderstatus <> 'P'", {"open": F.col("o_orderstatus") == "O"})}
    out = []
    for name, (kept, rules) in cases.items():
        try:
            cascade.gate(o.filter(kept), o, rules)
            out.append((name, "passed"))
        except AssertionError as e:
            out.append((name, str(e).split(":")[0]))
    return spark.createDataFrame(out, "kind string, word string")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS conf, strftime(l_shipdate, '%Y-%m-%d') AS t, l_orderkey * 10 + l_linenumber AS id FROM lineitem)
 SELECT l_orderkey AS fd_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY t DESC, CASE conf WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.3 END DESC, id, l_partkey) AS rank FROM f) WHERE rank <= 2""")
def indicator_rows(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    conf = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
    f = l.select(F.col("l_orderkey").alias("fd_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), conf.alias("extraction_confidence"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("time"))
    return facts.indicator_rows(f, 2).select("fd_id", "id", "rank")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 = 0 THEN 'source:blocked' WHEN l_returnflag = 'R' THEN 'confidence' WHEN l_linestatus = 'F' THEN 'polarity' WHEN d > p THEN 'future' WHEN p - d > 60 THEN 'age' END AS reason
 FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, CAST(l_shipdate AS DATE) AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""")
def fact_filter(spark, sf_dir):
    """The first check that a fact fails."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    source = F.when(F.col("l_suppkey") % 7 == 0, "www.Blocked.net").otherwise("paper.org")
    f = l.select("l_orderkey", "l_linenumber", source.alias("source"), F.when(F.col("l_returnflag") == "R", "low").otherwise("high").alias("extraction_confidence"), F.when(F.col("l_linestatus") == "F", "negated").otherwise("asserted").alias("polarity"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("time"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("article_date"))
    return f.select("l_orderkey", "l_linenumber", facts.reasons(source_block=("blocked",), confidence="medium", polarity="asserted", max_age=60).alias("reason"))


_REGION = "SELECT c_custkey, r_name, c_custkey % 7 AS k FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


@query(f"SELECT c_custkey, CASE WHEN k < 5 THEN r_name END AS pick FROM ({_REGION})")
def parse_pick(spark, sf_dir):
    """Choices from answers in several shapes; what names no hypothesis, or more than one, stays null."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "r_name")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))
    name, k = F.col("r_name"), F.col("c_custkey") % 7
    shapes = [F.to_json(F.struct(name.alias("prediction"))), F.to_json(F.struct(F.struct(F.concat(F.lower(name), F.lit(".")).alias("class")).alias("answer"))), F.to_json(F.struct(F.array(F.replace(F.lower(name), F.lit(" "), F.lit(""))).alias("choice"))), F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat(F.lit("Most likely: "), F.initcap(name)).alias("label"))), F.lit("\n```"))]
    shapes += [F.to_json(F.struct(F.concat(name, F.lit(", I think")).alias("final_answer"))), F.lit('{"x": 1}'), F.concat(F.lit("text "), name)]
    content = F.element_at(F.array(*shapes), (k + 1).cast("int"))
    hypotheses = F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")))
    return c.select("c_custkey", jsons.pick(content, hypotheses).alias("pick"))


_MENTIONS = """a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 4 WHEN 0 THEN 'Shares of ' || lower(n_name) || ' rose' WHEN 1 THEN 'The earnings of ' || upper(substr(n_name, 1, 4)) || ' beat' WHEN 2 THEN 'They saw ' || upper(substr(n_name, 1, 4)) || ' there' ELSE 'Earnings of X' || upper(substr(n_name, 1, 4)) || ' rose' END AS blob FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
 e AS (SELECT n_nationkey, lower(n_name) AS name, upper(substr(n_name, 1, 4)) AS ticker, DATE '1993-01-01' + n_nationkey * 30 AS first, DATE '1997-01-01' + n_nationkey * 10 AS last FROM nation)"""


@query(f"WITH {_MENTIONS} SELECT n_nationkey, o_orderkey FROM a JOIN e ON day >= first AND day < last AND (contains(lower(blob), name) OR (regexp_matches(blob, '\\b' || ticker || '\\b') AND regexp_matches(lower(blob), 'earnings|revenue|profit')))")
def text_contains_join(spark, sf_dir):
    """Articles of a company's window that have its name in them, or its ticker as a word beside a word of finance."""
    n = table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("n_nationkey") == F.col("c_nationkey"))
    ticker, k = F.upper(F.substring("n_name", 1, 4)), F.col("o_orderkey") % 4
    blob = F.when(k == 0, F.concat(F.lit("Shares of "), F.lower("n_name"), F.lit(" rose"))).when(k == 1, F.concat(F.lit("The earnings of "), ticker, F.lit(" beat"))).when(k == 2, F.concat(F.lit("They saw "), ticker, F.lit(" there"))).otherwise(F.concat(F.lit("Earnings of X"), ticker, F.lit(" rose")))
    a = o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), blob.alias("blob"))
    start = F.lit("1993-01-01").cast("date")
    e = n.select("n_nationkey", F.lower("n_name").alias("name"), F.upper(F.substring("n_name", 1, 4)).alias("ticker"), F.date_add(start, (F.col("n_nationkey") * 30).cast("int")).alias("first"), F.date_add(F.lit("1997-01-01").cast("date"), (F.col("n_nationkey") * 10).cast("int")).alias("last"))
    hits = linking.mentions(a, e, "o_orderkey", "blob", "n_nationkey", ("earnings", "revenue", "profit"))
    return hits.filter((F.col("day") >= F.col("first")) & (F.col("day") < F.col("last"))).select("n_nationkey", "o_orderkey")
