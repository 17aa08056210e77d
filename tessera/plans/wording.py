"""Texts and answers: normal forms, keys, templates, and what is read from a model's JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, jsons, texts, urls
from .registry import query, table


@query("""WITH n AS (SELECT doc_id, trim(regexp_replace(trim(regexp_replace(text, '^["''\\s]+|["''\\s]+$', '', 'g')), '\\s+', ' ', 'g')) AS s, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents)
 SELECT doc_id, md5(t) AS normal, sha1(CASE WHEN s = '' OR regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END || '|' || doc_id || '|run') AS statement_id, md5(doc_id || t) AS fingerprint FROM n""")
def text_normal_forms(spark, sf_dir):
    """Texts for comparison, as statements with an id of their own, and fingerprints of rows."""
    d = table(spark, sf_dir, "documents")
    normal, ident = texts.normal(F.col("text")), F.col("doc_id").cast("string")
    return d.select("doc_id", F.md5(normal.cast("binary")).alias("normal"), texts.statement_id(texts.statement(F.col("text")), ident, F.lit("run")).alias("statement_id"), F.md5(F.concat(ident, normal).cast("binary")).alias("fingerprint"))


_TITLES = "SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' and ' || n_name || ' for the ' || p_brand || ' in ' || lower(n_name) || ' ' || p_name AS title FROM part JOIN nation ON n_nationkey = p_partkey % 25"


@query(f"""WITH t AS (SELECT p_partkey, list_filter(regexp_extract_all(title, '\\b[A-Za-z][A-Za-z0-9\\-]{{2,}}\\b'), lambda w: lower(w) NOT IN ('and', 'for', 'the', 'in')) AS w FROM ({_TITLES})),
 k AS (SELECT p_partkey, [w[i] FOR i IN range(1, len(w) + 1) IF regexp_matches(w[i], '^[A-Z]') AND list_position(w, w[i]) = i] AS names, [lower(w[i]) FOR i IN range(1, len(w) + 1) IF NOT regexp_matches(w[i], '^[A-Z]') AND list_position(w, w[i]) = i] AS rest FROM t)
 SELECT p_partkey, array_to_string((names[:4] || rest[:5 - least(len(names), 4)])[:5], ' ') AS keywords FROM k""")
def keyword_queries(spark, sf_dir):
    """Proper nouns first, then other words, five in all."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = table(spark, sf_dir, "part").join(F.broadcast(n), F.col("n_nationkey") == F.col("p_partkey") % 25)
    title = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit(" and "), "n_name", F.lit(" for the "), "p_brand", F.lit(" in "), F.lower("n_name"), F.lit(" "), "p_name")
    return p.select("p_partkey", texts.keywords(title, ("and", "for", "the", "in")).alias("keywords"))


@query("SELECT o_orderkey, md5('b' || chr(10) || 'm' || chr(10) || o_orderstatus || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END) AS key FROM orders")
def query_keys(spark, sf_dir):
    """Names under which a query's vector is kept."""
    return table(spark, sf_dir, "orders").select("o_orderkey", texts.query_key(F.lit("b"), F.lit("m"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))).alias("key"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '(no-host)' WHEN 1 THEN '(parse-fail)' ELSE lower(regexp_extract(url, '://([^/?#:]*)', 1)) END AS host FROM pages""")
def host_words(spark, sf_dir):
    """Hosts, and words for urls that have none or cannot be read."""
    url = F.when(F.col("page_id") % 8 == 0, F.lit(None)).when(F.col("page_id") % 4 == 0, "/no/host").when(F.col("page_id") % 4 == 1, F.concat(F.lit("http://["), "url")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.host_or_word(url.cast("string")).alias("host"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '"' || n_name || '" "' || s_name || '"' WHEN 1 THEN 'A' || s_nationkey || ' B' || s_suppkey ELSE substr('What of ' || s_name || ' and ' || n_name, 1, 20) END AS q FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def actor_queries(spark, sf_dir):
    """Queries from names, or else codes, or else the question."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("n_nationkey") == F.col("s_nationkey"))
    k = F.col("s_suppkey") % 3
    names = F.when(k == 0, F.array("n_name", "s_name")).otherwise(F.array(F.lit("one alone"), F.lit("")))
    actors = F.when(k == 2, F.array(F.lit("x"))).otherwise(F.array(F.concat(F.lit("A"), "s_nationkey"), F.concat(F.lit("B"), "s_suppkey"), F.lit("C")))
    return s.select("s_suppkey", texts.actor_query(names, actors, F.concat(F.lit("What of "), "s_name", F.lit(" and "), "n_name"), 20).alias("q"))


@query("""SELECT o_orderkey, 'What will ' || c_name || ' order on or around ' || strftime(o_orderdate, '%Y-%m-%d') || ': F, O or P?' AS question, 'Use news published at least 14 days before, until ' || strftime(CAST(o_orderdate AS DATE) - 14, '%Y-%m-%d') || '.' AS background FROM orders JOIN customer ON c_custkey = o_custkey""")
def question_templates(spark, sf_dir):
    """Questions and backgrounds from templates."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", F.format_string("What will %s order on or around %s: F, O or P?", "c_name", day).alias("question"), F.format_string("Use news published at least %d days before, until %s.", F.lit(14), dates.horizon(day, 14)).alias("background"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_returnflag = 'R' THEN '' ELSE CASE l_linenumber % 4 WHEN 0 THEN 'Over the past ' || l_suppkey % 90 || ' days the actors'' usual class was ''' || l_returnflag || ''' (' || CAST(floor(l_quantity / 50 * 100) AS INT) || '% of ' || l_partkey || ' events).' WHEN 1 THEN 'In recent quarters the company mostly reported ''' || l_returnflag || ''' (' || CAST(floor(l_quantity / 50 * 100) AS INT) || '% of ' || l_partkey || ' quarters).'
 WHEN 2 THEN 'The crowd''s majority answer was ''' || l_returnflag || ''' (strength ' || printf('%.2f', l_quantity / 50) || ').' ELSE 'The expectation is ''' || l_returnflag || '''.' END END AS sentence FROM lineitem""")
def prior_sentences(spark, sf_dir):
    """What a question's benchmark says of the expectation."""
    kind = F.element_at(F.array(*map(F.lit, ("events", "company", "market", "other"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    prior = F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", texts.prior_sentence(kind, prior, F.col("l_quantity").cast("double") / 50, F.col("l_partkey"), F.col("l_suppkey") % 90).alias("sentence"))


@query("""SELECT doc_id, '[' || (doc_id % 10 + 1) || '] ' || lang || ' (' || source || ', 2026-01-0' || (doc_id % 9 + 1) || ')' || chr(10) || substr(text, 1, 900) AS evidence FROM documents WHERE text IS NOT NULL""")
def evidence_format(spark, sf_dir):
    """A heading and the beginning of a text, which is the format's own limit."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    day = F.concat(F.lit("2026-01-0"), (F.col("doc_id") % 9 + 1).cast("string"))
    return d.select("doc_id", texts.evidence((F.col("doc_id") % 10 + 1).cast("int"), day, F.col("source"), F.col("lang"), F.col("text")).alias("evidence"))


@query("""SELECT o_orderkey, o_orderkey % 8 < 7 AS spelled FROM orders""")
def verbatim_dates(spark, sf_dir):
    """Whether a text has a day in one of six spellings; what is no day counts as found."""
    day = F.col("o_orderdate").cast("date")
    forms = ("MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "yyyy-MM-dd", "MM/dd/yyyy")
    spelled = [F.date_format(day, f) for f in forms] + [F.concat(F.dayofmonth(day).cast("string"), F.date_format(day, "/MM/yyyy")), F.lit("none"), F.date_format(F.date_add(day, 400), "yyyy-MM-dd")]
    k = F.col("o_orderkey") % 8
    body = F.concat(F.lit("It was on "), F.element_at(F.array(*spelled), (k + 1).cast("int")), F.lit(" that"))
    time = F.when(k == 6, "2026").otherwise(F.date_format(day, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.verbatim(time, body).alias("spelled"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_linenumber % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN least(l_quantity / 25, 1) WHEN 3 THEN 0.5 ELSE 0.5 END AS weight FROM lineitem""")
def confidence_weights(spark, sf_dir):
    """Weights from words and numbers."""
    raw = F.element_at(F.array(F.lit("high"), F.lit("medium"), (F.col("l_quantity").cast("double") / 25).cast("string"), F.lit("sure"), F.lit(None).cast("string")), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", texts.confidence_weight(raw).alias("weight"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN trim(p_name) || '|' || p_size WHEN p_partkey % 5 = 2 THEN trim(p_brand) ELSE '' END AS claims FROM part""")
def claims_parse(spark, sf_dir):
    """Claims of an answer, fenced or not, under either key; anything else has none."""
    k = F.col("p_partkey") % 5
    both = F.to_json(F.struct(F.array(F.concat(F.lit(" "), "p_name"), F.lit("  "), F.col("p_size").cast("string")).alias("claims")))
    facts = F.to_json(F.struct(F.array().cast("array<string>").alias("claims"), F.array("p_brand").alias("facts")))
    content = F.when(k == 0, both).when(k == 1, F.concat(F.lit("```json\n"), both, F.lit("\n```"))).when(k == 2, facts).when(k == 3, "no json").otherwise('{"claims": "x"}')
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(jsons.claims(content), "|").alias("claims"))


_GIVEN = "SELECT l_orderkey, l_linenumber, l_suppkey, l_discount AS a, l_tax AS b, l_quantity / 100 AS c, l_linenumber % 4 AS k FROM lineitem"


@query(f"""WITH g AS (SELECT *, CASE k WHEN 3 THEN 1.0 / 3 ELSE CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE 1.0 / 3 END END AS pa, CASE k WHEN 3 THEN 1.0 / 3 ELSE b / (a + b + c) END AS pb, CASE k WHEN 3 THEN 1.0 / 3 ELSE c / (a + b + c) END AS pc FROM ({_GIVEN}))
 SELECT l_orderkey, l_linenumber, l_suppkey, round(pa * 0.7123, 3) AS pa, round(pb * 0.7123, 3) AS pb, CASE WHEN round(pa, 9) >= round(pb, 9) AND round(pa, 9) >= round(pc, 9) THEN 'Peace' WHEN round(pb, 9) >= round(pc, 9) THEN 'Tension' ELSE 'Violence' END AS best FROM g""")
def probability_answers(spark, sf_dir):
    """Probabilities from an object, from loose text, as percentages; uniform where they are incomplete; and the likeliest."""
    l, k = table(spark, sf_dir, "lineitem"), F.col("l_linenumber") % 4
    a, b, c = F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.col("l_quantity").cast("double") / 100
    shown = lambda f: [F.format_string("%.8f", x * f) for x in (a, b, c)]
    body = lambda f: F.concat(F.lit('"Peace": '), shown(f)[0], F.lit(', "Tension": '), shown(f)[1], F.lit(', "Violence": '), shown(f)[2])
    content = F.when(k == 0, F.concat(F.lit('{"probabilities": {'), body(1), F.lit("}}"))).when(k == 1, F.concat(F.lit("I think "), body(1), F.lit(" and so on"))).when(k == 2, F.concat(F.lit('{"probs": {'), body(1000), F.lit("}}"))).otherwise('{"probabilities": {"Peace": 0.4}}')
    hypotheses = F.array(*map(F.lit, ("Peace", "Tension", "Violence")))
    p = l.select("l_orderkey", "l_linenumber", "l_suppkey", jsons.probabilities(content, hypotheses).alias("p"))
    exact = F.transform_values("p", lambda _, v: F.round(v, 9))
    return p.select("l_orderkey", "l_linenumber", "l_suppkey", F.round(F.col("p")["Peace"] * 0.7123, 3).alias("pa"), F.round(F.col("p")["Tension"] * 0.7123, 3).alias("pb"), jsons.argmax(exact, hypotheses).alias("best"))


@query(f"""WITH g AS (SELECT *, k = 1 OR a + c < 1e-9 AS same, a + c AS t FROM ({_GIVEN}))
 SELECT l_orderkey, l_linenumber, l_suppkey, array_to_string([x.h FOR x IN list_sort([{{'v': CASE WHEN same THEN 0 ELSE -round(a / t, 9) END, 'i': 1, 'h': 'Peace'}}, {{'v': 0, 'i': 2, 'h': 'Tension'}}, {{'v': CASE WHEN same THEN 0 ELSE -round(c / t, 9) END, 'i': 3, 'h': 'Violence'}}])], '>') AS ranking FROM g""")
def judge_rankings(spark, sf_dir):
    """A judge's weights as probabilities and the ranking they give; without an answer all are equal."""
    l = table(spark, sf_dir, "lineitem")
    names = ("Peace", "Tension", "Violence")
    given = F.when(F.col("l_linenumber") % 4 != 1, F.create_map(F.lit("Peace"), F.col("l_discount").cast("double"), F.lit("Violence"), F.col("l_quantity").cast("double") / 100, F.lit("other"), F.lit(9.0)))
    p = jsons.normalised(F.coalesce(given, F.create_map(F.lit(""), F.lit(0.0))), F.array(*map(F.lit, names)))
    rows = F.array_sort(F.array(*(F.struct((-F.round(p[h], 9)).alias("v"), F.lit(i).alias("i"), F.lit(h).alias("h")) for i, h in enumerate(names))))
    return l.select("l_orderkey", "l_linenumber", "l_suppkey", F.array_join(F.transform(rows, lambda r: r["h"]), ">").alias("ranking"))


@query("""SELECT l_orderkey AS query, i AS ind, CASE WHEN v IS NULL THEN 0 ELSE least(v, 1) END AS value FROM (SELECT DISTINCT l_orderkey FROM lineitem), (SELECT unnest([1, 2, 3, 4, 5]) AS i) LEFT JOIN (SELECT l_orderkey AS k, l_linenumber AS n, arg_max(l_quantity / 40, (l_suppkey, l_partkey, l_quantity)) AS v FROM lineitem GROUP BY ALL) ON k = l_orderkey AND n = i""")
def score_scatter(spark, sf_dir):
    """Lists of scores by number, as rows of a matrix; numbers out of range are left out, missing ones are 0."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", F.col("l_linenumber").cast("int").alias("id"), (F.col("l_quantity").cast("double") / 40).alias("presence"), "l_quantity")
    entries = F.transform(F.sort_array(F.collect_list(F.struct("l_suppkey", "l_partkey", "l_quantity", "id", "presence"))), lambda e: F.struct(e["id"].alias("id"), e["presence"].alias("presence")))
    answers = l.groupBy("l_orderkey").agg(F.to_json(F.struct(F.concat(entries, F.array(F.struct(F.lit(0).alias("id"), F.lit(0.7).alias("presence")))).alias("scores"))).alias("content"))
    return answers.select(F.col("l_orderkey").alias("query"), F.posexplode(jsons.scattered(F.col("content"), "scores", "presence", 5, 0.0)).alias("pos", "value")).select("query", (F.col("pos") + 1).alias("ind"), "value")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'F,O,P' ELSE 'Comply,Surprise' END AS hypotheses, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus WHEN o_orderstatus = 'O' THEN 'Comply' ELSE 'Surprise' END AS truth, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS multiclass FROM orders""")
def multiclass_swap(spark, sf_dir):
    """Questions are put as binary ones, and those with classes of their own are put back to these."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.array(*map(F.lit, "FOP"))).alias("x_hypotheses"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).alias("x_truth"), "o_orderstatus")
    binary = o.withColumns({"hypotheses": F.array(F.lit("Comply"), F.lit("Surprise")), "truth": F.when(F.col("o_orderstatus") == "O", "Comply").otherwise("Surprise")})
    swapped = binary.withColumns({c: F.when(F.col("x_hypotheses").isNotNull(), F.col(f"x_{c}")).otherwise(F.col(c)) for c in ("hypotheses", "truth")})
    return swapped.select("o_orderkey", F.array_join("hypotheses", ",").alias("hypotheses"), "truth", F.col("x_truth").alias("multiclass"))


@query("""WITH n AS (SELECT l_orderkey, [x FOR x IN list(CASE WHEN l_linenumber % 2 = 1 THEN trim(' i' || l_partkey) ELSE '' END ORDER BY l_linenumber, l_suppkey, l_partkey) IF x <> ''] AS x FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string((x || ['indicator 1', 'indicator 2', 'indicator 3'])[:3], '|') AS indicators FROM n""")
def indicator_fit(spark, sf_dir):
    """Indicators without empty ones, cut or padded to three."""
    text = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit(" i"), "l_partkey")).otherwise(F.lit("  "))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", text.alias("t")))).alias("r"))
    return g.select("l_orderkey", F.array_join(jsons.fitted(F.transform("r", lambda x: x["t"]), 3), "|").alias("indicators"))
