import datetime
import re

from pyspark.sql import functions as F

from tessera.functions import dates, jsons, scores, texts, urls, vectors


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def many(spark, column, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", column(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_url_shapes(spark):
    assert many(spark, urls.domain, ["https://www.A.com:80/x", "http://a.www.b.org/", "", "nonsense", None]) == ["a.com:80", "a.b.org", "", "", ""]
    assert many(spark, urls.site, ["https://www.A.com:80/x", "http://a.www.b.org/"]) == ["a.com", "a.www.b.org"]
    assert many(spark, urls.stripped_site, ["http://www.world.com/"]) == ["orld.com"]
    assert many(spark, urls.key, ["HTTP://A.com/x/?q=1#f", "http://a.com"]) == ["http://a.com/x", "http://a.com"]
    assert many(spark, urls.path_date, ["http://a/2026/3/1/x", "http://a/2026/13/01/", "http://a/2024/12/31.html", None]) == ["2026-03-01", "", "2024-12-31", ""]
    assert many(spark, urls.slug, ["http://a/b-c_d/e?x=f-g"]) == [" b c d e x=f g"]
    assert many(spark, lambda u: urls.in_domains(urls.site(u), ["blocked.com"]), ["http://x.blocked.com/", "http://notblocked.com/", "http://blocked.com"]) == [True, False, True]


def test_dates(spark):
    day = datetime.date(2026, 3, 1)
    assert many(spark, dates.lenient, ["2026-3-1", "2026-03-01T10:00", "2026/03/01", "2026-02-30", "", None]) == [day, day, None, None, None, None]
    assert many(spark, dates.strict, ["2026-03-01", "2026-3-1", "2026-03-01x"]) == [day, None, None]
    assert many(spark, dates.any_format, ["2026/03/01", "20260301", "2026-03-01"]) == [day] * 3
    assert many(spark, dates.precision, ["2026-03-01", "2026-03", "2026", "unknown"]) == ["day", "month", "year", "unknown"]
    assert many(spark, lambda t: dates.canonical(t, F.lit("2026-03-15")), ["2026-03-14", "2026-03-10", "2026-03-16", "2026", "2020-01-01"]) == [True, False, False, True, False]
    assert many(spark, lambda b: dates.verbatim(F.lit("2026-03-01"), b), ["on March 1, 2026", "1 March 2026", "03/01/2026", "May 2026", None]) == [True, True, True, False, False]
    assert one(spark, lambda v: dates.months(F.lit("2026-01-31").cast("date"), F.lit("2026-03-01").cast("date")), "") == ["2026-01", "2026-02", "2026-03"]


def test_texts(spark):
    assert many(spark, texts.ngrams, ["The cat sat on the mat", "", None, "one"]) == [["cat sat", "sat mat"], [], [], []]
    assert many(spark, texts.shingles, ["ab  CDE", "abc"]) == [["ab cd", "b cde"], []]
    assert many(spark, texts.company, ["The Acme Holdings Inc.", "Foo Corp", "Bar"]) == ["acme", "foo", "bar"]
    assert many(spark, texts.signature, ["fact[12] on 2026-01-02 id deadbeef99 n 7"]) == ["fact[N] on <DATE> id <HASH> n <N>"]
    good = " ".join(f"word{i} is here." if i % 9 == 0 else f"word{i}" for i in range(120))
    assert many(spark, texts.quality, ["", "x" * 399, good, "Access denied " + good, "go go. " * 90, None]) == ["empty", "too_short", "ok", "blocker:access_denied", "low_diversity", "empty"]
    assert many(spark, lambda t: texts.keywords(t, ("will", "the"), 3), ["Will Paris host the games in Paris games"]) == ["Paris host games"]


def test_scores(spark):
    assert many(spark, scores.intensity, ["013", "13", "141", "190", "", "x", None]) == ["Peace", "Peace", "Tension", "Violence", None, None, None]
    assert many(spark, scores.quad, ["013", "171", "201"]) == ["VC", "MK", "MK"]
    assert many(spark, lambda v: scores.surprise(v.cast("double"), F.lit(0.0)), ["0.03", "-0.03", "0.01", None]) == ["Beat", "Miss", "Meet", None]
    r = one(spark, lambda v: scores.crowd_prior(v.cast("double"), F.lit("Yes"), 0.1), "0.55")
    assert (r["expected"], r["fd_type"]) == (None, "unknown")
    assert abs(sum(one(spark, lambda v: scores.softmax(F.array(F.lit(1.0), F.lit(2.0))), "")) - 1) < 1e-12


def test_json_answers(spark):
    hs = F.array(*map(F.lit, ("Yes", "No", "Verbal Cooperation", "Material Cooperation")))
    got = many(spark, lambda c: jsons.pick(c, hs), ['```json\n{"prediction": "yes"}\n```', '{"label": ["x", "No"]}', '{"class": {"value": "verbalcooperation"}}', '{"pick": "Verbal Cooperation: because"}', '{"pick": "cooperation"}', "Yes", None, '{"reasoning": "likely No here"}'])
    assert got == ["Yes", "No", "Verbal Cooperation", "Verbal Cooperation", None, None, None, "No"]
    two = F.array(F.lit("Yes"), F.lit("No"))
    probs = many(spark, lambda c: jsons.probabilities(c, two), ['{"probabilities": {"Yes": 95, "No": 5}}', '{"probs": {"Yes": 0.5}}', 'text "Yes": 0.2, "No": 0.6', None])
    assert [round(p["Yes"], 3) for p in probs] == [0.95, 0.5, 0.25, 0.5]
    assert many(spark, jsons.cell_list, ["['1', '2']", "3", "", None]) == [["1", "2"], ["3"], [], []]


def test_vectors(spark):
    assert one(spark, lambda v: vectors.cosine(v, v), [0.0, 0.0], "array<float>") == 0.0
    assert abs(one(spark, lambda v: vectors.norm(vectors.unit(v)), [3.0, 4.0], "array<float>") - 1) < 1e-9


def reads(spark, f):
    """How often the plan of f names the column that it is given."""
    df = spark.range(1).select(F.concat(F.lit("{"), F.col("id").cast("string")).alias("c")).repartition(1)
    return len(re.findall(r"\bc#\d+", df.select(f(F.col("c")).alias("x"))._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]))


def test_pick_reads_an_answer_once(spark):
    hs = F.array(F.lit("Yes"), F.lit("No"))
    assert reads(spark, lambda c: jsons.pick(c, hs)) == 1
    odd = ['{"label": "No", "prediction": "x"}', '{"predic\\u0074ion": "Yes"}', '{"reasoning": "so Yes."}', '["prediction"]', '{"prediction": "Yes"', "{oops", None]
    assert many(spark, lambda c: jsons.pick(c, hs), odd) == ["No", "Yes", "Yes", None, None, None, None]


def test_probabilities_read_an_answer_once(spark):
    hs = F.array(F.lit("Yes"), F.lit("No"))
    assert reads(spark, lambda c: jsons.probabilities(c, hs)) == 1
    assert reads(spark, lambda c: jsons.argmax(F.create_map(F.lit("Yes"), F.length(c) / 2), hs)) == 1
    odd = ['{"pro\\u0062s": {"Yes": 1, "No": 3}}', '{"probabilities": {"Yes": 1}} "No": 3', '"Yes": x, "No": 1', "probs", ""]
    assert [p["Yes"] for p in many(spark, lambda c: jsons.probabilities(c, hs), odd)] == [0.25, 0.25, 0.5, 0.5, 0.5]
