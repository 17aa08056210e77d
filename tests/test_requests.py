from pyspark.sql import functions as F

from tessera.operators import facts, requests, rounds


def test_fan_out_pending_and_chunks(spark):
    q = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "id long, pieces array<string>")
    asked = requests.build(q, requests.METHODS["claims"], F.lit("?"), pieces="pieces")
    assert sorted(r["request_id"] for r in asked.collect()) == ["1::claims::r1::a", "1::claims::r1::b", "1::claims::r1::c"]
    answers = spark.createDataFrame([("1::claims::r1::a", '{"prediction": "No"}')], "request_id string, content string")
    assert requests.pending(asked, answers).count() == 2
    assert requests.chunks(asked, 2).select("chunk").distinct().count() <= 2
    assert [tuple(r) for r in requests.predictions(asked, answers, ["Yes", "No"], "first").collect()] == [(1, "No", False)]
    assert requests.predictions(asked, answers.filter("false"), ["Yes", "No"], "plurality").first()["parse_failed"]


def test_votes_are_counted_in_one_pass(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    asked = requests.build(q, requests.METHODS["ensemble"], F.lit("?"))
    said = {"1::ensemble::r1::1": "No", "1::ensemble::r1::2": "No", "1::ensemble::r1::3": "Yes", "2::ensemble::r1::1": "No", "2::ensemble::r1::3": "Yes", "3::ensemble::r1::2": "Maybe"}
    answers = spark.createDataFrame([(k, f'{{"prediction": "{v}"}}') for k, v in said.items()], "request_id string, content string")
    got = requests.predictions(asked, answers, ["Yes", "No"], "plurality")
    assert sorted(map(tuple, got.collect())) == [(1, "No", False), (2, "Yes", False), (3, None, True)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # answers to requests; the questions are not joined again


def test_routes_fall_back(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, benchmark string")
    contract = spark.createDataFrame([("x", "index"), ("y", "index")], "benchmark string, mode string")
    plans = {"index": lambda d: d.filter("id = 1").select("id"), "fallback": lambda d: d.select("id")}
    assert sorted(tuple(r) for r in requests.routed(q, contract, plans).collect()) == [(1, "index"), (2, "fallback"), (3, "fallback")]


def test_facts_recovered_and_filtered(spark):
    r = spark.createDataFrame([(1, "2026-03-15", "seen on March 10, 2026", '{"facts": [{"fact": "\\"it  rained\\"", "time": "2026-03-10"}, {"fact": "x", "time": "2026-03-05"}]}'), (2, "2026-03-15", "", None)], "id long, publish_date string, body string, content string")
    good, bad = facts.validated(r)
    assert [(x["fact"], x["time"]) for x in good.collect()] == [("it rained.", "2026-03-10")]
    assert sorted((x["id"], x["reason"]) for x in bad.collect()) == [(1, "anchor"), (2, "empty")]
    assert [x["id"] for x in facts.recovered(bad, good).collect()] == [1]
    f = spark.createDataFrame([("Wire", "high", "asserted", "2026-01-01", "2026-01-02", [(None,)], ["v"], []), ("blocked news", "low", "asserted", "unknown", "2026-01-02", [("Ann",)], [], ["q"])], "source string, extraction_confidence string, polarity string, time string, article_date string, entities array<struct<name:string>>, variant_ids array<string>, linked_fd_ids array<string>")
    got = f.select(facts.reasons(source_block=("blocked",), confidence="medium", named=True, linked=True).alias("r")).collect()
    assert [x["r"] for x in got] == ["entity", "source:blocked"]


def test_branches_grow_from_what_was_asked(spark):
    q = spark.createDataFrame([(1, "one?"), (2, "two?")], "question long, prompt string")
    m = requests.METHODS["branches"]
    asked = rounds.first(q, m)
    answers = asked.filter("request_id <> '2::branches::r0::a1'").select("request_id", F.concat(F.lit("said "), "slot").alias("content"))
    second = rounds.following(q, m, 1, asked, answers)
    want = {(k, f"a{i}.a{j}", f"{w}?\nThought:\n" + ("" if (k, i) == (2, 1) else f"said a{i}")) for k, w in ((1, "one"), (2, "two")) for i in range(3) for j in range(3)}
    assert {(r["question"], r["slot"], r["prompt"]) for r in second.collect()} == want and second.count() == len(want)
    assert second._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # the questions are not read again
    third = rounds.following(q, m, 2, second, second.select("request_id", F.lit("x").alias("content")))
    assert third.count() == 54 and {r["prompt"] for r in third.collect()} == {"one?\nThought:\nx", "two?\nThought:\nx"}
