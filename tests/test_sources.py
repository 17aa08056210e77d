from pyspark.sql import functions as F

from tessera.sources import records
from tessera.streaming import arrivals

SCHEMA = "id string, n int"


def kind(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": null}\n{bad\n{"id": "c"}\n')
    good, bad = records.read_jsonl_tolerant(spark, str(tmp_path / "a.jsonl"), kind(spark))
    assert sorted(r["id"] for r in good.collect()) == ["a", "b", "c"] and [r["line"] for r in bad.collect()] == ["{bad"]
    fields = {r["line"]: r["fields"] for r in records.present_fields(spark, str(tmp_path / "a.jsonl")).collect()}
    assert fields['{"id": "c"}'] == ["id"] and fields['{"id": "b", "n": null}'] == ["id", "n"]


def test_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\tc\n1\t2\n3\t4\t5\n")
    assert [tuple(r) for r in records.read_tsv(spark, str(tmp_path / "t.tsv"), ["x", "y", "z"], header=False).collect()] == [("a", "b", "c"), ("3", "4", "5")]
    (tmp_path / "h.tsv").write_text("x\ty\n1\t2\n")
    assert records.read_tsv(spark, str(tmp_path / "h.tsv"), ["x", "y"], header=True).first()["y"] == "2"


def test_questions_latest_and_shards(spark, tmp_path):
    (tmp_path / "q1.json").write_text('[{"id": "a", "n": 1}]')
    (tmp_path / "q2.json").write_text('{"questions": [{"id": "b", "n": 2}]}')
    assert sorted(r["id"] for r in records.read_questions(spark, str(tmp_path / "*.json"), kind(spark), "questions").collect()) == ["a", "b"]
    df = spark.createDataFrame([("k", "old", 0), ("k", "new", 1)], "k string, v string, pos int")
    assert records.latest(df, "k", "pos").first()["v"] == "new"
    shards = spark.createDataFrame([("a.zst",), ("b.zst",)], "path string")
    assert [r["path"] for r in records.committed(shards, spark.createDataFrame([("a.zst.done",)], "path string")).collect()] == ["a.zst"]


def test_versioned_and_append(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA)
    assert records.write_versioned(df, str(tmp_path)) != records.write_versioned(df, str(tmp_path))
    path = str(tmp_path / "log")
    records.append(df, path, "id")
    records.append(spark.createDataFrame([("b", 9), ("c", 3)], SCHEMA), path, "id")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert records.config_digest({"a": {"b": 1}}, ["a.b"]) != records.config_digest({"a": {"b": 2}}, ["a.b"])


def test_streams(spark, sf, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    schema = events.schema
    events.coalesce(1).write.mode("overwrite").parquet(str(path / "x"))
    stream = spark.readStream.schema(schema).parquet(str(path / "x"))
    counts = arrivals.window_counts(arrivals.admitted(stream, [F.col("value") >= 0]), "ts", "event_type", "7 days", "1 day", "1 day")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = events.filter("value >= 0").groupBy(F.window("ts", "7 days", "1 day"), "event_type").count()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == batch.agg(F.sum("count")).first()[0]
    got = []
    q = arrivals.deltas(stream, lambda: spark.createDataFrame([(0,)], "event_id long"), "event_id", lambda df: got.append(df.count()), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert sum(got) == events.filter("event_id <> 0").count()
