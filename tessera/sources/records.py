"""JSON lines, tab-separated tables, lookups, month shards and caches."""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"
#: Quotes within a field are doubled.
TSV = {"sep": "\t", "header": True, "escape": '"'}


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """Records of a declared schema; blank lines are skipped; a malformed line is an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df if limit is None else df.limit(limit)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good records, and the text of malformed lines."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    good = parsed.filter(F.col(f"r.{CORRUPT}").isNull()).select(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields))
    return good, parsed.filter(F.col(f"r.{CORRUPT}").isNotNull()).select(F.col("value").alias("line"))


def present_fields(spark: SparkSession, path: str) -> DataFrame:
    """line, fields: which keys each record has, whatever their values; a missing key is not a null one."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.col("value").alias("line"), F.json_object_keys("value").alias("fields"))


def read_questions(spark: SparkSession, path: str, inner: T.StructType, key: str, ident: str | None = None, skip: str | None = None) -> DataFrame:
    """Files of one JSON document each: a list of records, or an object that has the list under a key.

    skip: part of the paths of files that are left out, such as copies named 'latest'; ident: a column of which lists are no values.
    """
    docs = spark.read.text(path, wholetext=True)
    if skip:
        docs = docs.filter(~F.contains(F.input_file_name(), F.lit(skip)))
    bare = F.from_json("value", T.ArrayType(inner))
    nested = F.from_json(F.get_json_object("value", f"$.{key}"), T.ArrayType(inner))
    rows = docs.select(F.inline(F.when(F.trim("value").startswith("["), bare).otherwise(nested)))
    return rows if ident is None else rows.filter(~F.trim(ident).startswith("["))


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str], header: bool) -> DataFrame:
    """All columns as text; fields may be long; rows of another width are dropped where there is no header."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if header:
        return spark.read.schema(schema).options(**TSV, maxCharsPerColumn=-1).csv(path)
    # the width decides on the raw line: a short row must not be padded
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).filter(F.size(parts) == len(columns)).select(parts.alias("p"))
    return rows.select(*(F.col("p")[i].alias(c) for i, c in enumerate(columns)))


def read_lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Two columns; lines with other than two parts are no entries."""
    return read_tsv(spark, path, [key, value], header=False)


def latest(df: DataFrame, key: str, position: str) -> DataFrame:
    """A keyed table in which the last duplicate wins."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), position).alias("r")).select(key, "r.*")


def in_months(lines: DataFrame, pattern: str, first: str, last: str) -> DataFrame:
    """Lines of a file list whose yyyyMM is within the range; lines without one are none."""
    month = F.regexp_extract("value", pattern, 1)
    return lines.filter((month != "") & month.between(first, last))


def committed(shards: DataFrame, markers: DataFrame, path: str = "path") -> DataFrame:
    """Shards whose marker `<path>.done` is there."""
    done = markers.select(F.regexp_replace(path, r"\.done$", "").alias(path)).distinct()
    return shards.join(done, path, "left_semi")


def read_zstd_lines(shards: DataFrame, schema: T.StructType) -> DataFrame:
    """Records of shards in a column `content` (as binaryFile gives it), each a zstd stream of JSON lines; lines that are no record are left out."""

    def lines(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in stream:
            for blob in b.column(0).to_pylist():
                reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(blob), read_across_frames=True), encoding="utf-8", errors="replace")
                while part := reader.readlines(4 << 20):  # bounded, however long the shard
                    yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in part if x.strip()], pa.string())], ["line"])

    parsed = shards.select("content").mapInArrow(lines, "line string").select(F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.filter(F.col("r").isNotNull()).select("r.*")


def zstd_lines(records: DataFrame, path: Column) -> DataFrame:
    """path, content: the records of each partition and path as a zstd stream of JSON lines."""
    rows = records.select(path.cast("string").alias("path"), F.to_json(F.struct(*records.columns)).alias("line"))

    def shards(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in stream:
            own: dict[str, list[str]] = {}
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own.setdefault(p, []).append(x)
            blobs = [zstandard.ZstdCompressor(level=3).compress(("\n".join(x) + "\n").encode()) for x in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(blobs, pa.binary())], ["path", "content"])

    return rows.mapInArrow(shards, "path string, content binary")


WARC = re.compile(rb"WARC/1\.[01]\r\n(?P<head>.*?)\r\n\r\n", re.S)


def warc_records(content: bytes) -> Iterator[dict]:
    """Records of a WARC file: type, uri, date, status, mime, body of HTTP responses; one that is cut short or has no length is 'malformed', and ends the file."""
    at = 0
    while (start := content.find(b"WARC/1.", at)) >= 0:
        m = WARC.match(content, start)
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in m["head"].decode("utf-8", "replace").split("\r\n"))} if m else {}
        length = head.get("content-length", "")
        if not length.isdigit() or m.end() + int(length) > len(content):
            yield {"type": "malformed", "uri": head.get("warc-target-uri")}
            return
        block, at = content[m.end() : m.end() + int(length)], m.end() + int(length)
        row = {"type": head.get("warc-type"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date")}
        if row["type"] == "response":
            http, _, body = block.partition(b"\r\n\r\n")
            first, *rest = http.decode("latin-1").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
            row |= {"status": first.split(" ")[1] if " " in first else None, "mime": fields.get("content-type", "").split(";")[0].strip().lower(), "body": body.decode("utf-8", "replace")}
        yield row


def read_warc(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From a column `content`: HTML responses (uri, date, status, body), and the malformed records (uri)."""
    schema = pa.schema([(c, pa.string()) for c in ("type", "uri", "date", "status", "mime", "body")])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for blob in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(list(warc_records(blob)), schema=schema)

    rows = files.select("content").mapInArrow(run, ", ".join(f"{c} string" for c in schema.names))
    return rows.filter("type = 'response' and mime in ('text/html', 'application/xhtml+xml')").select("uri", "date", "status", "body"), rows.filter("type = 'malformed'").select("uri")


def write_versioned(df: DataFrame, root: str, kind: str = "parquet", by: Sequence[str] = ()) -> str:
    """A new folder under root for each write: inputs are never overwritten, and readers see whole output only."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    w = df.write.partitionBy(*by) if by else df.write
    getattr(w, kind)(path) if kind != "tsv" else w.options(**TSV, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def make_current(spark: SparkSession, root: str, path: str) -> None:
    """Point readers at a version; the pointer is a row of a small table that only grows, so there is no moment without one."""
    spark.sql("select current_timestamp() as at").select("at", F.lit(path).alias("path")).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/current")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The version that was made current last."""
    return spark.read.parquet(spark.read.parquet(f"{root.rstrip('/')}/current").agg(F.max_by("path", "at")).first()[0])


def append(df: DataFrame, path: str, key: str) -> None:
    """Append rows whose key is not there yet."""
    spark = df.sparkSession
    try:
        old = spark.read.schema(df.schema).parquet(path)
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], df.schema)
    df.dropDuplicates([key]).join(old.select(key), key, "left_anti").write.mode("append").parquet(path)


def cached_vectors(texts: DataFrame, cache: DataFrame, key: str = "fp") -> tuple[DataFrame, DataFrame]:
    """Texts whose fingerprint has a vector already, with it; and those still to encode."""
    t = texts.withColumn(key, F.md5(F.col("text").cast("binary")))
    return t.join(cache, key), t.join(cache.select(key), key, "left_anti")


def first_valid(attempts: Sequence[tuple[str, Column]], valid) -> tuple[Column, Column]:
    """The text of the first landed attempt that is valid, and that attempt's name."""
    return F.coalesce(*(F.when(valid(t), t) for _, t in attempts)), F.coalesce(*(F.when(valid(t), F.lit(n)) for n, t in attempts))


def config_digest(config: dict, keys: Sequence[str]) -> str:
    """SHA-256 of the canonical JSON of a slice of a configuration, by dotted keys."""
    import hashlib

    def at(key: str):
        node = config
        for part in key.split("."):
            node = node.get(part) if isinstance(node, dict) else None
        return node

    body = json.dumps({k: at(k) for k in sorted(keys)}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(body.encode()).hexdigest()


def digest_of(df: DataFrame, ident: str) -> DataFrame:
    """One row: n_rows, n_ids and an order-free checksum of a table, the exclusive or of the SHA-256 of its rows as JSON (60 bits of each)."""
    bits = F.conv(F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(ident).alias("n_ids"), F.bit_xor(bits).alias("checksum"))


def markdown(rows: DataFrame, title: str, limit: int = 1000) -> DataFrame:
    """line, text: a report's table, for aggregates of at most `limit` rows, in the order of their columns; more rows are an error."""
    spark, found = rows.sparkSession, rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    cells = sorted([["" if v is None else str(v) for v in r] for r in found])
    text = [f"# {title}", "", f"| {' | '.join(rows.columns)} |", f"|{'-|' * len(rows.columns)}", *(f"| {' | '.join(r)} |" for r in cells)]
    return spark.createDataFrame(list(enumerate(text, 1)), "line int, text string")
