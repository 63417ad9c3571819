"""Tolerant JSON-lines ingestion with file and line, and the record dialects built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def raw_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """file, line (from 1), raw of every line that is neither blank nor a // comment; a missing path has no lines.

    A file is one row until it is split, as a line's number is its place in the file: shards are meant to be small
    enough to be reviewed as diffs.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, line int, raw string")
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    lines = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n", -1)).alias("at", "raw"))
    bare = F.regexp_replace("raw", r"(?U)^[\s﻿]+|[\s﻿]+$", "")
    return lines.filter((bare != "") & ~bare.startswith("//")).select("file", (F.col("at") + 1).alias("line"), "raw")


def parsed(lines: DataFrame, schema: StructType | str) -> DataFrame:
    """lines with `record` (null where the line is no JSON object) and `error`."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    with_corrupt = StructType(schema.fields).add("_corrupt", "string")
    got = lines.withColumn("_r", F.from_json("raw", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    record = F.struct(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    return got.select("file", "line", "raw", F.when(~bad, record).alias("record"), F.when(bad, F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": not JSON"))).alias("error"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """Records with _file and _line; strict: a bad line fails the read when it is reached."""
    rows = parsed(raw_lines(spark, path), schema)
    if strict:
        rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))))
    return rows.filter("error is null and record is not null").select("record.*", F.col("file").alias("_file"), F.col("line").alias("_line"))


def read_array_or_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that is one JSON array, or JSON lines, told by its first character that is not blank."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()[len("struct<") : -1]
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    is_array = F.regexp_replace("value", r"(?U)^[\s﻿]+", "").startswith("[")
    element = StructType.fromDDL(ddl) if "<" in ddl or " " in ddl else schema
    arrays = whole.filter(is_array).select(F.explode(F.from_json("value", f"array<{element.simpleString()}>")).alias("r")).select("r.*")
    lines = whole.filter(~is_array).select(F.explode(F.split("value", r"\r?\n", -1)).alias("raw")).filter("trim(raw) <> '' and not startswith(trim(raw), '//')")
    return arrays.unionByName(lines.select(F.from_json("raw", element).alias("r")).select("r.*"))


WORK_ITEM = "anchor_id string, status string, evidence string, evidence_source string, `by` string"
WORK = f"student_ref string, stage string, work_title string, sessions int, iterations int, issued_on string, items array<struct<{WORK_ITEM.replace(' string', ':string').replace('`by`', 'by')}>>"


def read_work(spark: SparkSession, path: str) -> DataFrame:
    """One work record a file, from a JSON object or from lines of which the first without anchor_id is the header."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    whole = text.select(F.from_json("value", WORK).alias("w")).filter("w.items is not null").select("w.*")
    lines = text.filter(F.from_json("value", WORK)["items"].isNull()).select("file", F.posexplode(F.split("value", r"\r?\n", -1)).alias("pos", "raw")).filter("trim(raw) <> ''")
    both = lines.select("file", "pos", F.from_json("raw", WORK).alias("h"), F.from_json("raw", WORK_ITEM).alias("i"))
    item = F.col("i.anchor_id").isNotNull()
    per = both.groupBy("file").agg(F.min_by(F.when(~item, F.col("h")), F.when(~item, F.col("pos"))).alias("h"), F.array_sort(F.collect_list(F.when(item, F.struct("pos", "i")))).alias("items"))
    joined = per.filter("h is not null and size(items) > 0").select("h.*", F.transform("items", lambda x: x["i"]).alias("_items")).drop("items").withColumnRenamed("_items", "items")
    return whole.unionByName(joined)


REVIEW = "schema string, reviewer string, reviewedAt string, rows array<struct<anchorId:string,verdict:string,note:string,discipline:string>>"
REVIEW_ROW = "anchorId string, prerequisiteId string, kind string, verdict string, issue string, note string, reviewer string, reviewedAt string"


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """anchorId, prerequisiteId, kind, verdict, note, reviewer, reviewedAt, seq of both export dialects."""
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", REVIEW).alias("d")).filter("d.rows is not null").select("d.reviewer", "d.reviewedAt", F.posexplode("d.rows").alias("seq", "r"))
    doc = doc.select("r.anchorId", F.lit(None).cast("string").alias("prerequisiteId"), F.lit("anchor").alias("kind"), "r.verdict", "r.note", "reviewer", "reviewedAt", "seq")
    lines = text.filter(F.from_json("value", REVIEW)["rows"].isNull()).select(F.posexplode(F.split("value", r"\r?\n", -1)).alias("seq", "raw")).filter("trim(raw) <> ''")
    rows = lines.select("seq", F.from_json("raw", REVIEW_ROW).alias("r")).filter("r.anchorId is not null")
    rows = rows.select("r.anchorId", "r.prerequisiteId", F.coalesce("r.kind", F.when(F.col("r.prerequisiteId").isNull(), "anchor").otherwise("edge")).alias("kind"), F.coalesce(F.nullif("r.issue", F.lit("")), "r.verdict").alias("verdict"), "r.note", "r.reviewer", "r.reviewedAt", "seq")
    return doc.unionByName(rows)


def used_ids(lines: DataFrame) -> DataFrame:
    """All ids that occur in raw text, in whatever key."""
    return lines.select(F.explode(F.regexp_extract_all("raw", F.lit(r"\bca_[A-Za-z0-9]{8}\b"), 0)).alias("id")).distinct()
