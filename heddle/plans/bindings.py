"""The driver tables read as a curated graph: parts are anchors, earlier parts of a brand their prerequisites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import graph
from heddle.sources.tables import settled, table

STATUSES = ("auto-confirmed", "expert-confirmed", "ai-adjudicated", "ai-reviewed", "llm-proposed", "disputed")
TYPES = ("component", "semantic", "instrument", "convention")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def band(stage: Column) -> Column:
    """0: up to 2, 1: up to 4, 2: up to 6, 3: up to 9, 4: above."""
    return F.when(stage <= 2, 0).when(stage <= 4, 1).when(stage <= 6, 2).when(stage <= 9, 3).otherwise(4)


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    i = F.col("p_partkey")
    stage = (1 + (F.col("p_size") - 1) % 12).cast("long")
    return p.select(
        i.alias("id"), F.col("p_name").alias("statement"), F.col("p_brand").alias("discipline"), F.when(i % 11 != 0, F.col("p_type")).alias("strand"), stage.alias("stage"), band(stage).cast("long").alias("band"),
        (i % 13 == 0).alias("deprecated"), pick(STATUSES, i % 6).alias("status"), F.when(i % 3 == 0, "required").when(i % 3 == 1, "elective").alias("course"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, p, nth, type, strength: up to three earlier parts of the same brand."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    t = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("discipline"), F.col("p_type").alias("strand"), (1 + (F.col("p_size") - 1) % 12).cast("long").alias("stage"))
    e = graph.pool(t)
    mix = F.col("a") * 31 + F.col("p")
    return settled(e.select("a", "p", F.col("nth").cast("long").alias("nth"), pick(TYPES, mix % 4).alias("type"), F.when(mix % 2 == 0, "hard").otherwise("soft").alias("strength")))


#: The same in DuckDB SQL: a, e.
ANCHORS = """
anchor AS (
  SELECT p_partkey AS id, p_name AS statement, p_brand AS discipline, CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS strand,
    CAST(1 + (p_size - 1) % 12 AS BIGINT) AS stage, p_partkey % 13 = 0 AS deprecated,
    (['auto-confirmed', 'expert-confirmed', 'ai-adjudicated', 'ai-reviewed', 'llm-proposed', 'disputed'])[p_partkey % 6 + 1] AS status,
    CASE p_partkey % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'elective' END AS course, p_type AS full_strand,
    CASE WHEN 1 + (p_size - 1) % 12 <= 2 THEN 0 WHEN 1 + (p_size - 1) % 12 <= 4 THEN 1 WHEN 1 + (p_size - 1) % 12 <= 6 THEN 2 WHEN 1 + (p_size - 1) % 12 <= 9 THEN 3 ELSE 4 END AS band
  FROM part)"""
EDGES = (
    ANCHORS
    + """,
edge AS (
  SELECT a, p, nth, (['component', 'semantic', 'instrument', 'convention'])[(a * 31 + p) % 4 + 1] AS type, CASE WHEN (a * 31 + p) % 2 = 0 THEN 'hard' ELSE 'soft' END AS strength
  FROM (SELECT x.id AS a, y.id AS p, row_number() OVER (PARTITION BY x.id ORDER BY CASE WHEN x.full_strand = y.full_strand THEN 0 ELSE 1 END, x.stage - y.stage, y.id) AS nth
    FROM anchor x JOIN anchor y ON x.discipline = y.discipline AND (y.stage < x.stage OR (y.stage = x.stage AND y.id < x.id)))
  WHERE nth <= 3)"""
)
REACH = (
    EDGES
    + """,
reach AS (SELECT a, p FROM edge UNION SELECT r.a, e.p FROM reach r JOIN edge e ON r.p = e.a)"""
)
CITABLE = "('auto-confirmed', 'expert-confirmed', 'ai-adjudicated', 'ai-reviewed')"
