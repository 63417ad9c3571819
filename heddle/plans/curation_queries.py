"""Queries on curation steps and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators import curation, graph
from heddle.plans import bindings as B

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""WITH {B.EDGES}, w AS (SELECT p AS id, count(*) AS weight FROM edge GROUP BY 1), t AS (SELECT a.id, a.discipline, a.stage, coalesce(w.weight, 0) AS weight FROM anchor a LEFT JOIN w USING (id)),
s AS (SELECT u.upto, t.*, row_number() OVER (PARTITION BY u.upto, t.discipline ORDER BY t.weight DESC, t.id) AS round FROM t JOIN (SELECT DISTINCT stage AS upto FROM t) u ON t.stage <= u.upto QUALIFY round <= 4)
SELECT x.id AS a, s.id AS p, row_number() OVER (PARTITION BY x.id ORDER BY s.round, s.weight DESC, s.id) AS nth FROM t x JOIN s ON s.upto = x.stage AND s.discipline <> x.discipline AND s.id <> x.id QUALIFY nth <= 12""")
def cross_pool(spark, sf_dir: str) -> DataFrame:
    """Candidates of other disciplines in turn, twelve a target."""
    w = B.edges(spark, sf_dir).groupBy(F.col("p").alias("id")).agg(F.count(F.lit(1)).alias("weight"))
    return curation.cross_pool(B.anchors(spark, sf_dir).select("id", "discipline", "stage"), w).select("a", "p", F.col("nth").cast("long").alias("nth"))


@query(f"""WITH {B.ANCHORS} SELECT discipline, id, status, row_number() OVER (PARTITION BY discipline ORDER BY CASE WHEN status = 'auto-confirmed' THEN 0 ELSE 1 END, statement, id) AS nth FROM anchor WHERE NOT deprecated AND stage <= 6 AND stage + 1 >= 5""")
def child_view(spark, sf_dir: str) -> DataFrame:
    a = B.anchors(spark, sf_dir).filter("not deprecated").select("id", "discipline", "status", "statement", F.col("stage").alias("stage_min"), (F.col("stage") + 1).alias("stage_max"))
    return curation.child_view(a, 5, 6).select("discipline", "id", "status", F.col("nth").cast("long").alias("nth"))


@query(f"""WITH {B.ANCHORS} SELECT id, discipline, stage, statement FROM anchor WHERE status = 'disputed' AND contains(lower(CAST(id AS VARCHAR) || ' ' || statement || ' ' || discipline || coalesce(' ' || strand, '')), 'gear')""")
def catalogue_rows(spark, sf_dir: str) -> DataFrame:
    return curation.catalogue(B.anchors(spark, sf_dir), F.col("status") == "disputed", "gear").select("id", "discipline", "stage", "statement")


@query(f"""WITH {B.ANCHORS} SELECT id, field, value, value IS NULL AS empty FROM (SELECT id, unnest(['statement', 'strand', 'course']) AS field, unnest([statement, strand, course]) AS value FROM anchor)""")
def anchor_detail(spark, sf_dir: str) -> DataFrame:
    return curation.detail(B.anchors(spark, sf_dir), ["statement", "strand", "course"])


@query(f"""WITH RECURSIVE {B.REACH} SELECT p AS root, count(*) AS n_descendants FROM reach GROUP BY 1""")
def descendant_sizes(spark, sf_dir: str) -> DataFrame:
    d = graph.descendants(B.edges(spark, sf_dir), B.anchors(spark, sf_dir))
    return d.groupBy("root").agg(F.count(F.lit(1)).alias("n_descendants"))
