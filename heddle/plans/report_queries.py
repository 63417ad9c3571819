"""Queries of report tables over the anchor graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators import reports
from heddle.plans import bindings as B
from heddle.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Edges with a label's further fields; the same in SQL.
LABELLED = (
    B.EDGES
    + """,
labelled AS (SELECT *, nth < 3 AS in_graph, (a + p) % 7 = 0 AS capped, CASE WHEN a % 4 <> 0 THEN 'leaves out the step of part ' || CAST(p % 150 AS VARCHAR) END AS signature FROM edge)"""
)


def labelled(spark, sf_dir: str) -> DataFrame:
    e = B.edges(spark, sf_dir)
    signature = F.when(F.col("a") % 4 != 0, F.concat(F.lit("leaves out the step of part "), (F.col("p") % 150).cast("string")))
    capped = F.when((F.col("a") + F.col("p")) % 7 == 0, "track rule")
    return e.withColumn("inInferenceGraph", F.col("nth") < 3).withColumn("strengthCappedBy", capped).withColumn("failureSignature", signature)


@query(f"""WITH {LABELLED} SELECT type, count(*) AS n, count(*) FILTER (type <> 'convention' AND in_graph) AS n_in_graph, count(*) FILTER (strength = 'hard') AS n_hard, count(*) FILTER (capped) AS n_capped,
  count(signature) AS n_signed, count(DISTINCT signature) AS n_signatures, CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM edge) AS DOUBLE) AS share FROM labelled GROUP BY 1""")
def edge_label_summary(spark, sf_dir: str) -> DataFrame:
    return reports.edge_labels(labelled(spark, sf_dir))


@query(f"""WITH {LABELLED}, s AS (SELECT CAST(length(signature) AS BIGINT) AS l FROM labelled WHERE signature IS NOT NULL AND type <> 'convention')
SELECT list_sort(list(l))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS length FROM s""")
def signature_median(spark, sf_dir: str) -> DataFrame:
    return reports.signature_length(labelled(spark, sf_dir)).select(F.col("length").cast("long").alias("length"))


def placed(spark, sf_dir: str) -> DataFrame:
    """Edges with the pool's size and the choice as their evidence words them."""
    note = F.concat(F.lit("候选池 "), (5 + F.col("a") % 40).cast("string"), F.lit(" 选 "), (1 + F.col("p") % 17).cast("string"))
    e = B.edges(spark, sf_dir).withColumn("evidence", F.array(F.struct(F.lit("llm").alias("kind"), F.when(F.col("a") % 9 != 0, note).alias("detail"))))
    return e.withColumn("_at", reports.pool_place(F.col("evidence"))).select("*", "_at.*")


@query(f"""WITH {B.EDGES} SELECT 5 + a % 40 - (5 + a % 40) % 10 AS pool_from, count(*) AS n, count(*) FILTER (strength = 'hard') AS n_flagged FROM edge WHERE a % 9 <> 0 GROUP BY 1""")
def pool_size_rates(spark, sf_dir: str) -> DataFrame:
    return reports.rates(placed(spark, sf_dir), "pool_from", F.col("strength") == "hard")


@query(f"""WITH {B.EDGES} SELECT p % 17 - (p % 17) % 5 AS rank_from, count(*) AS n, count(*) FILTER (strength = 'hard') AS n_flagged FROM edge WHERE a % 9 <> 0 GROUP BY 1""")
def choice_rank_rates(spark, sf_dir: str) -> DataFrame:
    return reports.rates(placed(spark, sf_dir), "rank_from", F.col("strength") == "hard")


@query("""WITH x AS (SELECT DISTINCT l_partkey AS part, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_orderkey % 4 <> 0), b AS (SELECT part, n, coalesce(lag(n) OVER (PARTITION BY part ORDER BY n), 0) AS b FROM x)
SELECT part, b + 1 AS "from", n - 1 AS "to" FROM b WHERE n > b + 1""")
def code_holes(spark, sf_dir: str) -> DataFrame:
    """Line numbers as the last level of codes; a quarter of the codes has two levels and is not checked."""
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_suppkey", "l_linenumber")
    code = F.when(F.col("l_orderkey") % 4 != 0, F.concat_ws(".", "l_suppkey", "l_partkey", "l_linenumber")).otherwise(F.concat_ws(".", "l_partkey", "l_linenumber"))
    return reports.code_holes(li.select(F.col("l_partkey").alias("part"), code.alias("code")), ["part"], "code")


@query(f"""WITH {B.ANCHORS}, x AS (SELECT *, stage AS lo, CASE WHEN stage = 1 AND id % 2 = 0 THEN 9 ELSE least(stage + id % 3, 12) END AS hi, NOT deprecated AND status IN {B.CITABLE} AS usable, NOT deprecated AND id % 4 = 0 AS of_text FROM anchor)
SELECT count(*) AS n_all, count(*) FILTER (NOT deprecated) AS n_live, count(*) FILTER (usable) AS n_usable, count(*) FILTER (usable AND status = 'expert-confirmed') AS n_human, count(*) FILTER (usable AND status = 'ai-adjudicated') AS n_adjudicated,
  count(*) FILTER (usable AND status = 'auto-confirmed') AS n_objective, count(*) FILTER (NOT deprecated AND NOT usable) AS n_pending, count(*) FILTER (usable AND hi - lo <= 1) AS n_narrow, CAST(max(hi) FILTER (NOT deprecated) AS BIGINT) AS last_grade,
  count(*) FILTER (NOT deprecated AND strand IS NOT NULL) AS n_tagged, count(*) FILTER (NOT deprecated AND course = 'required') AS n_targeted, coalesce(CAST(count(*) FILTER (of_text AND lo = 1 AND hi = 9) AS DOUBLE) / nullif(count(*) FILTER (of_text), 0), 1.0) AS default_share FROM x""")
def state_snapshot(spark, sf_dir: str) -> DataFrame:
    a = B.anchors(spark, sf_dir)
    hi = F.when((F.col("stage") == 1) & (F.col("id") % 2 == 0), 9).otherwise(F.least(F.col("stage") + F.col("id") % 3, F.lit(12)))
    source = F.when(F.col("id") % 4 == 0, "curriculum-content")
    return reports.state(a.select("status", "deprecated", F.col("stage").alias("lo"), hi.alias("hi"), F.col("strand").isNotNull().alias("tagged"), (F.col("course") == "required").alias("targeted"), source.alias("evidenceSource")))
