"""Queries over the anchor graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators import graph, metrics, profile
from heddle.plans import bindings as B
from heddle.sources.tables import settled, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""WITH {B.EDGES},
gated AS (SELECT l_partkey AS id, count(*) AS gated FROM lineitem GROUP BY 1),
down AS (SELECT p AS id, count(*) AS downstream FROM edge GROUP BY 1),
scored AS (SELECT a.id, a.discipline, coalesce(g.gated, 0) AS gated, coalesce(d.downstream, 0) AS downstream, coalesce(g.gated, 0) + 3 * coalesce(d.downstream, 0) AS leverage
  FROM anchor a LEFT JOIN gated g USING (id) LEFT JOIN down d USING (id) WHERE NOT a.deprecated)
SELECT id, discipline, CAST(gated AS BIGINT) AS gated, CAST(downstream AS BIGINT) AS downstream, CAST(leverage AS BIGINT) AS leverage,
  row_number() OVER (ORDER BY leverage DESC, discipline, id) AS rank FROM scored QUALIFY rank <= 120""")
def leverage_queue(spark, sf_dir: str) -> DataFrame:
    """Review queue: gated list items and three times the direct dependents, the 120 first."""
    items = table(spark, sf_dir, "lineitem", "l_partkey").select(F.col("l_partkey").alias("id"))
    return profile.review_queue(B.anchors(spark, sf_dir).filter(~F.col("deprecated")), items, B.edges(spark, sf_dir), top=120)


@query(f"""WITH {B.EDGES},
gated AS (SELECT l_partkey AS id, count(*) AS gated FROM lineitem GROUP BY 1),
down AS (SELECT p AS id, count(*) AS downstream FROM edge GROUP BY 1),
scored AS (SELECT a.id, a.discipline, coalesce(g.gated, 0) + 3 * coalesce(d.downstream, 0) AS leverage FROM anchor a LEFT JOIN gated g USING (id) LEFT JOIN down d USING (id) WHERE NOT a.deprecated),
total AS (SELECT sum(leverage) AS t FROM scored),
top AS (SELECT *, row_number() OVER (ORDER BY leverage DESC, discipline, id) AS rank FROM scored QUALIFY rank <= 120)
SELECT rank, id, CAST(sum(leverage) OVER (ORDER BY rank) AS DOUBLE) / t AS cumulative_share FROM top, total""")
def leverage_share(spark, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem", "l_partkey").select(F.col("l_partkey").alias("id"))
    return profile.cumulative_share(B.anchors(spark, sf_dir).filter(~F.col("deprecated")), items, B.edges(spark, sf_dir), top=120)


@query(f"""WITH {B.EDGES} SELECT p AS id, count(*) AS n FROM edge GROUP BY 1 HAVING count(*) > 8""")
def high_out_degree(spark, sf_dir: str) -> DataFrame:
    e = B.edges(spark, sf_dir)
    return graph.in_degree_over(e.select(F.col("p").alias("a"), F.col("a").alias("p")))


@query(f"""WITH {B.ANCHORS} SELECT discipline, count(*) FILTER (band = 0) AS band0, count(*) FILTER (band = 1) AS band1, count(*) FILTER (band = 2) AS band2, count(*) FILTER (band = 3) AS band3, count(*) FILTER (band = 4) AS band4, count(*) AS total
FROM anchor WHERE NOT deprecated GROUP BY 1""")
def coverage_matrix(spark, sf_dir: str) -> DataFrame:
    return metrics.coverage_matrix(B.anchors(spark, sf_dir).filter(~F.col("deprecated")))


@query(f"""WITH {B.ANCHORS}, cell AS (SELECT discipline, band, count(*) AS n FROM anchor WHERE NOT deprecated GROUP BY 1, 2)
SELECT list_sort(list(n))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median, median(n) AS true_median, count(*) AS cells FROM cell""")
def cell_medians(spark, sf_dir: str) -> DataFrame:
    cells = B.anchors(spark, sf_dir).filter(~F.col("deprecated")).groupBy("discipline", "band").agg(F.count(F.lit(1)).alias("n"))
    upper = metrics.upper_median(cells, [], "n").select(F.col("n").alias("upper_median"), F.lit(1).alias("k"))
    return cells.agg(F.median("n").alias("true_median"), F.count(F.lit(1)).alias("cells")).withColumn("k", F.lit(1)).join(upper, "k", "left").drop("k")


@query(f"""WITH RECURSIVE {B.REACH} SELECT a, count(*) AS n_ancestors FROM reach GROUP BY 1""")
def closure_sizes(spark, sf_dir: str) -> DataFrame:
    return graph.closure(B.edges(spark, sf_dir)).groupBy("a").agg(F.count(F.lit(1)).alias("n_ancestors"))


@query(f"""WITH RECURSIVE {B.REACH}
SELECT e.a, e.p, EXISTS (SELECT 1 FROM edge m JOIN reach r ON r.a = m.p AND r.p = e.p WHERE m.a = e.a AND m.p <> e.p) AS redundant FROM edge e""")
def transitive_redundancy(spark, sf_dir: str) -> DataFrame:
    r = graph.redundancy(B.edges(spark, sf_dir))
    return r.select("a", "p", F.col("alt_hops").isNotNull().alias("redundant"))


@query(f"""WITH RECURSIVE {B.EDGES},
walk AS (SELECT a, p, 1 AS hops FROM edge UNION SELECT w.a, e.p, w.hops + 1 FROM walk w JOIN edge e ON w.p = e.a WHERE w.hops < 12),
dist AS (SELECT a, p, min(hops) AS hops FROM walk GROUP BY 1, 2)
SELECT e.a, e.p, CAST(min(d.hops) + 1 AS INTEGER) AS alt_hops FROM edge e JOIN edge m ON m.a = e.a AND m.p <> e.p JOIN dist d ON d.a = m.p AND d.p = e.p GROUP BY 1, 2""")
def alternative_hops(spark, sf_dir: str) -> DataFrame:
    return graph.redundancy(B.edges(spark, sf_dir)).filter("alt_hops is not null")


@query(f"""WITH RECURSIVE {B.REACH},
red AS (SELECT e.*, EXISTS (SELECT 1 FROM edge m JOIN reach r ON r.a = m.p AND r.p = e.p WHERE m.a = e.a AND m.p <> e.p) AS redundant FROM edge e),
rel AS (SELECT r.*, CASE WHEN x.strand IS NULL OR y.strand IS NULL THEN 'unk' WHEN x.strand = y.strand THEN 'same' ELSE 'diff' END AS strand_rel, x.band - y.band AS gap FROM red r JOIN anchor x ON x.id = r.a JOIN anchor y ON y.id = r.p)
SELECT strand_rel, CAST(gap AS BIGINT) AS gap, count(*) AS n_edges, count(*) FILTER (redundant) AS n_redundant, CAST(count(*) FILTER (redundant) AS DOUBLE) / count(*) AS rate FROM rel GROUP BY 1, 2""")
def redundancy_by_group(spark, sf_dir: str) -> DataFrame:
    e = B.edges(spark, sf_dir)
    r = graph.redundancy(e)
    a = B.anchors(spark, sf_dir).select("id", "strand", "band")
    x, y = (a.select(F.col("id").alias(k), F.col("strand").alias(f"strand_{k}"), F.col("band").alias(f"band_{k}")) for k in "ap")
    j = r.join(x, "a").join(y, "p").withColumn("strand_rel", metrics.relation("strand_a", "strand_p")).withColumn("gap", F.col("band_a") - F.col("band_p"))
    red = F.count(F.col("alt_hops"))
    return j.groupBy("strand_rel", "gap").agg(F.count(F.lit(1)).alias("n_edges"), red.alias("n_redundant"), (red / F.count(F.lit(1))).alias("rate"))


@query(f"""WITH RECURSIVE {B.REACH},
red AS (SELECT e.*, EXISTS (SELECT 1 FROM edge m JOIN reach r ON r.a = m.p AND r.p = e.p WHERE m.a = e.a AND m.p <> e.p) AS redundant FROM edge e),
degree AS (SELECT a, count(*) AS d FROM edge GROUP BY 1)
SELECT d AS in_degree, count(*) AS n_edges, CAST(sum(redundant::INT) AS BIGINT) AS n_redundant FROM red JOIN degree USING (a) GROUP BY 1""")
def redundancy_by_degree(spark, sf_dir: str) -> DataFrame:
    r = graph.redundancy(B.edges(spark, sf_dir))
    d = r.groupBy("a").agg(F.count(F.lit(1)).alias("in_degree"))
    return r.join(d, "a").groupBy("in_degree").agg(F.count(F.lit(1)).alias("n_edges"), F.count("alt_hops").alias("n_redundant"))


@query(f"""WITH RECURSIVE {B.REACH},
red AS (SELECT e.*, EXISTS (SELECT 1 FROM edge m JOIN reach r ON r.a = m.p AND r.p = e.p WHERE m.a = e.a AND m.p <> e.p) AS redundant FROM edge e),
walk AS (SELECT a, p FROM red WHERE NOT redundant UNION SELECT w.a, k.p FROM walk w JOIN red k ON w.p = k.a AND NOT k.redundant)
SELECT (SELECT count(*) FROM edge) AS n_edges, (SELECT count(*) FROM red WHERE NOT redundant) AS n_kept, (SELECT count(*) FROM (SELECT a, p FROM reach EXCEPT SELECT a, p FROM walk)) AS lost_pairs""")
def reduction_is_safe(spark, sf_dir: str) -> DataFrame:
    """Pairs that stop being reachable when all redundant edges are retired at once: none."""
    e = B.edges(spark, sf_dir)
    r = settled(graph.redundancy(e))
    kept = r.filter("alt_hops is null")
    lost = graph.closure(e).select("a", "p").join(graph.closure(kept).select("a", "p"), ["a", "p"], "left_anti")
    n = r.agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("alt_hops").isNull().cast("long")).alias("n_kept"))
    return n.withColumn("k", F.lit(1)).join(lost.agg(F.count(F.lit(1)).alias("lost_pairs")).withColumn("k", F.lit(1)), "k").drop("k")


@query(f"""WITH {B.EDGES} SELECT e.a, e.p, CAST(x.band - y.band AS BIGINT) AS gap FROM edge e JOIN anchor x ON x.id = e.a JOIN anchor y ON y.id = e.p WHERE x.band - y.band >= 2""")
def cross_band_edges(spark, sf_dir: str) -> DataFrame:
    a = B.anchors(spark, sf_dir).select("id", "band")
    j = B.edges(spark, sf_dir).join(a.select(F.col("id").alias("a"), F.col("band").alias("x")), "a").join(a.select(F.col("id").alias("p"), F.col("band").alias("y")), "p")
    return j.withColumn("gap", F.col("x") - F.col("y")).filter("gap >= 2").select("a", "p", "gap")


@query(f"""WITH {B.EDGES} SELECT id, discipline FROM anchor WHERE id NOT IN (SELECT a FROM edge WHERE type = 'component' UNION SELECT p FROM edge WHERE type = 'component')""")
def isolated_anchors(spark, sf_dir: str) -> DataFrame:
    return graph.isolated(B.anchors(spark, sf_dir), B.edges(spark, sf_dir).filter("type = 'component'")).select("id", "discipline")


@query(f"""WITH {B.EDGES} SELECT e.a, e.p, CASE WHEN x.id IS NULL OR y.id IS NULL THEN 'missing end' WHEN x.deprecated OR y.deprecated THEN 'dead end' WHEN y.stage > x.stage THEN 'stage inversion' END AS reason
FROM edge e LEFT JOIN (SELECT * FROM anchor WHERE id % 17 <> 0) x ON x.id = e.a LEFT JOIN (SELECT * FROM anchor WHERE id % 17 <> 0) y ON y.id = e.p""")
def edge_retirement(spark, sf_dir: str) -> DataFrame:
    a = B.anchors(spark, sf_dir).filter("id % 17 <> 0").select("id", "deprecated", F.col("stage").alias("stage_min"), F.col("stage").alias("stage_max"))
    return graph.retire(B.edges(spark, sf_dir).select("a", "p"), a).select("a", "p", F.col("reason_to_retire").alias("reason"))


@query(f"""WITH RECURSIVE {B.REACH}
SELECT r.a AS root, count(*) AS n_missing, CAST(min(x.stage) AS BIGINT) AS first_stage FROM reach r JOIN anchor x ON x.id = r.p WHERE x.id % 5 <> 0 GROUP BY 1""")
def missing_ancestors(spark, sf_dir: str) -> DataFrame:
    """What each anchor as a goal still needs: its ancestors less what is mastered (a fifth of all)."""
    a = B.anchors(spark, sf_dir)
    up = graph.ancestors(B.edges(spark, sf_dir), a).filter("id % 5 <> 0")
    return up.join(a.select("id", "stage"), "id").groupBy("root").agg(F.count(F.lit(1)).alias("n_missing"), F.min("stage").alias("first_stage"))


@query(f"""WITH {B.EDGES}, mastered AS (SELECT id FROM anchor WHERE id % 5 <> 1),
unmet AS (SELECT DISTINCT a FROM edge WHERE p NOT IN (SELECT id FROM mastered)), dep AS (SELECT p AS id, count(*) AS unlocks FROM edge GROUP BY 1)
SELECT x.id, x.stage, coalesce(d.unlocks, 0) AS unlocks, row_number() OVER (ORDER BY x.stage, coalesce(d.unlocks, 0) DESC, x.id) AS nth
FROM anchor x LEFT JOIN dep d USING (id) WHERE NOT x.deprecated AND x.id NOT IN (SELECT id FROM mastered) AND x.id NOT IN (SELECT a FROM unmet) QUALIFY nth <= 200""")
def ready_next(spark, sf_dir: str) -> DataFrame:
    a = B.anchors(spark, sf_dir).filter(~F.col("deprecated"))
    return profile.ready(a, B.edges(spark, sf_dir), B.anchors(spark, sf_dir).filter("id % 5 <> 1").select("id"), top=200)


@query(f"""WITH {B.EDGES}, touched AS (SELECT id FROM anchor WHERE id % 7 = 0), evidenced AS (SELECT id FROM anchor WHERE id % 2 = 0 OR id % 7 = 0),
h AS (SELECT a, count(*) AS n, count(*) FILTER (p IN (SELECT id FROM evidenced)) AS ok FROM edge WHERE type IN ('component', 'semantic') AND strength = 'hard' AND a <> p GROUP BY 1)
SELECT x.id, x.discipline, h.n AS n_hard FROM anchor x JOIN h ON h.a = x.id
WHERE NOT x.deprecated AND x.stage <= 8 AND x.course = 'required' AND x.id NOT IN (SELECT id FROM touched) AND h.n >= 1 AND h.n = h.ok""")
def avoided(spark, sf_dir: str) -> DataFrame:
    """In reach and required, yet left out of the work."""
    a = B.anchors(spark, sf_dir).select("id", "discipline", "deprecated", F.lit(1).alias("stage_min"), F.greatest(F.lit(8), F.col("stage")).alias("stage_max"), "course", "stage")
    a = a.withColumn("stage_min", F.col("stage")).withColumn("stage_max", F.lit(12))
    ids = B.anchors(spark, sf_dir).select("id")
    return profile.avoided(a, B.edges(spark, sf_dir), ids.filter("id % 7 = 0"), ids.filter("id % 2 = 0 or id % 7 = 0"), grade=8).select("id", "discipline", "n_hard")


@query(f"""WITH {B.EDGES}, touched AS (SELECT id FROM anchor WHERE id % 7 = 0), evidenced AS (SELECT id FROM anchor WHERE id % 2 = 0 OR id % 7 = 0),
h AS (SELECT a, count(*) AS n, count(*) FILTER (p IN (SELECT id FROM evidenced)) AS ok FROM edge WHERE type IN ('component', 'semantic') AND strength = 'hard' AND a <> p GROUP BY 1),
s AS (SELECT NOT x.deprecated AS f1, x.stage <= 8 AS f2, coalesce(x.course = 'required', false) AS f3, x.id NOT IN (SELECT id FROM touched) AS f4, coalesce(h.n, 0) >= 1 AS f5, coalesce(h.n = h.ok, false) AS f6 FROM anchor x LEFT JOIN h ON h.a = x.id)
SELECT count(*) AS n_all, count(*) FILTER (f1) AS n_live, count(*) FILTER (f1 AND f2) AS n_in_stage, count(*) FILTER (f1 AND f2 AND f3) AS n_required, count(*) FILTER (f1 AND f2 AND f3 AND f4) AS n_untouched,
  count(*) FILTER (f1 AND f2 AND f3 AND f4 AND f5) AS n_with_hard, count(*) FILTER (f1 AND f2 AND f3 AND f4 AND f5 AND f6) AS n_avoided FROM s""")
def avoided_funnel(spark, sf_dir: str) -> DataFrame:
    a = B.anchors(spark, sf_dir).select("id", "discipline", "deprecated", F.col("stage").alias("stage_min"), F.lit(12).alias("stage_max"), "course")
    ids = B.anchors(spark, sf_dir).select("id")
    return profile.avoided_funnel(a, B.edges(spark, sf_dir), ids.filter("id % 7 = 0"), ids.filter("id % 2 = 0 or id % 7 = 0"), grade=8)


@query(f"""WITH {B.EDGES} SELECT a, p, nth FROM edge""")
def candidate_pool(spark, sf_dir: str) -> DataFrame:
    return B.edges(spark, sf_dir).select("a", "p", "nth")


@query(f"""WITH {B.EDGES}, cite AS (SELECT id FROM anchor WHERE NOT deprecated AND status IN {B.CITABLE})
SELECT count(*) AS n_edges, count(*) FILTER (a IN (SELECT id FROM cite) AND p IN (SELECT id FROM cite)) AS n_both_citable, count(*) FILTER (type = 'convention') AS n_convention, count(*) FILTER (strength = 'hard') AS n_hard FROM edge""")
def edge_numbers(spark, sf_dir: str) -> DataFrame:
    cite = metrics.citable(B.anchors(spark, sf_dir)).select("id", F.lit(True).alias("ok"))
    e = B.edges(spark, sf_dir).join(cite.select(F.col("id").alias("a"), F.col("ok").alias("x")), "a", "left").join(cite.select(F.col("id").alias("p"), F.col("ok").alias("y")), "p", "left")
    n = lambda c: F.count(F.when(c, 1))
    return e.agg(F.count(F.lit(1)).alias("n_edges"), n(F.col("x") & F.col("y")).alias("n_both_citable"), n(F.col("type") == "convention").alias("n_convention"), n(F.col("strength") == "hard").alias("n_hard"))


@query(f"""WITH {B.EDGES} SELECT x.id, coalesce((SELECT string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FROM edge WHERE a = x.id), '') AS prerequisites,
  (SELECT count(*) FROM edge WHERE p = x.id) AS n_dependents FROM anchor x""")
def neighbourhood_panel(spark, sf_dir: str) -> DataFrame:
    n = graph.neighbourhood(B.anchors(spark, sf_dir), B.edges(spark, sf_dir))
    return n.select("id", F.coalesce(F.array_join(F.col("prerequisites").cast("array<string>"), ","), F.lit("")).alias("prerequisites"), F.coalesce(F.size("dependents"), F.lit(0)).cast("long").alias("n_dependents")).withColumn("n_dependents", F.greatest("n_dependents", F.lit(0)))


@query(f"""WITH {B.EDGES}, d AS (SELECT a.id, e.a AS dep, row_number() OVER (PARTITION BY a.id ORDER BY x.stage, e.a) AS nth FROM anchor a JOIN edge e ON e.p = a.id JOIN anchor x ON x.id = e.a)
SELECT id, dep, nth FROM d WHERE nth <= 24""")
def dependents_by_stage(spark, sf_dir: str) -> DataFrame:
    a = B.anchors(spark, sf_dir).select(F.col("id").alias("a"), "stage")
    w = Window.partitionBy("p").orderBy("stage", "a")
    return B.edges(spark, sf_dir).join(a, "a").withColumn("nth", F.row_number().over(w).cast("long")).filter("nth <= 24").select(F.col("p").alias("id"), F.col("a").alias("dep"), "nth")


@query(f"""WITH {B.EDGES}, doomed AS (SELECT id, min(id) OVER (PARTITION BY discipline, statement) AS keep FROM anchor),
moved AS (SELECT DISTINCT x.keep AS a, y.keep AS p FROM edge e JOIN doomed x ON x.id = e.a JOIN doomed y ON y.id = e.p) SELECT a, p FROM moved WHERE a <> p""")
def repoint_edges(spark, sf_dir: str) -> DataFrame:
    from heddle.operators import dedup

    a = B.anchors(spark, sf_dir)
    survivors = dedup.exact_groups(a.select("id", "discipline", "statement"), ["discipline", "statement"])
    return dedup.repoint(B.edges(spark, sf_dir).select("a", "p"), survivors)
