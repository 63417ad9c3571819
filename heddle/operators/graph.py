"""Graph operators on edge tables (a depends on p).

Iterations are driver loops of DataFrames; each round is written to the shared folder, and joins only the pairs that the
last round found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from heddle.sources.tables import settled


def inference_edges(edges: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Not retired, flagged neither out of the graph nor as convention (null stays in), both ends live."""
    have = set(edges.columns)
    keep = F.lit(True)
    if "inInferenceGraph" in have:
        keep &= F.coalesce(F.col("inInferenceGraph"), F.lit(True))
    if "type" in have:
        keep &= F.coalesce(F.col("type") != "convention", F.lit(True))
    if "retired" in have:
        keep &= ~F.coalesce(F.col("retired"), F.lit(False))
    out = edges.filter(keep)
    if live is not None:
        for end in ("a", "p"):
            out = out.join(live.select(F.col("id").alias(end)), end, "left_semi")
    return out


def closure(edges: DataFrame, rounds: int = 200, loops: bool = False) -> DataFrame:
    """(a, p, hops): p is reachable from a, in least hops. Semi-naive: a round joins only what was new in the last.

    loops: vertices on a cycle reach themselves, and are listed too.
    """
    step = settled(edges.select("a", "p").filter("a <> p").distinct())
    reach = fresh = step.withColumn("hops", F.lit(1))
    parts = [fresh]
    for hops in range(2, rounds + 2):
        nxt = fresh.select("a", F.col("p").alias("m")).join(step.select(F.col("a").alias("m"), "p"), "m").select("a", "p").filter(F.lit(loops) | (F.col("a") != F.col("p"))).distinct()
        fresh = settled(nxt.join(reach, ["a", "p"], "left_anti").withColumn("hops", F.lit(hops)))
        if fresh.isEmpty():
            return reach
        parts.append(fresh)
        reach = reach.union(fresh)
        if len(parts) % 8 == 0:
            reach = settled(reach)
    raise ValueError(f"no closure in {rounds} rounds")


def cycle_core(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """What is left when vertices without a way in or out are peeled off: empty if and only if there is no cycle."""
    now = settled(edges.select("a", "p").distinct())
    n = now.count()
    for _ in range(rounds):
        nxt = now.join(now.select(F.col("p").alias("a")).distinct(), "a", "left_semi").join(now.select(F.col("a").alias("p")).distinct(), "p", "left_semi").select("a", "p")
        now = settled(nxt)
        before, n = n, now.count()
        if n == 0 or n == before:
            return now
    raise ValueError(f"not peeled in {rounds} rounds")


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id) of components of more than one vertex."""
    core = cycle_core(edges.filter("a <> p"))
    reach = closure(core)
    mutual = reach.select("a", "p").join(reach.select(F.col("p").alias("a"), F.col("a").alias("p")), ["a", "p"])
    return mutual.groupBy(F.col("a").alias("id")).agg(F.least(F.min("p"), F.first("a")).alias("component"))


def edge_faults(edges: DataFrame) -> DataFrame:
    """a, p, fault: self-loop, duplicate or two-cycle."""
    e = edges.select("a", "p")
    dup = e.groupBy("a", "p").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "p", F.lit("duplicate").alias("fault"))
    d = e.filter("a <> p").distinct()
    two = d.join(d.select(F.col("p").alias("a"), F.col("a").alias("p")), ["a", "p"], "left_semi").select("a", "p", F.lit("two-cycle").alias("fault"))
    return e.filter("a = p").distinct().select("a", "p", F.lit("self-loop").alias("fault")).union(dup).union(two)


def redundancy(edges: DataFrame) -> DataFrame:
    """Each distinct edge with alt_hops (null: not redundant), the least hops of another way from a to p.

    On an acyclic graph another way starts at another direct prerequisite m and goes on from m to p; a cyclic one fails.
    """
    e = settled(edges.select("a", "p").filter("a <> p").distinct())
    reach = settled(closure(e, loops=True))
    if not reach.filter("a = p").isEmpty():
        raise ValueError("transitive redundancy needs an acyclic graph")
    ways = e.join(e.select("a", F.col("p").alias("m")), "a").filter("m <> p").join(reach.select(F.col("a").alias("m"), "p", "hops"), ["m", "p"])
    return e.join(ways.groupBy("a", "p").agg((F.min("hops") + 1).alias("alt_hops")), ["a", "p"], "left")


def alternative_paths(edges: DataFrame, of: DataFrame) -> DataFrame:
    """a, p, path: the first of the shortest other ways of each edge in `of`, compared place by place."""
    step = edges.select("a", "p").filter("a <> p").distinct()
    goal = of.select("a", "p").distinct()
    now = goal.join(step.select("a", F.col("p").alias("at")), "a").filter("at <> p").select("a", "p", "at", F.array("a", "at").alias("path"))
    done = None
    for _ in range(200):
        now = settled(now.groupBy("a", "p", "at").agg(F.min("path").alias("path")))
        nxt = now.join(step.select(F.col("a").alias("at"), F.col("p").alias("to")), "at").filter(~F.expr("array_contains(path, to)")).select("a", "p", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
        nxt = settled(nxt)
        hit = nxt.filter("at = p").groupBy("a", "p").agg(F.min("path").alias("path"))
        done = hit if done is None else done.union(hit)
        done = settled(done)
        now = nxt.filter("at <> p").join(done.select("a", "p"), ["a", "p"], "left_anti")
        if now.isEmpty():
            return done
    raise ValueError("paths longer than 200")


def group_detour(edges: DataFrame, group: Column) -> DataFrame:
    """For edges of a group: hops of the way round when the whole group is taken out (null: none)."""
    marked = edges.withColumn("_g", F.coalesce(group, F.lit(False)))
    rest = closure(marked.filter("not _g").select("a", "p"))
    return marked.filter("_g").select("a", "p").distinct().join(rest.withColumnRenamed("hops", "detour"), ["a", "p"], "left")


def ancestors(edges: DataFrame, of: DataFrame, rounds: int = 200) -> DataFrame:
    """root, id, hops: all that each of `of` (id) depends on; a breadth-first search from those seeds only.

    A round writes only what it has found; the rounds before are read where they lie.
    """
    step = settled(edges.select("a", "p").filter("a <> p").distinct())
    last = settled(of.select(F.col("id").alias("root"), F.col("id"), F.lit(0).alias("hops")).distinct())
    parts = [last]
    for hops in range(1, rounds + 1):
        nxt = last.select("root", F.col("id").alias("a")).join(step, "a").select("root", F.col("p").alias("id")).distinct()
        seen = parts[0]
        for part in parts[1:]:
            seen = seen.union(part)
        last = settled(nxt.join(seen, ["root", "id"], "left_anti").withColumn("hops", F.lit(hops)))
        if last.isEmpty():
            return seen.filter("hops > 0")
        parts.append(last)
        if len(parts) % 16 == 0:
            parts = [settled(seen.union(last))]
    raise ValueError(f"not closed in {rounds} rounds")


def descendants(edges: DataFrame, of: DataFrame, rounds: int = 200) -> DataFrame:
    return ancestors(edges.select(F.col("p").alias("a"), F.col("a").alias("p")), of, rounds)


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("p").alias("id"))).distinct()
    return vertices.join(ends, "id", "left_anti")


def neighbourhood(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, direct prerequisites and dependents as sorted arrays."""
    pre = edges.groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_set("p")).alias("prerequisites"))
    dep = edges.groupBy(F.col("p").alias("id")).agg(F.array_sort(F.collect_set("a")).alias("dependents"))
    return vertices.select("id").join(pre, "id", "left").join(dep, "id", "left")


def retire(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges with the first reason to retire: missing end, dead end, stage inversion, cycle (null: stays).

    Of a cycle every edge that lies in the peeled core and goes to a larger id is named, so that the choice does not
    depend on a visiting order.
    """
    end = lambda side: anchors.select(F.col("id").alias(side), F.lit(True).alias(f"{side}_there"), F.coalesce("deprecated", F.lit(False)).alias(f"{side}_dead"), F.col("stage_min").alias(f"{side}_min"), F.col("stage_max").alias(f"{side}_max"))
    j = edges.join(end("a"), "a", "left").join(end("p"), "p", "left")
    core = cycle_core(edges.filter("a <> p")).withColumn("in_core", F.lit(True))
    j = j.join(core, ["a", "p"], "left")
    reason = (
        F.when(F.col("a_there").isNull() | F.col("p_there").isNull(), "missing end")
        .when(F.col("a_dead") | F.col("p_dead"), "dead end")
        .when(F.col("p_min") > F.col("a_max"), "stage inversion")
        .when(F.coalesce("in_core", F.lit(False)) & (F.col("a") < F.col("p")), "cycle")
    )
    return j.withColumn("reason_to_retire", reason).select(*edges.columns, "reason_to_retire")


def greedy_acyclic(edges: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Edges taken in order unless they close a cycle, group by group (each decision needs the ones before it)."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        below: dict = {}
        kept = []
        for row in pdf.sort_values(order, kind="stable").itertuples(index=False):
            stack, seen, closes = [row.p], set(), row.a == row.p
            while stack and not closes:
                x = stack.pop()
                for y in below.get(x, ()):
                    if y == row.a:
                        closes = True
                        break
                    if y not in seen:
                        seen.add(y)
                        stack.append(y)
            if not closes:
                below.setdefault(row.a, set()).add(row.p)
            kept.append(not closes)
        out = pdf.sort_values(order, kind="stable").copy()
        out["kept"] = kept
        return out

    return edges.groupBy(group).applyInPandas(run, StructType([*edges.schema.fields, StructField("kept", BooleanType())]))


def span_first(later: Column, earlier: Column, unknown: int = 5) -> Column:
    """Sort key that puts edges over many stages first, as they are the likelier prerequisites; ties keep their order."""
    return F.coalesce(earlier, F.lit(unknown)) - F.coalesce(later, F.lit(unknown))


def in_degree_over(edges: DataFrame, limit: int = 8) -> DataFrame:
    return edges.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)


def pool(targets: DataFrame, per_key: int = 3) -> DataFrame:
    """Prerequisite candidates: the first `per_key` earlier anchors of the same discipline, in the order same strand,
    nearest stage, smallest id; earlier means a smaller (stage, id).

    Only the smallest `per_key` ids of each (discipline, strand, stage) can be among them, so targets meet that short
    list instead of all anchors of their discipline.
    """
    t = targets.select("id", "discipline", "strand", "stage")
    first = Window.partitionBy("discipline", "strand", "stage").orderBy("id")
    short = settled(t.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_key).select("discipline", F.col("strand").alias("p_strand"), F.col("stage").alias("p_stage"), F.col("id").alias("p")))
    pairs = t.join(short, "discipline").filter("p_stage < stage or (p_stage = stage and p < id)")
    best = Window.partitionBy("id").orderBy(F.when(F.col("p_strand") == F.col("strand"), 0).otherwise(1), F.col("stage") - F.col("p_stage"), "p")
    return pairs.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= per_key).select(F.col("id").alias("a"), "p", "nth")
