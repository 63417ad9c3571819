"""Profile questions: what to review first, what is next, what is missing, what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leverage(anchors: DataFrame, items: DataFrame, edges: DataFrame) -> DataFrame:
    """anchors with gated (their list items), downstream (direct dependents) and leverage = gated + 3 * downstream."""
    gated = items.groupBy("id").agg(F.count(F.lit(1)).alias("gated"))
    down = edges.groupBy(F.col("p").alias("id")).agg(F.count(F.lit(1)).alias("downstream"))
    j = anchors.join(gated, "id", "left").join(down, "id", "left").na.fill(0, ["gated", "downstream"])
    return j.withColumn("leverage", F.col("gated") + 3 * F.col("downstream"))


def _top(anchors: DataFrame, items: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    order = [F.desc("leverage"), F.col("discipline"), F.col("id")]
    best = leverage(anchors, items, edges).orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # over `top` rows


def review_queue(anchors: DataFrame, items: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    return _top(anchors, items, edges, top).select("id", "discipline", "gated", "downstream", "leverage", "rank")


def cumulative_share(anchors: DataFrame, items: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    """Of the first `top`: the share of all leverage that they and those before them have."""
    total = leverage(anchors, items, edges).agg(F.sum("leverage").alias("t")).withColumn("k", F.lit(1))
    run = F.sum("leverage").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return _top(anchors, items, edges, top).withColumn("run", run).withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select("rank", "id", (F.col("run").cast("double") / F.col("t")).alias("cumulative_share"))


def structural_hard(edges: DataFrame) -> DataFrame:
    return edges.filter("type in ('component', 'semantic') and strength = 'hard' and a <> p").select("a", "p").distinct()


def required(policy: str = "strict", grade: int | None = None) -> Column:
    """strict: an unknown course type is not required; lenient: it is, in grades up to 9."""
    known = F.col("course") == "required"
    unknown = F.coalesce("course", F.lit("")) == ""
    return F.coalesce(known, F.lit(False)) | (unknown & F.lit(policy == "lenient" and grade is not None and grade <= 9))


def _flagged(anchors: DataFrame, edges: DataFrame, touched: DataFrame, evidenced: DataFrame, grade: int, policy: str) -> DataFrame:
    seen = evidenced.select(F.col("id").alias("p"), F.lit(1).alias("ev")).distinct()
    hard = structural_hard(edges).join(seen, "p", "left").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_hard"), F.count("ev").alias("n_met"))
    j = anchors.join(touched.select("id", F.lit(True).alias("_touched")).distinct(), "id", "left").join(hard, "id", "left")
    flags = {
        "live": ~F.coalesce("deprecated", F.lit(False)), "in_stage": F.lit(grade).between(F.col("stage_min"), F.col("stage_max")), "required": required(policy, grade),
        "untouched": F.col("_touched").isNull(), "with_hard": F.coalesce("n_hard", F.lit(0)) >= 1, "avoided": F.col("n_hard") == F.col("n_met"),
    }
    return j.select("*", *[F.coalesce(c, F.lit(False)).alias(f"f_{k}") for k, c in flags.items()])


STEPS = ("live", "in_stage", "required", "untouched", "with_hard", "avoided")


def avoided(anchors: DataFrame, edges: DataFrame, touched: DataFrame, evidenced: DataFrame, grade: int, policy: str = "strict") -> DataFrame:
    """Live, in stage, required and untouched anchors with at least one structural hard prerequisite, all evidenced.

    anchors: id, deprecated, stage_min, stage_max, course. touched, evidenced: id.
    """
    f = _flagged(anchors, edges, touched, evidenced, grade, policy)
    keep = F.lit(True)
    for s in STEPS:
        keep &= F.col(f"f_{s}")
    return f.filter(keep).drop("_touched", "n_met", *[f"f_{s}" for s in STEPS])


def avoided_funnel(anchors: DataFrame, edges: DataFrame, touched: DataFrame, evidenced: DataFrame, grade: int, policy: str = "strict") -> DataFrame:
    """How many anchors are left after each condition, in one pass."""
    f = _flagged(anchors, edges, touched, evidenced, grade, policy)
    out, keep = [F.count(F.lit(1)).alias("n_all")], F.lit(True)
    for s in STEPS:
        keep = keep & F.col(f"f_{s}")
        out.append(F.count(F.when(keep, 1)).alias(f"n_{s}"))
    return f.agg(*out)


def ready(anchors: DataFrame, edges: DataFrame, mastered: DataFrame, top: int | None = None, text_order: bool = False) -> DataFrame:
    """Not mastered, and no prerequisite is unmet (none at all counts); earliest stage first, then most unlocked.

    text_order: compares stages as text, so that 10 comes before 2.
    """
    unmet = edges.join(mastered.select(F.col("id").alias("p")), "p", "left_anti").select(F.col("a").alias("id"))
    unlocks = edges.groupBy(F.col("p").alias("id")).agg(F.count(F.lit(1)).alias("unlocks"))
    j = anchors.join(mastered, "id", "left_anti").join(unmet, "id", "left_anti").join(unlocks, "id", "left").na.fill(0, ["unlocks"])
    order = [F.col("stage").cast("string") if text_order else F.col("stage"), F.desc("unlocks"), F.col("id")]
    if top is not None:
        j = j.orderBy(*order).limit(top)
        return j.select("id", "stage", "unlocks", F.row_number().over(Window.orderBy(*order)).cast("long").alias("nth"))
    return j.select("id", "stage", "unlocks")


def list_coverage(done: DataFrame, totals: DataFrame) -> DataFrame:
    """list, n, total, coverage. done: list, key; totals: list, total."""
    n = done.distinct().groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    return totals.join(n, "list", "left").na.fill(0, ["n"]).withColumn("coverage", F.col("n") / F.col("total"))


def toggled(events: DataFrame, keys: list[str], mark: str, order: str) -> DataFrame:
    """The marks that stand: the same mark twice in a row for a key takes it off, another replaces it."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (F.lag(mark).over(w).isNull()) | (F.lag(mark).over(w) != F.col(mark))
    runs = events.withColumn("_run", F.sum(new.cast("long")).over(w))
    per = runs.groupBy(*keys, "_run").agg(F.first(mark).alias(mark), F.count(F.lit(1)).alias("_k"))
    last = Window.partitionBy(*keys).orderBy(F.desc("_run"))
    return per.withColumn("_n", F.row_number().over(last)).filter("_n = 1 and _k % 2 = 1").select(*keys, mark)
