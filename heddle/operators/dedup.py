"""Exact and near duplicates of short statements, and moving references to the survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.sources.tables import settled


def exact_groups(df: DataFrame, keys: list[str], id: str = "id", prefer: Column | None = None) -> DataFrame:
    """id, survivor of groups of equal keys (equality is transitive, so a group-by finds the components).

    The survivor has the greatest `prefer`, then the smallest id; null keys are no group.
    """
    known = df.dropna(subset=keys)
    best = F.min_by(id, F.struct((-(prefer if prefer is not None else F.lit(0))).alias("x"), F.col(id).alias("y")))
    groups = known.groupBy(*keys).agg(best.alias("survivor"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return known.select(id, *keys).join(groups, keys).select(F.col(id).alias("id"), "survivor")


def repoint(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edges with both ends moved to the survivors; self-loops and repeats that this makes go."""
    move = lambda df, end: df.join(survivors.select(F.col("id").alias(end), F.col("survivor").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return move(move(edges, "a"), "p").select("a", "p").filter("a <> p").distinct()


def repoint_array(df: DataFrame, column: str, survivors: DataFrame, key: str) -> DataFrame:
    """df with the ids of an array column moved to the survivors, in order and without repeats."""
    one = df.select(key, F.posexplode(column).alias("pos", "id")).join(survivors, "id", "left")
    back = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("survivor", "id").alias("id")))).alias("_x"))
    return df.join(back, key, "left").withColumn(column, F.when(F.col("_x").isNotNull(), F.array_distinct(F.transform("_x", lambda x: x["id"]))).otherwise(F.col(column))).drop("_x")


def near_pairs(df: DataFrame, threshold_percent: int, group: str = "discipline", id: str = "id", tokens: str = "tokens") -> DataFrame:
    """a < b, common, n_a, n_b of pairs in a group whose token sets reach the Jaccard threshold. Exact.

    Prefix filter: tokens are ordered by rarity in the group, and two sets that reach the threshold share one of their
    rarest n - ceil(t n) + 1; so only sets that share such a token meet. Equal sets are one node until the end.
    """
    sets = df.select(F.col(id).alias("id"), F.col(group).alias("g"), F.array_sort(F.array_distinct(tokens)).alias("t")).filter("size(t) > 0")
    nodes = settled(sets.groupBy("g", "t").agg(F.min("id").alias("rep"), F.size("t").alias("n")))
    each = nodes.select("g", "rep", "n", F.explode("t").alias("token"))
    rare = each.groupBy("g", "token").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("g", "rep").orderBy("df", "token")
    prefix = each.join(rare, ["g", "token"]).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold_percent / 100) + 1)
    prefix = settled(prefix.select("g", "token", "rep", "n"))
    x, y = prefix.alias("x"), prefix.alias("y")
    on = (F.col("x.g") == F.col("y.g")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") < F.col("y.rep"))
    size = 100 * F.least("x.n", "y.n") >= threshold_percent * F.greatest("x.n", "y.n")
    cand = x.join(y, on & size).select(F.col("x.rep").alias("ra"), F.col("y.rep").alias("rb")).distinct()
    full = nodes.select("rep", "t", "n")
    j = cand.join(full.select(F.col("rep").alias("ra"), F.col("t").alias("ta"), F.col("n").alias("n_a")), "ra").join(full.select(F.col("rep").alias("rb"), F.col("t").alias("tb"), F.col("n").alias("n_b")), "rb")
    j = j.withColumn("common", F.size(F.array_intersect("ta", "tb"))).filter(100 * F.col("common") >= threshold_percent * (F.col("n_a") + F.col("n_b") - F.col("common")))
    return j.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "common", "n_a", "n_b")


def set_representatives(df: DataFrame, group: str = "discipline", id: str = "id", tokens: str = "tokens") -> DataFrame:
    """id, representative: the smallest id with the same token set in the group."""
    keyed = df.select(F.col(id).alias("id"), F.col(group).alias("g"), F.array_sort(F.array_distinct(tokens)).alias("t"))
    reps = keyed.groupBy("g", "t").agg(F.min("id").alias("representative"))
    return keyed.join(reps, ["g", "t"]).select("id", "representative")
