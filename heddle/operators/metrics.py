"""Counts, matrices and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The review statuses of the citable policy, and its tiers for display.
CITABLE = ("auto-confirmed", "expert-confirmed", "ai-adjudicated", "ai-reviewed")
HUMAN_CONFIRMED = ("expert-confirmed",)


def live(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(F.col("deprecated"), F.lit(False)))


def citable(df: DataFrame, status: str = "status") -> DataFrame:
    return live(df).filter(F.col(status).isin(*CITABLE))


def ranked(df: DataFrame, keys: list[str], value: str, place) -> DataFrame:
    """keys and the value at a place of each group's sorted values, from 0. place: of the group's size, both columns.

    Values are counted first and the counts summed in order, so that no group is gathered in one row. Nulls do not count.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*keys)
    run = per.withColumn("_upto", F.sum("_k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", place(F.sum("_k").over(w)))
    return run.filter("_at < _upto and _at >= _upto - _k").select(*keys, value)


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sorted[floor(n / 2)]; of an even number the upper of the two in the middle."""
    return ranked(df, keys, value, lambda n: F.floor(n / 2))


def coverage_matrix(anchors: DataFrame, bands: int = 5) -> DataFrame:
    """discipline, band0 ... , total."""
    cells = [F.count(F.when(F.col("band") == k, 1)).alias(f"band{k}") for k in range(bands)]
    return anchors.groupBy("discipline").agg(*cells, F.count(F.lit(1)).alias("total"))


def relation(x: str, y: str) -> Column:
    """same, diff or unk; null is unknown and never different."""
    return F.when(F.col(x).isNull() | F.col(y).isNull(), "unk").when(F.col(x) == F.col(y), "same").otherwise("diff")


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """dimension, value, n of every column in one pass."""
    sets = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*sets)).alias("s")).groupBy("s.dimension", "s.value").agg(F.count(F.lit(1)).alias("n"))


def cross_group_pairs(df: DataFrame, key: str, group: str) -> DataFrame:
    """Per key: pairs of members of unlike groups, C(n, 2) less the sum of C(n_g, 2); no pair is ever made."""
    per = df.groupBy(key, group).agg(F.count(F.lit(1)).alias("g"))
    n = F.sum("g")
    within = F.sum(F.col("g") * (F.col("g") - 1))
    return per.groupBy(key).agg(n.alias("n"), ((n * (n - 1) - within) / 2).cast("long").alias("cross_pairs"))


def pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """sorted[int(n * share)], the last one at most."""
    return ranked(df, keys, value, lambda n: F.least(F.floor(n * F.lit(share)), n - 1))


def top_reasons(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k commonest values; equal counts in the order of the value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def null_model(edges: DataFrame, pools: DataFrame, trials: int, seed: int = 20260820) -> DataFrame:
    """trial, redundant, n: share of redundant edges when each anchor draws as many prerequisites from its own pool.

    edges: a, p. pools: a, p. Trials run side by side; one trial's graph has to fit a task, as its edges are a list that
    a person curates.
    """
    import random

    import pandas as pd

    want = edges.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    base = want.join(pools.groupBy("a").agg(F.array_sort(F.collect_set("p")).alias("pool")), "a")
    rows = base.select(F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"), "a", "k", "pool")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        trial = int(pdf["trial"].iloc[0])
        rng = random.Random(seed + trial)
        pre = {int(r.a): sorted(rng.sample(list(r.pool), min(int(r.k), len(r.pool)))) for r in pdf.sort_values("a").itertuples()}
        redundant = n = 0
        for a, direct in pre.items():
            for p in direct:
                n += 1
                stack, seen = [m for m in direct if m != p], set()
                while stack:
                    x = stack.pop()
                    if x == p:
                        redundant += 1
                        break
                    if x not in seen:
                        seen.add(x)
                        stack.extend(pre.get(x, ()))
        return pd.DataFrame({"trial": [trial], "redundant": [redundant], "n": [n]})

    return rows.groupBy("trial").applyInPandas(run, "trial int, redundant long, n long")
