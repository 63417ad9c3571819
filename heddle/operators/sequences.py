"""Consensus, gaps, runs and carried state over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_with_votes(df: DataFrame, key: str, value: str, first: str | None = None) -> DataFrame:
    """key, value, votes, total: the commonest value of each key; ties go to the one seen first (or the smaller)."""
    tie = F.min(first) if first else F.first(F.col(value))
    n = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("votes"), (tie if first else F.min(value)).alias("_tie"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("votes")).alias("v"), "_tie", F.col(value).alias("x"))).alias("b"), F.sum("votes").alias("total"))
    return best.select(key, F.col("b.x").alias(value), (-F.col("b.v")).alias("votes"), "total")


def threshold_vote(df: DataFrame, group: list[str], key: Column, surface: str, run: str, least: int) -> DataFrame:
    """Keys that at least `least` runs name, with their commonest surface form (smaller on ties)."""
    one = df.withColumn("_key", key).select(*group, "_key", surface, run).distinct()
    n = one.groupBy(*group, "_key").agg(F.countDistinct(run).alias("runs")).filter(F.col("runs") >= least)
    form = one.groupBy(*group, "_key", surface).agg(F.count(F.lit(1)).alias("k")).groupBy(*group, "_key").agg(F.min(F.struct((-F.col("k")).alias("k"), F.col(surface).alias("s"))).alias("f"))
    return n.join(form, [*group, "_key"]).select(*group, F.col("_key").alias("key"), F.col("f.s").alias(surface), "runs")


def sequence_gaps(df: DataFrame, key: str, number: str) -> DataFrame:
    """key, missing, duplicated: numbers of 1..max that are not there, and those that are there more than once.

    Found by stepping over neighbours, so no list of numbers is gathered in one row.
    """
    per = df.filter(F.col(number).isNotNull()).groupBy(key, number).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.lag(number).over(Window.partitionBy(key).orderBy(number)), F.lit(0))
    step = per.withColumn("_skip", F.greatest(F.col(number) - before - 1, F.lit(0)))
    return step.groupBy(key).agg(F.sum("_skip").cast("long").alias("n_missing"), F.count(F.when(F.col("_rows") > 1, 1)).alias("n_duplicated")).filter("n_missing > 0 or n_duplicated > 0")


def restarts(df: DataFrame, key: str, order: list[str], number: str, out: str = "sequence") -> DataFrame:
    """df with the number of the sequence that a row is in; a new one starts wherever the number falls."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(out, F.sum(F.coalesce((F.col(number) < F.lag(number).over(w)).cast("long"), F.lit(0))).over(w))


def forward_fill(df: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """The last value that was not null, up to this row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def islands(df: DataFrame, key: str, number: str, gap: int = 0) -> DataFrame:
    """key, run_start, run_end, n: runs of numbers of which neighbours are at most gap + 1 apart."""
    d = df.select(key, number).distinct()
    w = Window.partitionBy(key).orderBy(number)
    new = F.coalesce((F.col(number) - F.lag(number).over(w) > gap + 1).cast("long"), F.lit(0))
    return d.withColumn("_run", F.sum(new).over(w)).groupBy(key, "_run").agg(F.min(number).alias("run_start"), F.max(number).alias("run_end"), F.count(F.lit(1)).alias("n")).drop("_run")


def longest_run(runs: DataFrame, key: str) -> DataFrame:
    """The longest run of each key, the first of equal ones."""
    best = F.min(F.struct((F.col("run_start") - F.col("run_end")).alias("l"), "run_start", "run_end", "n")).alias("b")
    return runs.groupBy(key).agg(best).select(key, "b.run_start", "b.run_end", "b.n")


def run_at(runs: DataFrame, key: str, places: DataFrame) -> DataFrame:
    """The run that holds the place of each key. places: key, at."""
    return runs.join(places, key).filter("at between run_start and run_end")


def monotonic_faults(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_down", F.coalesce((F.col(value) < F.lag(value).over(w)).cast("long"), F.lit(0))).groupBy(key).agg(F.sum("_down").alias("n_faults"))


def without_repeats(df: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """Rows that are not like the row before them in these columns."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*columns)
    return df.withColumn("_same", F.coalesce(F.lag(now).over(w).eqNullSafe(now) & (F.row_number().over(w) > 1), F.lit(False))).filter("not _same").drop("_same")


def systematic_sample(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """k equidistant rows of each group: those at floor(i * n / k); all of a group of k or fewer."""
    w = Window.partitionBy(group)
    r = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    # Row i is taken when some j has floor(j * n / k) = i.
    j = F.floor((F.col("_i") * k + F.col("_n") - 1) / F.col("_n"))
    return r.filter((F.col("_n") <= k) | ((j < k) & (F.floor(j * F.col("_n") / k) == F.col("_i")))).drop("_i", "_n")


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def first_wins(df: DataFrame, keys: list[str], order: list[str], id: str = "id", out: str = "first_id") -> DataFrame:
    """df with the id of the first row of the same key; rows of their own are their first."""
    return df.withColumn(out, F.first(id).over(Window.partitionBy(*keys).orderBy(*order)))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by map-side maxima."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def unwrapped(df: DataFrame, key: str, order: list[str], starts: Column, text: str, separator: str = "") -> DataFrame:
    """Lines joined to the line that starts them: key, item, text."""
    w = Window.partitionBy(key).orderBy(*order)
    item = df.withColumn("item", F.sum(starts.cast("long")).over(w))
    return item.groupBy(key, "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda x: x["_t"]), separator).alias("text"))


def continuation(df: DataFrame, key: str, page: str) -> DataFrame:
    """The rows and, for each, the page after it if it is not there yet."""
    d = df.select(key, page).distinct()
    return d.union(d.select(key, (F.col(page) + 1).alias(page))).distinct()


def incremental(now: DataFrame, stored: DataFrame, key: list[str], inputs: list[str]) -> DataFrame:
    """Rows whose inputs' hash differs from the stored one, or that have none stored. stored: key, hash."""
    mine = now.withColumn("hash", short_hash(*inputs))
    return mine.join(stored.select(*key, F.col("hash").alias("_stored")), key, "left").filter(~F.col("_stored").eqNullSafe(F.col("hash"))).drop("_stored")


def short_hash(*columns: str, digits: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("→", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, digits)


def current(assertions: DataFrame, id: str = "id", supersedes: str = "supersedes") -> DataFrame:
    """Assertions that no other one supersedes."""
    gone = assertions.filter(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(id))
    return assertions.join(gone, id, "left_anti")


def valid_on(assertions: DataFrame, day: str) -> DataFrame:
    d = F.lit(day).cast("date")
    return assertions.filter((F.col("valid_from") <= d) & (F.col("valid_until").isNull() | (d <= F.col("valid_until"))))


def carried_vote(df: DataFrame, schema: str, document: str, page: str, votes: str, default: str):
    """The section carried over from page to page: each page's majority vote starts the next page.

    Each page needs the winner of the page before it, so a document is one group; votes: array of the runs' last
    sections on a page (null where a run saw none and goes on with what it had).
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = default, []
        for row in pdf.sort_values(page).itertuples(index=False):
            named = [v if v is not None else state for v in getattr(row, votes)]
            out.append(state)
            if named:
                state = max(dict.fromkeys(named), key=named.count)
        got = pdf.sort_values(page).copy()
        got["start_section"] = out
        return got

    return df.groupBy(document).applyInPandas(run, schema)
