"""Mixing sources to target weights (4, native): systematic sampling from prefix sums of expected copies.

Sources in code-point order (null last) weigh 5, 2, 1, 5, ... and share `SHARE` of all words; no target exceeds `CAP`
times its source's words, and what that frees is shared again by weight (water filling, in closed form). Within a
source every document expects target / source words copies; its copies are the integers that the running sum of
expected copies crosses from one seeded random offset on. Documents run by falling size (equal sizes by a hash), so that
the words taken come out even too: they miss a source's target by no more than the size of its longest document.

A row's place in that run is its place in a small block plus the rows of the blocks before it, so no task sorts a whole
source. Blocks are cut from the run; how many there are changes nothing in it. Defined cases: null or blank texts have size 0 and are never words; sources without words have target 0 and no
copies; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # 150 %
CAP = 2
SEED = "mix-1"
#: Rows that a block of one size should hold at most; blocks are split by hash digits.
BLOCK_ROWS = 4096


def digits_for(n_rows: int) -> int:
    d = 1
    while BLOCK_ROWS * 16**d < n_rows and d < 8:
        d += 1
    return d


def hash_of(doc_id: str) -> Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: key, source_size, target, n_docs. One row a source; the sources of a mix are named in its settings."""
    per = store.keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "sources")
    order = Window.orderBy(F.col("source").isNull(), "source")
    nth = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weighted = per.withColumn("weight", F.element_at(F.array(*[F.lit(x).cast("long") for x in WEIGHTS]), (nth + 1).cast("int")))
    # Sources fill up in rising order of size / weight; `level` (words a weight) if all before this one are full.
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    up = (F.lit(SHARE[0]) * F.sum("source_size").over(total) - F.lit(SHARE[1] * CAP) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    down = F.lit(SHARE[1]) * (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    full = F.col("weight") * F.col("up") > F.lit(CAP) * F.col("source_size") * F.col("down")
    leveled = weighted.withColumn("up", up).withColumn("down", down).withColumn("full", full)
    open_up = F.max(F.when(~F.col("full"), F.struct(F.col("down"), F.col("up")))).over(total)  # the first that is not full has the largest rest
    leveled = leveled.withColumn("rest", open_up)
    target = F.when(F.col("full"), (F.lit(CAP) * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("rest.up")).cast("double") / F.col("rest.down").cast("double"))
    return leveled.select("source", "source_size", "n_docs", target.alias("target"))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, n_copies; carry: further columns of docs to keep."""
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
        (F.size(store.words_of(F.col(f"`{text}`"))).cast("long") if size is None else size).alias("size"), *[F.col(f"`{c}`") for c in carry],
    )
    slim = store.keep(slim, "sizes")
    digits = digits_for(slim.count())
    keyed = slim.withColumn("hash", hash_of("doc_id")).withColumn("class", F.col("size")).withColumn("part", F.substring("hash", 1, digits))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    keyed = keyed.withColumn("key", key)
    blocks = keyed.groupBy("key", "class", "part").agg(F.count(F.lit(1)).alias("rows"))
    # Prefix sums over blocks in two steps: within a size, and over the sizes of a source (no more than a text has words).
    of_class = Window.partitionBy("key", "class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    classes = blocks.groupBy("key", "class").agg(F.sum("rows").alias("class_rows"))
    of_key = Window.partitionBy("key").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("class_start", F.coalesce(F.sum("class_rows").over(of_key), F.lit(0)))
    per = targets(slim).withColumn("key", key).drop("source").withColumn("offset", F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.col("key"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0))
    starts = blocks.withColumn("block_start", F.coalesce(F.sum("rows").over(of_class), F.lit(0))).join(classes, ["key", "class"]).join(F.broadcast(per) if per.count() <= store.BROADCAST_ROWS else per, "key")
    starts = starts.select("key", "class", "part", (F.col("class_start") + F.col("block_start")).alias("start"), "source_size", "target", "offset")
    inside = Window.partitionBy("key", "class", "part").orderBy("hash", "doc_id", *carry)
    ranked = keyed.withColumn("nth", F.row_number().over(inside)).join(starts, ["key", "class", "part"])
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("start") + F.col("nth")
    crossed = F.floor(F.col("offset") + expected * place) - F.floor(F.col("offset") + expected * (place - 1))
    return ranked.select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("n_copies"), *carry)


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, repeats as rows of their own, with the columns of docs.

    Copies are counted on slim rows and met with the texts once, on doc_id; where ids are null or repeated, rows are
    written with a number of their own first.
    """
    key, copy = store.fresh_name(docs, "_key"), store.fresh_name(docs, "_copy")
    if store.keyed(docs)[1]:
        named, row = docs, "doc_id"
        n = copies(docs).select(F.col("doc_id").cast("long").alias(key), "n_copies")
    else:
        row = store.fresh_name(docs, "_row")
        named = store.keep(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
        n = copies(named, carry=(row,)).select(F.col(row).alias(key), "n_copies")
    each = n.filter("n_copies > 0").select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias(copy))
    out = named.join(each, F.col(f"`{row}`").cast("long") == F.col(key))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = store.text_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
    out = store.result(spark, lambda: copies(docs), "copies")
    return out.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))
