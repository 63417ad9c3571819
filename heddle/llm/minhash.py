"""MinHash near-duplicates (2): universal minima, banding, signature check, exact check, components by stars.

Texts with equal shingle sets are one node. In each band a bucket's smallest document is its pivot and the others are
paired with it (no bucket makes all pairs). Pairs whose signatures agree enough are confirmed on their full sets, and
confirmed pairs become components. A bucket whose members are then in more than one component could still hide a link:
the members of such buckets are joined across components by an exact prefix filter, and what that leaves is confirmed. So
what is left to chance is that two similar texts share no band (5e-6 at similarity 0.75, less above).

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; rows of one id are one document
that has the links of each of its texts; rows with a null id are linked with nothing and have a null component; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .components import components

WORDS = 5
THRESHOLD = 75
MINIMA = 128
BAND = 4
BANDS = MINIMA // BAND
#: Pairs that agree in fewer minima are not looked at again: 7 deviations below what 0.75 gives.
LEAST_EQUAL = 62
CACHE = 300_000

_rng = np.random.Generator(np.random.PCG64(20240))
_PLACE = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = (_rng.integers(1, 2**63, (MINIMA, 1), dtype=np.uint64) * np.uint64(2)) + np.uint64(1)
_B = _rng.integers(0, 2**63, (MINIMA, 1), dtype=np.uint64)
_BAND = _rng.integers(1, 2**63, BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_words = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - WORDS + 1)
    k = min(WORDS, len(h))
    out = np.full(n, len(h) if len(h) < WORDS else 0, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _PLACE[j]
    return np.unique(_mix(out))


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each of the universal hashes over a set that is not empty."""
    least = np.full(MINIMA, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(least, (_A * s[None, at : at + 2048] + _B).min(1), out=least)
    return least >> np.uint64(20)


def band_keys(m: np.ndarray) -> np.ndarray:
    keys = (m.reshape(BANDS, BAND) * _BAND).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return _mix(keys).view(np.int64)


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (shingles), h1 and h2 (of the set), sig (two bytes a minimum), bands; one row a row."""
    store.ship(docs.sparkSession)
    store.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            n, h1, h2, sig, bands = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t)
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(_mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                if len(s):
                    m = minima(s)
                    sig.append(_mix(m).astype("<u2").tobytes())
                    bands.append(band_keys(m))
                else:
                    sig.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "h1", "h2", "sig", "bands"])

    df = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return df.mapInArrow(run, "id long, n long, h1 long, h2 long, sig binary, bands array<long>")


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose signatures agree enough."""
    sig = nodes.select("id", "sig")
    with_b = pairs.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    both = with_b.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").select("a", "b", "sig_a", "sig_b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, MINIMA) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= LEAST_EQUAL))

    return both.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that reach the threshold on full sets. texts: id, text, one row an id at most.

    The larger id's text meets the pair first, so that a pivot's text is never repeated in a shuffle.
    """
    ids = store.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    texts, _ = store.split(texts, "id", ids)
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        last, own = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, own = a, shingles(x)
                other = shingles(y)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= THRESHOLD * (len(own) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _contested(rows: DataFrame) -> DataFrame:
    """key, top (the component with most rows) and least (n) of the keys of which rows are in several components."""
    per = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n"))
    keys = per.groupBy("key").agg(F.max(F.struct("rows", "comp")).alias("top"), F.min("n").alias("least"), F.count(F.lit(1)).alias("comps"))
    return keys.filter("comps > 1").select("key", F.col("top.comp").alias("top"), "least")


def _across(members: DataFrame, texts: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs (a, b) to confirm in buckets with several components, without those tried. members: key, id, n, comp.

    The members' shingles are put in one order, rarest among them first. A link needs so many common shingles that the
    first of them has as many places after it on both sides, so only the first ones of each document are met (a prefix
    filter, exact), and only across components. How far a document's go depends on the smallest size in its buckets.
    """
    keys = store.keep(_contested(members), "split-buckets")
    open_ = store.keep(members.join(keys.drop("top"), "key").groupBy("id", "n", "comp").agg(F.min("least").alias("least")), "split-members")
    sets = store.keep(shingled(store.split(texts, "id", open_)[0].join(open_.drop("comp"), "id").select("id", "n", "least", "text")), "split-sets")
    each = sets.select("id", "n", "last", F.explode("shingles").alias("key"))
    # A shingle of one document meets none, but has its place before all others.
    counts = store.keep(each.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "shingle-counts")
    own = Window.partitionBy("id")
    ranked = each.join(counts, "key").withColumn("place", F.row_number().over(own.orderBy("k", "key")) - 1 + F.col("n") - F.count(F.lit(1)).over(own))
    first = store.keep(ranked.filter("place <= last").select("key", "id", "n", "place").join(open_.select("id", "comp"), "id"), "first-shingles")
    met = store.keep(first.join(store.keep(_contested(first).drop("least"), "split-shingles"), "key"), "contested")
    common = (100 + THRESHOLD) * F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= THRESHOLD * (F.col("x.n") + F.col("y.n"))
    pair = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.top")) | (F.col("x.id") < F.col("y.id"))) & common
    out = met.filter("comp <> top").alias("x").join(met.alias("y"), (F.col("x.key") == F.col("y.key")) & pair)
    return out.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")


def shingled(docs: DataFrame) -> DataFrame:
    """id, n, last (the last place, from 0, that the first common shingle of a link may have), shingles of docs (id, n,
    least: the smallest size that it may meet, text)."""

    def run(batches):
        for batch in batches:
            n, least = (batch.column(k).to_numpy() for k in (1, 2))
            size = np.maximum(least, -(-THRESHOLD * n // 100))
            sets = [shingles(t).view(np.int64) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((100 * n - THRESHOLD * size) // (100 + THRESHOLD)), pa.array(sets, pa.list_(pa.int64()))], ["id", "n", "last", "shingles"])

    return docs.mapInArrow(run, "id long, n long, last long, shingles array<long>")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (shingles), component (smallest id that it reaches, itself included): one row for each row of docs."""
    all_rows = store.keep(signed(docs, doc_id, text), "signatures")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    if all_rows.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 and id is not null").isEmpty():
        return _linked(all_rows, texts)
    rows = store.keep(texts.filter("id is not null").withColumn("row", F.monotonically_increasing_id()), "rows")
    roots = store.keep(_roots(rows), "roots")
    least = roots.groupBy("root").agg(F.min("id").alias("component"))
    return roots.join(least, "root").select("id", "n", "component").union(all_rows.filter("id is null").select("id", "n", F.lit(None).cast("long").alias("component")))


def _linked(all_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """near_duplicates for ids that do not repeat. all_rows: signed(texts), written."""
    slim = all_rows.select("id", "n", "h1", "h2")
    same = ["n", "h1", "h2"]
    groups = slim.filter("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    groups = store.keep(groups, "copies")
    nodes = all_rows.filter("n > 0 and id is not null").join(groups, same, "left").filter("rep is null or rep = id").select("id", "n", "sig", "bands")
    nodes = store.keep(nodes, "nodes")
    banded = nodes.select("id", "n", F.explode("bands").alias("key"))
    buckets = store.keep(banded.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("key", "a"), "buckets")
    member = store.keep(banded.join(buckets, "key"), "members")
    pairs = store.keep(alike(member.filter("id <> a").select("a", F.col("id").alias("b")).distinct(), nodes), "pairs")
    links = store.keep(confirmed(pairs, texts), "links")
    comps = store.keep(components(links), "components")
    placed = member.select("key", "id", "n").join(comps, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp"))
    more = store.keep(_across(store.keep(placed, "placed"), texts, pairs), "more-pairs")
    if not more.isEmpty():
        found = store.keep(confirmed(more, texts), "more-links")
        if not found.isEmpty():
            comps = store.keep(components(links.union(found)), "components")
    of_group = store.keep(groups.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("of_group")), "copies-of")
    out = slim.join(of_group, same, "left").join(comps, "id", "left")
    return out.select("id", "n", F.when(F.col("n") > 0, F.coalesce("of_group", "component", "id")).otherwise(F.col("id")).alias("component"))


def _roots(rows: DataFrame) -> DataFrame:
    """row, id, n, root (smallest row that it reaches by links or by equal ids). rows: written, with row (unique), id, text."""
    part = store.keep(_linked(store.keep(signed(rows, "row", "text"), "row-signatures"), rows.select(F.col("row").alias("id"), "text")), "row-links")
    first = rows.filter("id is not null").groupBy("id").agg(F.min("row").alias("first"))
    by_id = rows.join(first, "id").filter("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    merged = components(part.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(by_id))
    named = rows.select("row", "id").join(part.select(F.col("id").alias("row"), "n"), "row")
    return named.join(merged.select(F.col("id").alias("row"), F.col("component").alias("root")), "row", "left").select("row", "id", "n", F.coalesce("root", "row").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays.

    Where ids are null or repeated, rows without an id are documents of their own, and of equal ids the first row stays.
    """
    spark = docs.sparkSession
    columns = [F.col(f"`{c}`") for c in docs.columns]
    with store.tables(spark) as own:
        if store.keyed(docs)[1]:
            lost = store.fresh_name(docs, "_gone")
            gone = store.keep(near_duplicates(docs).filter("id <> component").select(F.col("id").alias(lost)), "near-gone")
            own.release(gone)
            doubtful, sure = store.split(docs, "doc_id", gone, lost)
            lone = doubtful.join(gone, F.col("doc_id").cast("long") == F.col(lost), "left_anti")
            return sure.select(*columns).union(lone.select(*columns))
        row = store.fresh_name(docs, "_row")
        named = store.keep(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
        roots = store.keep(_roots(named.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")), "roots")
        first = roots.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "row")).alias("first")).select(F.col("first.row").alias(row))
        first = store.keep(first, "first")
        own.release(named, first)
        return named.join(first, row, "left_semi").select(*columns)


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = store.result(spark, lambda: near_duplicates(docs), "near-duplicates")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
