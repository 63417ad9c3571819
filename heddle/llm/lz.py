"""Document fingerprints (6): minimum hashes over the phrases of a Lempel-Ziv parse.

A text is parsed into dictionary phrases (each the longest known phrase and one more character); the phrases of a text
are distinct, so their hashes are a set, and the least value of each of 128 hash functions over it makes the
fingerprint. Equal texts have equal fingerprints, and the share of equal places estimates how alike two phrase sets are.

The query also needs each document's successor by doc_id. Documents are dealt out by ranges whose bounds are doc_ids of
the table, and the first document of each range is also sent to the range before it; so the texts move once.

Defined cases: a null text is empty; an empty text has the fingerprint of all ff, which is like another empty one (1)
and like no other (0); null doc_ids come last; equal doc_ids are ordered by text; an empty table gives an empty result;
with one document, it is its own successor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

MINIMA = 128
EMPTY = "ffff" * MINIMA
#: Rank error of the range bounds, as a part of the rows.
ACCURACY = 10_000
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 2**31, (MINIMA, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, (MINIMA, 1), dtype=np.uint32)


class Parse:
    """A Lempel-Ziv parse that can go on in two ways from one point.

    Every beginning of a known phrase is a known phrase, so the longest one at a place is found by trying lengths from
    the last phrase's length up or down.
    """

    def __init__(self):
        self.known: set[str] = set()
        self.bounds = [0]  # where phrases begin, and the end of the last one

    def branch(self) -> Parse:
        other = Parse()
        other.known, other.bounds = self.known.copy(), self.bounds[:]
        return other

    def feed(self, text: str, limit: int) -> None:
        """Takes the phrases that end at limit or before it."""
        known, bounds, size = self.known, self.bounds, 2
        learn, add = known.add, bounds.append
        i = bounds[-1]
        while i < limit:
            j = i + size
            if j > limit:
                j = limit
            if text[i:j] in known:
                j += 1
                while j <= limit and text[i:j] in known:
                    j += 1
                if j > limit:
                    return
            else:
                j -= 1
                while j > i and text[i:j] not in known:
                    j -= 1
                j += 1
                if j > limit:
                    return
            learn(text[i:j])
            add(j)
            size = j - i
            i = j


def phrase_hashes(text: str, bounds: list[int]) -> np.ndarray:
    """A 32-bit hash of the text between each two bounds, from prefix sums of a polynomial."""
    n = bounds[-1]
    codes = np.frombuffer(text[:n].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(29)
    at = np.array(bounds, np.int64)
    length = np.arange(n) - np.repeat(at[:-1], np.diff(at))  # of each character's place in its phrase
    most = int(length.max()) + 1 if n else 0
    powers = np.cumprod(np.full(most, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)
    h = np.add.reduceat(codes * powers[length], at[:-1])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def signature(h: np.ndarray) -> np.ndarray:
    """Two bytes of each minimum over hashes."""
    if not len(h):
        return np.full(MINIMA, 0xFFFF, np.uint16)
    least = np.full(MINIMA, 2**32 - 1, np.uint32)
    for at in range(0, len(h), 4096):
        np.minimum(least, (_A * h[None, at : at + 4096] + _B).min(1), out=least)
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    out = (least >> np.uint32(16)).astype(np.uint16)
    return np.minimum(out, 0xFFFE)


def sketch(text: str, bounds: list[int]) -> str:
    """The fingerprint of a text parsed at bounds; what is left after the last is a known phrase and adds nothing."""
    return hexed(signature(phrase_hashes(text, bounds) if len(bounds) > 1 else np.empty(0, np.uint32)))


def hexed(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if EMPTY in (a, b):
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    return float((x == y).mean())


def fingerprint(text: str | None) -> str:
    parse = Parse()
    t = text or ""
    parse.feed(t, len(t))
    return sketch(t, parse.bounds)


def with_edit(text: str, following: str) -> tuple[str, str, str]:
    """The text's fingerprint, the edited text and its fingerprint; the half that both share is parsed once."""
    n = len(text)
    half = n - n // 2
    parse = Parse()
    parse.feed(text, half)
    other = parse.branch()
    parse.feed(text, n)
    edited = text[:half] + following[: n // 2]
    other.feed(edited, len(edited))
    return sketch(text, parse.bounds), edited, sketch(edited, other.bounds)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; nothing is shuffled."""
    store.ship(docs.sparkSession)
    store.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint against its edited text's and its successor's. docs: doc_id, text."""
    spark = docs.sparkSession
    store.ship(spark)
    store.small_batches(spark)
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    probe = [(k + 1) / parts for k in range(parts - 1)]
    found = ids.agg(F.min("doc_id").alias("least"), *([F.percentile_approx("doc_id", probe, ACCURACY).alias("bounds")] if probe else [])).first()
    first = found["least"]
    bounds = sorted({b for b in (found["bounds"] or []) if b != first}) if probe else []  # of a number fixed by the settings

    # A row's range is the number of bounds up to its doc_id, found by halving.
    def rank(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") >= F.lit(bounds[mid]), rank(mid + 1, hi)).otherwise(rank(lo, mid))

    last = len(bounds)
    own = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(rank(0, len(bounds))) if bounds else F.lit(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("part", own)
    is_head = (F.col("doc_id").isin(bounds) if bounds else F.lit(False)) | (F.col("doc_id") == F.lit(first) if first is not None else F.lit(True))
    guest_of = F.when(F.col("part") == 0, F.lit(last)).otherwise(F.col("part") - 1)
    to = F.when(is_head, F.array(F.struct(F.col("part").alias("to"), F.lit(False).alias("guest")), F.struct(guest_of.alias("to"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("part").alias("to"), F.lit(False).alias("guest"))))
    dealt = rows.select("doc_id", "text", F.explode(to).alias("at")).select("doc_id", "text", "at.to", "at.guest")
    dealt = dealt.repartitionById(last + 1, F.col("to").cast("int")).sortWithinPartitions("guest", F.col("doc_id").asc_nulls_last(), "text")

    def run(batches):
        held = None  # the document that waits for its successor
        guest = opening = None

        def out(rows):
            done = []
            for (i, text), following in rows:
                fp, edited, edited_fp = with_edit(text, following)
                done.append((i, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fp, edited_fp, likeness(fp, edited_fp), following))
            return done

        def batch_of(done):
            # A successor inside the run is fingerprinted as the next row; only the last one is done for its own sake.
            near = [likeness(a[3], b[3]) for a, b in zip(done, done[1:], strict=False)]
            near.append(likeness(done[-1][3], fingerprint(done[-1][6])))
            columns = list(zip(*[(*d[:6], x) for d, x in zip(done, near, strict=True)], strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], OUT.replace(" long", "").replace(" string", "").replace(" double", "").split(", "))

        for batch in batches:
            ready = []
            for i, text, _, is_guest in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if is_guest:
                    guest = text if guest is None else guest  # the first of the next range
                    continue
                if opening is None:
                    opening = text
                if held is not None:
                    ready.append((held, text))
                held = (i, text)
            if ready:
                yield batch_of(out(ready))
        if held is not None:
            yield batch_of(out([(held, guest if guest is not None else opening)]))

    return dealt.mapInArrow(run, OUT)


def op6_lz_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
