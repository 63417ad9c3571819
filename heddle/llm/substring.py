"""Substring dedup (8): fuzzy passages that documents share, by collinear chaining of k-mer seeds.

Every run of 5 words of a text is a seed. Each seed's first occurrence (smallest id, then place) is its anchor, and all
other occurrences are joined to that one: a star, so a passage that stands in very many documents makes no pairs among them.
Rows are met in parts: a part asks once for each of its distinct seeds, gets the anchors of those that two documents have,
and reads its texts again with them. The matches of a document with one anchor document are merged along diagonals and
chained in order with linear gap costs by prefix maxima in a Fenwick tree. A chain of two seeds or more is extended and aligned on the words, and kept if it covers `MIN_WORDS` words
with `MIN_IDENTITY` of them equal; of a chain that is less alike the parts that are kept. A document's largest chains come
first; one that lies inside of another is aligned only if no passage found covers it. A stretch that repeats a few words
has a chain with the same anchor places for each repetition: these are one chain with shifts, whose first repetition is
followed as far as the words are equal, and of whose passages only the fewest are rows that hold all windows of them all.

What the star loses (a passage of pieces that stood in different documents before, or that repeats words) is found by
windows: each `MIN_WORDS` words in a row of which other documents have all seeds are joined to their own first occurrence,
unless the run is known to equal the anchor's already, or the document is itself the anchor of all its seeds (then a later
copy has a whole chain with it). So every exact run of `MIN_WORDS` words that an earlier document has is found.

A row is a passage of the later copy with the place of the earlier one; rows inside of another row of the same document are
left out. Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, and whole texts are read. Repeats inside one document are
no passages (the quality rules judge those). Defined cases: null, empty and short texts share nothing; rows with a null id
are not compared; equal ids are one document and share nothing with each other; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .minhash import _PLACE, _mix, word_hashes

K = 5
#: Words of the rows whose seeds are met together, and bytes of words for which there is a bucket of seeds.
PART_WORDS = 1 << 19
BUCKET_BYTES = 8 << 20
#: All seeds are met in so many turns, one after another, which need that much less disk at a time.
TURNS = 4
MIN_WORDS = 50
MIN_IDENTITY = 0.75
#: Seeds that a chain must have to be aligned.
MIN_SEEDS = 2
#: Seeds of one diagonal that are no further apart are one segment.
JOIN_GAP = 64
GAP_COST = 0.1
#: Words that are looked at past a chain's ends, and their losses before that is given up.
REACH = 128
DROP = 8
SKIP = 4
_SKIPS = sorted(((a, b) for a in range(SKIP + 1) for b in range(SKIP + 1) if a or b), key=lambda s: (max(s), sum(s), s))


def worded(docs: DataFrame) -> DataFrame:
    """id, words (a 32-bit hash of each word, little-endian) and part of every row with an id; docs: id, text.

    A part is some rows in a row of about PART_WORDS words, whose seeds are met together.
    """

    def run(batches):
        part, size = uuid.uuid4().int >> 65, 0
        for batch in batches:
            words, parts = [word_hashes(t).astype("<u4").tobytes() for t in batch.column(1).to_pylist()], []
            for w in words:
                if size >= PART_WORDS:
                    part, size = uuid.uuid4().int >> 65, 0
                size += len(w) // 4
                parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), pa.array(parts, pa.int64())], ["id", "words", "part"])

    return docs.filter("id is not null").mapInArrow(run, "id long, words binary, part long")


def seeds_of(words: np.ndarray) -> np.ndarray:
    """A hash of each K words in a row; words: word hashes."""
    n = max(0, len(words) - K + 1)
    h, s = words.astype(np.uint64), np.zeros(n, np.uint64)
    for j in range(K):
        s += h[j : j + n] * _PLACE[j]
    return _mix(s)


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the greatest needs."""
    return x.astype("<u2" if x.max() < 1 << 16 else "<u4" if x.max() < 1 << 32 else "<u8").tobytes()


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"<u{len(x) // n}").astype(np.uint64)


def _above(x: np.ndarray, low: int) -> np.ndarray:
    return x.view(np.uint64) - np.array([low]).view(np.uint64)


def _runs(rows, key: int):
    """(key, rows) of rows that come sorted by their key."""
    return ((k, list(own)) for k, own in itertools.groupby(rows, lambda r: r[key]))


def _rows(batches):
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


ENTRIES = "n int, seeds binary, low long, ids binary, places binary"


def _entries(seeds: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[int, bytes, int, bytes, bytes]:
    low = int(ids.min())
    return len(seeds), seeds.tobytes(), low, _packed(_above(ids, low)), _packed(places)


def _read(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """seeds, ids, places of rows that end with ENTRIES."""
    parts = [(np.frombuffer(s, "<u8"), (_unpacked(i, n) + np.array([low]).view(np.uint64)).view(np.int64), _unpacked(p, n).astype(np.int64)) for n, s, low, i, p in (r[-5:] for r in rows)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def first_in_part(words: DataFrame, buckets: int, turn: int) -> DataFrame:
    """bucket (by the seed), part, many (a bit a seed: two documents of the part have it) and ENTRIES of the first place
    of each seed of a turn in each part; words: id, words, part."""

    def run(batches):
        for part, rows in _runs(_rows(batches), 2):
            rows.sort(key=lambda r: r[0])
            found = [seeds_of(np.frombuffer(w, "<u4")) for _, w, _ in rows]
            now = [np.flatnonzero(s % np.uint64(TURNS) == turn) for s in found]
            seeds, ids = np.concatenate([s[k] for s, k in zip(found, now, strict=True)]), np.repeat(np.array([i for i, _, _ in rows], np.int64), [len(k) for k in now])
            if not len(seeds):
                continue
            places = np.concatenate(now)
            order = np.argsort(seeds, kind="stable")
            seeds = seeds[order]
            begins = np.flatnonzero(np.append(True, seeds[1:] != seeds[:-1]))
            first, last = order[begins], order[np.append(begins[1:], len(seeds)) - 1]
            seeds, many = seeds[begins], ids[first] != ids[last]
            bucket = ((seeds >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(seeds)]
            out = [(int(bucket[a]), part, np.packbits(many[a:b]).tobytes(), *_entries(seeds[a:b], ids[first[a:b]], places[first[a:b]])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), pa.binary(), *_ENTRIES], strict=True)], ["bucket", "part", "many", *_NAMES])

    return words.select("id", "words", "part").mapInArrow(run, "bucket int, part long, many binary, " + ENTRIES)


_NAMES = [x.split()[0] for x in ENTRIES.split(", ")]
_ENTRIES = [pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]


def first_of_all(asked: DataFrame) -> DataFrame:
    """part and ENTRIES of the first place in all parts of each seed of a part that two documents have; asked: rows of
    first_in_part.

    A part asks once for a seed, however often it has it, so no seed has more rows than there are parts.
    """

    def run(batches):
        for _, rows in _runs(_rows(batches), 0):
            seeds, ids, places = _read(rows)
            sizes = [r[3] for r in rows]
            many = np.concatenate([np.unpackbits(np.frombuffer(r[2], np.uint8), count=r[3]) for r in rows]).astype(bool)
            order = np.argsort(seeds, kind="stable")
            new = np.append(True, seeds[order[1:]] != seeds[order[:-1]])
            alone = new & np.append(new[1:], True) & ~many[order]
            some = order[~alone]
            if not len(some):
                continue
            some = some[np.lexsort((places[some], ids[some], seeds[some]))]
            new = np.append(True, seeds[some[1:]] != seeds[some[:-1]])
            begins, group = np.flatnonzero(new), np.cumsum(new) - 1
            last = np.append(begins[1:], len(some)) - 1
            shared = (ids[some[begins]] != ids[some[last]]) | np.logical_or.reduceat(many[some], begins)
            first, some = some[begins][group[shared[group]]], some[shared[group]]
            source = np.repeat(np.arange(len(rows)), sizes)[some]
            order = np.argsort(source, kind="stable")
            first, some, source = first[order], some[order], source[order]
            if not len(some):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(source)) + 1).tolist(), len(some)]
            out = [(rows[source[a]][1], *_entries(seeds[some[a:b]], ids[first[a:b]], places[first[a:b]])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), *_ENTRIES], strict=True)], ["part", *_NAMES])

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "part long, " + ENTRIES)


def _placed(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """seed, id, pos of the (id, seeds, places) of some documents."""
    ids = np.repeat(np.array([i for i, _, _ in parts], np.int64), [len(x) for _, x, _ in parts])
    columns = [np.concatenate([np.empty(0, np.int64), *[x for _, x, _ in parts]]), ids, np.concatenate([np.empty(0, np.int32), *[y for _, _, y in parts]])]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["seed", "id", "pos"])


def window_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of each MIN_WORDS words in a row, from hashes of 1, 2, 4, ... words; h: word hashes."""
    out, size, power, width = None, 0, _mix(h.astype(np.uint64)), 1
    pair = lambda a, b, by: _mix(a[: max(0, len(b) - by)] * np.uint64(0x9E3779B97F4A7C15) + b[by:][: len(a)])
    while width <= MIN_WORDS:
        if MIN_WORDS & width:
            out, size = (power, width) if out is None else (pair(out, power, size), size + width)
        power, width = pair(power, power, width), 2 * width
    return out


def open_windows(words: np.ndarray, shared: np.ndarray, own: np.ndarray, exact: list[tuple[int, int]]) -> np.ndarray:
    """Where the windows begin that have to be met; shared, own: places of seeds that other documents have, and of those
    of them that stand here first; exact: runs (start, end) known to equal an anchor's."""
    n = len(words) - MIN_WORDS + 1
    if n < 1:
        return np.empty(0, np.int64)
    at = np.arange(len(words) - K + 1)

    def inside(places: np.ndarray) -> np.ndarray:
        marks = np.zeros(len(words) + 1, np.int32)
        marks[places + 1] = 1
        marks = np.cumsum(marks)
        return marks[MIN_WORDS - K + 1 : MIN_WORDS - K + 1 + n] - marks[:n]

    all_, ours = inside(at), inside(own)
    wanted = (inside(shared) == all_) & ~((all_ >= 2) & (ours == all_))
    for start, end in exact:
        wanted[start : max(start, end - MIN_WORDS + 1)] = False
    return np.flatnonzero(wanted)


def windows_of(marked: DataFrame) -> DataFrame:
    """seed, id, pos of the open windows; marked: id, places, own (of each place), exact, words."""

    def run(batches):
        for batch in batches:
            parts = []
            for i, places, own, exact, body in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                w, places = np.frombuffer(body, "<u4"), np.array(places, np.int64)
                own, places = places[np.array(own, bool)], places[places <= len(w) - K]  # a row of the same id may be longer
                begin = open_windows(w, places, own[own <= len(w) - K], [(r["start"], r["end"]) for r in exact or ()])
                if len(begin):
                    parts.append((i, window_hashes(w)[begin].view(np.int64), begin.astype(np.int32)))
            yield _placed(parts)

    return marked.select("id", "places", "own", "exact", "words").mapInArrow(run, "seed long, id long, pos int")


def met_first(seeds: DataFrame, name: str) -> DataFrame:
    """id, pos, ref_id, ref_pos of every seed (of a window) that two documents have and its first occurrence, which meets
    itself too.

    The first occurrences are map-side minima that are written before they are joined with the written seeds, so that the
    join of a seed with very many occurrences can be split.
    """
    with store.tables(seeds.sparkSession) as own:
        seeds = store.keep(seeds, name + "-seeds")
        first = seeds.groupBy("seed").agg(F.min(F.struct("id", "pos")).alias("first"), F.max("id").alias("last")).filter("last <> first.id")
        anchors = store.keep(first.select("seed", F.col("first.id").alias("ref_id"), F.col("first.pos").alias("ref_pos")), name + "-anchors")
        out = store.keep(seeds.join(anchors, "seed").select("id", "pos", "ref_id", "ref_pos"), name)
        own.release(out)
    return out


class Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, x: tuple[float, int]) -> None:
        while i < len(self.best):
            if x > self.best[i]:
                self.best[i] = x
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chained(segments: list[tuple[int, ...]]) -> list[list[tuple[int, ...]]]:
    """Chains of segments (p, p_end, q, q_end: places of first seeds and past last seeds; more may follow) that rise in p
    and in q.

    A chain's score is its segments' lengths less GAP_COST for each word skipped on either side. The best chain is taken
    first, and others of what it leaves.
    """
    if len(segments) == 1:
        return [segments]
    segments = sorted(segments)
    n = len(segments)
    ranks = {q: i + 1 for i, q in enumerate(sorted({s[3] for s in segments}))}
    ends = sorted(ranks)
    tree, waiting, put = Fenwick(len(ends)), sorted(range(n), key=lambda i: segments[i][1]), 0
    score, back = [0.0] * n, [-1] * n
    for i, (p, p_end, q, *_) in enumerate(segments):
        while put < n and segments[waiting[put]][1] <= p:
            j = waiting[put]
            if j < i:
                tree.put(ranks[segments[j][3]], (score[j] + GAP_COST * (segments[j][1] + segments[j][3]), j))
                put += 1
            else:
                break
        lo, hi = 0, len(ends)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ends[mid] <= q else (lo, mid)
        value, j = tree.upto(lo)
        value -= GAP_COST * (p + q)
        score[i] = p_end - p + K - 1 + max(0.0, value)
        back[i] = j if value > 0 else -1
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(segments[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _segments(ref: np.ndarray, pos: np.ndarray, at: np.ndarray, size: int, gap: int = JOIN_GAP):
    """Runs of seeds along a diagonal of one anchor document: ref, p, p_end, q, q_end, how many; rows come sorted by
    (ref, pos - at, pos).

    Seeds of more than K words end where a seed of K words would that ends with them.
    """
    diagonal = pos - at
    cut = np.flatnonzero((np.diff(ref) != 0) | (np.diff(diagonal) != 0) | (np.diff(pos) > gap)) + 1
    begins = np.concatenate(([0], cut))
    p_end = np.maximum.reduceat(pos + size, begins) - K + 1
    return ref[begins], pos[begins], p_end, at[begins], p_end - diagonal[begins], np.diff(np.append(begins, len(pos)))


class Cover:
    """Runs of places that do not touch, in order."""

    def __init__(self):
        self.runs: list[tuple[int, int]] = []

    def holds(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.runs, start, key=lambda r: r[0])
        return k > 0 and self.runs[k - 1][1] >= end

    def add(self, start: int, end: int) -> None:
        lo = bisect.bisect_left(self.runs, start, key=lambda r: r[1])
        hi = bisect.bisect_right(self.runs, end, key=lambda r: r[0])
        if lo < hi:
            start, end = min(start, self.runs[lo][0]), max(end, self.runs[hi - 1][1])
        self.runs[lo:hi] = [(start, end)]


def fewest(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """The fewest of spans (start, end; more may follow) that hold every MIN_WORDS words in a row that one of them holds."""
    rows, out, k, held = sorted(spans), [], 0, -1
    while k < len(rows):
        held, best = max(held, rows[k][0]), rows[k]  # no window before held is open
        while k < len(rows) and rows[k][0] <= held:
            if rows[k][1] > best[1]:
                best = rows[k]
            k += 1
        if best[1] - MIN_WORDS >= held:
            out.append(best)
            held = best[1] - MIN_WORDS + 1
    return out


Chain = tuple[int, int, int, bool, list[int], list[int]]


def folded(chains: list[Chain]) -> list[Chain]:
    """Chains with the same anchor places of which each touches the one before are one: its segments are those of the first,
    its shifts how far on the others begin."""
    last: dict[tuple, list] = {}
    out = []
    for i, lo, hi, outer, flat, shifts in sorted(chains, key=lambda c: c[1]):
        shape = (i, outer, *[x if k % 4 > 1 else x - lo for k, x in enumerate(flat)])
        row = last.get(shape)
        if row is not None and lo <= row[2]:
            row[2] = hi
            row[5].append(lo - row[1])
        else:
            last[shape] = row = [i, lo, hi, outer, flat, list(shifts)]
            out.append(row)
    return [tuple(row) for row in out]


def document_chains(ref: np.ndarray, pos: np.ndarray, at: np.ndarray) -> list[Chain]:
    """(ref, lo, hi, outer, flat segments p, p_end, q, q_end in words, shifts) of a document's chains of MIN_SEEDS seeds or
    more.

    outer: the chain is in no other one with more seeds; shifts: see folded.
    """
    r, p, pe, q, qe, k = _segments(ref, pos, at, K)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(r)) + 1, [len(r)])).tolist()
    rows = list(zip(p.tolist(), pe.tolist(), q.tolist(), qe.tolist(), k.tolist(), strict=True))
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for chain in chained(rows[a:b]):
            seeds = sum(s[4] for s in chain)
            if seeds >= MIN_SEEDS:
                found.append((-seeds, chain[0][0], chain[-1][1] + K - 1, int(r[a]), [x for p0, p1, q0, q1, _ in chain for x in (p0, p1 + K - 1, q0, q1 + K - 1)]))
    cover, out = Cover(), []
    for _, lo, hi, i, flat in sorted(found):
        outer = not cover.holds(lo, hi)
        if outer:
            cover.add(lo, hi)
        out.append((i, lo, hi, outer, flat, [0]))
    return folded(out)


def window_runs(ref: np.ndarray, pos: np.ndarray, at: np.ndarray) -> list[Chain]:
    """As document_chains, of windows: the fewest runs of equal words that hold all words of a document's windows."""
    r, p, pe, q, qe, _ = _segments(ref, pos, at, MIN_WORDS, MIN_WORDS)
    runs = sorted(zip(p.tolist(), (pe + K - 1).tolist(), r.tolist(), q.tolist(), (qe + K - 1).tolist(), strict=True))
    out, end, k = [], -1, 0
    while k < len(runs):
        if runs[k][0] > end:
            end = runs[k][0]
        best = None  # of the runs that begin in what is held the one that goes on furthest
        while k < len(runs) and runs[k][0] <= end:
            if best is None or runs[k][1] > best[1]:
                best = runs[k]
            k += 1
        if best[1] > end:
            lo, end, i, q0, q1 = best
            out.append((i, lo, end, True, [lo, end, q0, q1], [0]))
    return out


CHAINS = "id long, ref_id long, lo int, hi int, outer boolean, segments array<int>, shifts array<int>"


def chains_of(matches: DataFrame, chains=document_chains) -> DataFrame:
    """id, ref_id, lo, hi, outer, segments, shifts of the chains in matches (id, pos, ref_id, ref_pos).

    A task sees a document's matches one after another; there are no more than the document has seeds and windows.
    """

    def run(batches):
        held: list[np.ndarray] | None = None

        def done(parts):
            ids = parts[0]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)])).tolist()
            rows = [(int(ids[a]), *c) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a for c in chains(*[x[a:b] for x in parts[1:]])]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in CHAINS.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [batch.column(k).to_numpy().astype(np.int64) for k in range(4)]
            if held is not None:
                parts = [np.concatenate(x) for x in zip(held, parts, strict=True)]
            last = int(np.searchsorted(parts[0], parts[0][-1]))  # the last document may go on in the next batch
            if last:
                yield done([x[:last] for x in parts])
            held = [x[last:] for x in parts]
        if held is not None:
            yield done(held)

    dealt = matches.withColumn("diagonal", F.col("pos") - F.col("ref_pos")).repartition("id").sortWithinPartitions("id", "ref_id", "diagonal", "pos")
    return dealt.select("id", "ref_id", "pos", "ref_pos").mapInArrow(run, CHAINS)


SEEDED = CHAINS + ", places array<int>, own array<boolean>"


def seeded(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """CHAINS of every document's seeds, and a row without ref_id a document that shares seeds, with the places of these
    and whether they stand here first. words: id, words, part; anchors: rows of first_of_all."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
        for _, rows in _runs(_rows(batches), 0):
            firsts = [r for r in rows if r[1] is None]
            if not firsts:
                continue
            seeds, refs, at = _read(firsts)
            order = np.argsort(seeds, kind="stable")
            seeds, refs, at = seeds[order], refs[order], at[order]
            out = []
            for _, i, body, *_ in rows[len(firsts) :]:
                own = seeds_of(np.frombuffer(body, "<u4"))
                where = np.minimum(np.searchsorted(seeds, own), len(seeds) - 1)
                pos = np.flatnonzero(seeds[where] == own)
                if not len(pos):
                    continue
                ref, ref_pos = refs[where[pos]], at[where[pos]]
                out.append((i, None, None, None, None, None, None, pos.astype(np.int32), (ref == i) & (ref_pos == pos)))
                other = np.flatnonzero(ref != i)
                if len(other) >= MIN_SEEDS:
                    other = other[np.lexsort((pos[other], pos[other] - ref_pos[other], ref[other]))]
                    out += [(i, *c, None, None) for c in document_chains(ref[other], pos[other], ref_pos[other])]
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in SEEDED.split(", ")])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in SEEDED.split(", ")])

    nothing = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in ENTRIES.split(", ")]
    both = words.select("part", "id", "words", *nothing).union(anchors.select("part", F.lit(None).cast("long"), F.lit(None).cast("binary"), *_NAMES))
    return both.repartition("part").sortWithinPartitions("part", F.asc_nulls_first("id")).mapInArrow(run, SEEDED)


def _lcs(x: np.ndarray, y: np.ndarray) -> int:
    """Words in common order, exact for sides of any length: equal ends first, then a bit a word of the shorter side."""
    n = min(len(x), len(y))
    head = int(np.append(x[:n] != y[:n], True).argmax())
    x, y, n = x[head:], y[head:], n - head
    tail = int(np.append((x[len(x) - n :] != y[len(y) - n :])[::-1], True).argmax())
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if len(x) < len(y):
        x, y = y, x
    if not len(y):
        return head + tail
    kinds, at = np.unique(y, return_inverse=True)
    order = np.argsort(at, kind="stable")
    places = {}  # a frequent word's places as bits, which would take too much room for all words
    for kind, where in zip(kinds.tolist(), np.split(order, np.flatnonzero(np.diff(at[order])) + 1), strict=True):
        places[kind] = where.tolist() if len(where) <= 32 else sum(1 << i for i in where.tolist())
    every = (1 << len(y)) - 1
    left = every
    for word in x[np.isin(x, kinds)].tolist():
        where = places[word]
        hit = left & (where if isinstance(where, int) else sum(1 << i for i in where))
        left = ((left + hit) | (left - hit)) & every
    return head + tail + len(y) - left.bit_count()


def _reach(x: list[int], y: list[int]) -> tuple[int, int, int]:
    """How far two sides go on alike, and the equal words of that.

    An equal word gains one; where words differ, the nearest place where three of the next four words are equal, the
    first of them among these (up to SKIP words on, on either side), costs one a word skipped. It ends where there is
    none, or DROP below the best.
    """
    i = j = score = equal = 0
    best = (0, 0, 0, 0)
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j, score, equal = i + 1, j + 1, score + 1, equal + 1
            if score > best[0]:
                best = (score, i, j, equal)
            continue
        for a, b in _SKIPS:
            if i + a < len(x) and j + b < len(y) and x[i + a] == y[j + b] and sum(v == w for v, w in zip(x[i + a : i + a + 4], y[j + b : j + b + 4])) >= 3:
                i, j, score = i + a, j + b, score - max(a, b)
                break
        else:
            break
        if best[0] - score > DROP:
            break
    return best[1:]


def _units(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs of K equal words and more in a chain's segments (p, p_end, q, q_end), in order and without overlaps."""
    out: list[tuple[int, int, int, int]] = []
    p = q = 0
    for p0, p1, q0, q1 in s.tolist():
        same = np.concatenate(([False], x[p0:p1] == y[q0:q1], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            over = max(0, p - p0 - a, q - q0 - a)
            if b - a >= K and b > a + over:
                out.append((p0 + a + over, p0 + b, q0 + a + over, q0 + b))
                p, q = p0 + b, q0 + b
    return out


def equal_runs(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> set[tuple[int, int]]:
    """Runs of MIN_WORDS equal words and more on the diagonals of segments (p, p_end, q, q_end)."""
    out = set()
    for p0, p1, q0, _ in s.tolist():
        d = q0 - p0
        a, b = max(0, p0 - REACH, -d), min(len(x), p1 + REACH, len(y) - d)
        same = np.concatenate(([False], x[a:b] == y[a + d : b + d], [False]))
        edges = (np.flatnonzero(same[1:] != same[:-1]) + a).tolist()
        out |= {(e, f) for e, f in zip(edges[::2], edges[1::2], strict=True) if f - e >= MIN_WORDS}
    return out


def aligned(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(start, end, ref start, ref end, equal words) of each passage of a chain; s: its segments (p, p_end, q, q_end).

    A chain that is too unlike as a whole is cut into its longest part that is alike enough and what lies on either side
    of that, and each is looked at by itself.
    """
    units = _units(x, y, s)
    if not units:
        return []
    u = np.array(units, np.int64)
    between = [_lcs(x[a[1] : b[0]], y[a[3] : b[2]]) for a, b in zip(units, units[1:])]
    before = np.concatenate(([0], np.cumsum(u[:-1, 1] - u[:-1, 0] + between)))
    through = before + u[:, 1] - u[:, 0]

    def whole(i: int, j: int) -> tuple[int, int, int, int, int] | None:
        p, q, p_end, q_end = units[i][0], units[i][2], units[j][1], units[j][3]
        left, ref_left, gain_left = _reach(x[max(0, p - REACH) : p][::-1].tolist(), y[max(0, q - REACH) : q][::-1].tolist())
        right, ref_right, gain_right = _reach(x[p_end : p_end + REACH].tolist(), y[q_end : q_end + REACH].tolist())
        start, end, ref, ref_end = p - left, p_end + right, q - ref_left, q_end + ref_right
        equal = int(through[j] - before[i]) + gain_left + gain_right
        if end - start < MIN_WORDS or equal < MIN_IDENTITY * max(end - start, ref_end - ref):
            return None
        return start, end, ref, ref_end, equal

    def longest(i: int, j: int) -> tuple[int, int]:
        open_x, open_y = before - MIN_IDENTITY * u[:, 0], before - MIN_IDENTITY * u[:, 2]
        shut_x, shut_y = through - MIN_IDENTITY * u[:, 1], through - MIN_IDENTITY * u[:, 3]
        best = (-1, i, i)
        for a in range(i, j + 1):
            if u[j, 1] - u[a, 0] <= best[0]:
                break
            b = a + int(np.flatnonzero((shut_x[a : j + 1] >= open_x[a]) & (shut_y[a : j + 1] >= open_y[a]))[-1])
            best = max(best, (int(u[b, 1] - u[a, 0]), a, b), key=lambda t: t[0])
        return best[1:]

    out, todo = [], [(0, len(units) - 1)]
    while todo:
        i, j = todo.pop()
        span = whole(i, j)
        if span is None and i < j:
            a, b = longest(i, j)
            if (a, b) != (i, j):
                span = whole(a, b)
            todo += [part for part in ((i, a - 1), (b + 1, j)) if part[0] <= part[1]]
        if span:
            out.append(span)
    return sorted(out)


def aligned_all(x: np.ndarray, y: np.ndarray, s: np.ndarray, shifts: list[int], hi: int) -> tuple[list[tuple[int, ...]], list[tuple[int, int]]]:
    """aligned and equal_runs of a chain and its shifts, up to hi: the fewest that hold all windows of them all."""
    if len(shifts) == 1:
        return aligned(x, y, s), list(equal_runs(x, y, s))
    _, p, _, q = s[-1].tolist()
    n = min(hi - p, len(x) - p, len(y) - q)
    long = s.copy()
    long[-1, [1, 3]] += int(np.append(x[p : p + n] != y[q : q + n], True).argmax())  # as far as words are equal
    spans, runs = aligned(x, y, long), equal_runs(x, y, long)
    whole = [max(rows, key=lambda r: r[1] - r[0], default=(0, 0)) for rows in (spans, runs)]
    for d in shifts:
        start, end = max(0, int(s[0, 0]) + d - REACH), min(len(x), int(s[-1, 1]) + d + REACH)  # no passage of it goes further
        if not all(r[0] <= start and end <= r[1] for r in whole):
            moved = s + np.array([d, d, 0, 0])
            spans += aligned(x, y, moved)
            runs |= equal_runs(x, y, moved)
    return fewest(spans), fewest(list(runs))


SPANS = "id long, start int, end int, ref_id long, ref_start int, ref_end int, equal int, n int, exact boolean"


def aligned_chains(chains: DataFrame, words: DataFrame, name: str) -> DataFrame:
    """id, start, end, ref_id, ref_start, ref_end, equal, n (words of the document) of the passages of chains, and with
    exact = true the runs of equal words in them. chains: a written table.

    Both sides' words around a chain are cut out in the join, so that no text is repeated outside of it.
    """
    ids = store.keep(chains.select(F.explode(F.array("id", "ref_id")).alias("id")).distinct(), name + "-ids")
    words, _ = store.split(words, "id", ids)
    last = F.element_at("segments", -1) + F.col("hi") - F.element_at("segments", -3)  # of all shifts in a row
    piece = lambda body, start, end: F.substring(F.col(body), 4 * start + 1, 4 * (end - start))
    ends = chains.withColumn("x_from", F.greatest(F.col("lo") - REACH, F.lit(0))).withColumn("y_from", F.greatest(F.element_at("segments", 3) - REACH, F.lit(0)))
    with_ref = ends.join(words.select(F.col("id").alias("ref_id"), F.col("words").alias("body")), "ref_id").select("id", "ref_id", "hi", "x_from", "y_from", "segments", "shifts", piece("body", F.col("y_from"), last + REACH).alias("y"))
    both = with_ref.join(words.select("id", F.col("words").alias("body")), "id")
    both = both.select("id", "ref_id", "hi", "x_from", "y_from", "segments", "shifts", piece("body", F.col("x_from"), F.col("hi") + REACH).alias("x"), "y", (F.length("body") / 4).cast("int").alias("n"))

    def run(batches):
        for batch in batches:
            rows = []
            for i, ref, hi, x_from, y_from, segments, shifts, x, y, n in zip(*[batch.column(k).to_pylist() for k in range(10)], strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                s = np.array(segments, np.int64).reshape(-1, 4) - np.array([x_from, x_from, y_from, y_from])
                spans, runs = aligned_all(x, y, s, shifts, hi - x_from)
                for start, end, ref_start, ref_end, equal in spans:
                    rows.append((i, start + x_from, end + x_from, ref, ref_start + y_from, ref_end + y_from, equal, n, False))
                rows += [(i, start + x_from, end + x_from, ref, None, None, end - start, n, True) for start, end in runs]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SPANS.split(", ")])

    return store.keep(both.mapInArrow(run, SPANS), name)


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, start, end, ref_id, ref_start, ref_end (in words, ends excluded), equal: one row a passage and later copy."""
    spark = docs.sparkSession
    store.ship(spark)
    store.small_batches(spark)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    words = store.keep(worded(docs), "words")
    with store.tables(spark) as own:
        buckets = store.parts_for(words, BUCKET_BYTES)
        anchors = [store.keep(first_of_all(first_in_part(words, buckets, turn)), "anchors") for turn in range(TURNS)]
        shared = store.keep(seeded(words, functools.reduce(DataFrame.union, anchors)), "seeded")
        own.release(shared)
    chains = shared.filter("ref_id is not null").drop("places", "own")
    found = aligned_chains(store.keep(chains.filter("outer"), "outer"), words, "found")

    marks = shared.filter("ref_id is null").select("id", "places", "own")
    # No list is longer than its text.
    exact = found.filter("exact").groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("exact"))
    marks = store.keep(marks.join(exact, "id", "left"), "marks")
    windows = met_first(windows_of(store.split(words, "id", marks)[0].join(marks, "id")), "windows")
    store.small_batches(spark, 10_000)
    more = store.keep(chains_of(windows.filter("id <> ref_id"), window_runs), "window-chains")
    store.small_batches(spark)

    # An inner chain is covered if all windows that its seeds may lie in are; a chain of windows ends where they end.
    spans = store.keep(found.filter("not exact").groupBy("id").agg(F.collect_set(F.struct("start", "end", "n")).alias("spans")), "spans")
    beyond = F.when(F.col("inner"), MIN_WORDS).otherwise(0)
    covers = lambda s: (s["start"] <= F.greatest(F.col("lo") - beyond, F.lit(0))) & (s["end"] >= F.least(F.col("hi") + beyond, s["n"]))
    rest = chains.filter("not outer").withColumn("inner", F.lit(True)).union(more.withColumn("inner", F.lit(False))).join(spans, "id", "left")
    rest = store.keep(rest.filter(~F.coalesce(F.exists("spans", covers), F.lit(False))).drop("spans", "inner"), "rest")
    both = found.union(aligned_chains(rest, words, "found-later")).filter("not exact")

    # Rows inside of a row of the same document go: one of those that begin no later ends no earlier.
    order = Window.partitionBy("id").orderBy("start", F.desc("end"), F.desc("equal"), "ref_id", "ref_start", "ref_end").rowsBetween(Window.unboundedPreceding, -1)
    outer = both.withColumn("before", F.max("end").over(order)).filter(F.col("before").isNull() | (F.col("before") < F.col("end")))
    return store.keep(outer.select("id", "start", "end", "ref_id", "ref_start", "ref_end", "equal"), "passages")


_WORD = re.compile(r"[^ \t-\r]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of spans (start, end excluded) and the blanks after them."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at, done = [], 0, 0
    for start, end in sorted(spans):
        start, end = max(start, done), min(end, len(words))
        if start >= end:
            continue
        out.append(text[at : words[start][0]])
        at = words[end][0] if end < len(words) else len(text)
        done = end
    return "".join(out) + text[at:]


def removed(docs: DataFrame) -> DataFrame:
    """docs with every later copy of a shared passage cut out of its text (n_chars follows, where there is one).

    Documents of which no word is left go; those without a cut stay as they are, empty ones too.
    """
    spark = docs.sparkSession
    columns = [F.col(f"`{c}`") for c in docs.columns]
    cuts, cut_id = store.fresh_name(docs, "_spans"), store.fresh_name(docs, "_cut_id")
    with store.tables(spark) as own:
        if store.keyed(docs)[1]:
            named, row = docs, "doc_id"
        else:
            row = store.fresh_name(docs, "_row")
            named = store.keep(docs.withColumn(row, F.monotonically_increasing_id()), "substring-rows")
        spans = passages(named, doc_id=row)
        per = spans.groupBy(F.col("id").alias(cut_id)).agg(F.collect_list(F.struct("start", "end")).alias(cuts))  # no more than a text has seeds
        per = store.keep(per, "cuts")
        own.release(named, per)
    doubtful, sure = store.split(named, row, per, cut_id)
    met = doubtful.join(per, F.col(f"`{row}`").cast("long") == F.col(cut_id), "left").select(*columns, cuts)
    place, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = [without(t or "", [(s["start"], s["end"]) for s in spans]) for t, spans in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            cut = batch.select(list(range(batch.num_columns - 1))).set_column(place, batch.schema.field(place).name, pa.array(texts, pa.string()))
            if size is not None:
                cut = cut.set_column(size, batch.schema.field(size).name, pa.array([len(t) for t in texts]).cast(batch.schema.field(size).type))
            yield cut.filter(pa.array([bool(t.strip(store.BLANKS)) for t in texts], pa.bool_()))

    store.small_batches(spark)
    changed = met.filter(F.col(cuts).isNotNull()).mapInArrow(run, docs.select(*columns).schema)
    return sure.select(*columns).union(met.filter(F.col(cuts).isNull()).select(*columns)).union(changed)


def op8_repeated_passages(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with store.tables(spark) as own:
        out = passages(docs)
        own.release(out)
    return out.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("ref_id").alias("first_doc_id"), F.col("ref_start").alias("first_start_word"), F.col("ref_end").alias("first_end_word"), (F.col("end") - F.col("start")).alias("n_words"), F.col("equal").alias("n_equal"))
