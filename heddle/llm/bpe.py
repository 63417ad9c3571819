"""Byte-level BPE encoding and decoding (7).

Pre-tokenisation without a regex engine: code points become class symbols (with one or two symbols of look-ahead folded
in), and a finite automaton says at which symbols a piece starts. The automaton runs as an associative scan: each block
of symbols is reduced to its transition function for all states at once, the functions are composed over blocks by
doubling, and a second pass fills in the states. The slices then go through a cache of merged pieces. Character offsets
of the slices are kept beside the ids.

Defined cases: a null text is empty, an empty text has no ids, any doc_id (null, repeated) is passed through, and each
row is encoded by itself, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

# Symbols of the automaton.
BREAK, LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, LAST_SPACE, LAST_BLANK = range(9)
# States: between pieces, in letters, in numbers, in others, in spaces, after a leading space, 1 or 2 left of a contraction.
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, LED, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8
COLUMNS = 512
#: Pieces that a worker remembers in each of two generations.
CACHE = 400_000
#: Unicode's white space, and the contractions' letters after the apostrophe.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts) by symbol and state."""
    go, start = np.zeros((9, STATES), np.uint8), np.zeros((9, STATES), bool)
    for state in range(STATES):
        for symbol, mine in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (SPACES, IN_SPACES)):
            goes_on = state == mine or state == LED and symbol != SPACES
            go[symbol, state], start[symbol, state] = mine, not goes_on
        for symbol, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
            goes_on = state in (IN_OTHERS, LED)
            go[symbol, state], start[symbol, state] = (IN_OTHERS if goes_on else left), not goes_on
        go[LAST_SPACE, state], start[LAST_SPACE, state] = LED, True
        go[LAST_BLANK, state], start[LAST_BLANK, state] = NONE, True
    go[LETTER, ONE_LEFT], start[LETTER, ONE_LEFT] = NONE, False
    go[LETTER, TWO_LEFT], start[LETTER, TWO_LEFT] = ONE_LEFT, False
    return go, start


_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACES by code point."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = SPACES
        _classes = table
    return _classes


def symbols(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """codes: code points of texts with a filler after each; breaks: where the fillers are."""
    out = classes()[codes]
    out[breaks] = BREAK
    n = len(codes)
    quotes = np.flatnonzero((codes == 39) & (out == OTHER))
    after = np.zeros(n + 2, np.uint32)
    after[:n] = codes
    after[breaks] = 0
    a, b = after[quotes + 1], after[quotes + 2]
    out[quotes[np.isin(a, [ord(c) for c in ONE_LETTER])]] = SHORT
    for x, y in TWO_LETTERS:
        out[quotes[(a == ord(x)) & (b == ord(y))]] = LONG
    blank = out == SPACES
    last = blank.copy()
    last[:-1] &= ~blank[1:] & (out[1:] != BREAK)
    last[-1:] = False
    out[last] = np.where(codes[last] == 32, LAST_SPACE, LAST_BLANK)
    return out


def piece_starts(sym: np.ndarray) -> np.ndarray:
    """Where pieces start, by an associative scan of transition functions."""
    go, start = automaton()
    flat = go.ravel()
    n = len(sym)
    rows = -(-n // COLUMNS)
    grid = np.zeros(rows * COLUMNS, np.uint8)
    grid[:n] = sym
    steps = np.ascontiguousarray(grid.reshape(rows, COLUMNS).T).astype(np.intp) * STATES
    block = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for step in steps:
        block = flat[step[:, None] + block]
    far = 1
    while far < rows:  # block[i] becomes the function of all blocks up to i
        block[far:] = np.take_along_axis(block[far:], block[:-far], 1)
        far *= 2
    state = np.concatenate(([NONE], block[:-1, NONE])).astype(np.uint8)
    index = np.empty((COLUMNS, rows), np.intp)
    for k, step in enumerate(steps):
        index[k] = step + state
        state = flat[index[k]]
    return np.flatnonzero(start.ravel()[index.T.ravel()[:n]])


def slices(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All pieces in order, the number of pieces of each text, and each piece's character offset in its text."""
    if not texts:
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    big = "\0".join(texts) + "\0"
    codes = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    breaks = np.cumsum(lengths + 1) - 1
    starts = piece_starts(symbols(codes, breaks))
    of = np.searchsorted(breaks, starts)
    ends = np.minimum(np.append(starts[1:], len(codes)), breaks[of])
    pieces = [big[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pieces, np.bincount(of, minlength=len(texts)), starts - (breaks - lengths)[of]


class Merger:
    """Merges pieces, and remembers them in two generations: when the younger is full it replaces the older."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.young, self.old = ranks, {}, {}
        self.ids = list(range(max(ranks.values()) + 1))  # one object for each id
        a, b, to = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (x := ranks.get(token[:k])) is not None and (y := ranks.get(token[k:])) is not None:
                    a.append(x)
                    b.append(y)
                    to.append(rank)
        self.base = len(self.ids)
        key = np.array(a, np.int64) * self.base + np.array(b, np.int64)
        order = np.argsort(key)
        self.keys, self.to = key[order], np.array(to, np.int32)[order]
        self.single = np.array([ranks[bytes([k])] for k in range(256)], np.int32)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that two neighbours merge to, or FAR."""
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.to[at], FAR)

    def merge_many(self, raws: list[bytes]) -> list[list[int]]:
        """merge() of many short pieces at once: a row for each piece, one merge a row and round."""
        width = max(map(len, raws))
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        grid = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(len(raws), width)
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], self.single[grid], -1)
        ids = np.concatenate((ids, np.full((len(raws), 1), -1, ids.dtype)), 1)
        pairs = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(raws))
        while len(live):
            mine = pairs[live]
            j = mine.argmin(1)
            least = mine[np.arange(len(live)), j]
            on = least < FAR
            live, j, least = live[on], j[on], least[on]
            if not len(live):
                break
            move = columns[None, :] + (columns[None, :] > j[:, None])  # what stands right of the pair moves left
            row = np.take_along_axis(ids[live], np.minimum(move, width), 1)
            row[np.arange(len(live)), j] = least
            ids[live, :width] = row
            ids[live, width] = -1
            rank = np.concatenate((np.take_along_axis(pairs[live], np.minimum(move, width - 1), 1), np.full((len(live), 1), FAR)), 1)[:, :width]
            rank[:, width - 1] = FAR
            right = np.where(j + 1 < width, row[np.arange(len(live)), np.minimum(j + 1, width - 1)], -1)
            rank[np.arange(len(live)), j] = self.pair_ranks(least, right)
            left = j > 0
            rank[left, j[left] - 1] = self.pair_ranks(row[left, j[left] - 1], least[left])
            pairs[live] = rank
        keep = (ids >= 0).sum(1).tolist()
        return [r[:k] for r, k in zip(ids.tolist(), keep, strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Brings all these pieces into memory."""
        if len(self.young) + len(pieces) > CACHE:
            self.old, self.young = self.young, {}
        todo: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            if (ids := self.old.get(p)) is not None:
                self.young[p] = ids
            elif (rank := self.ranks.get(raw := p.encode("utf-8", "surrogatepass"))) is not None:
                self.young[p] = (self.ids[rank],)
            elif len(raw) > 64:
                self.young[p] = tuple(merge(raw, self.ranks))
            else:
                todo.setdefault((len(raw) + 3) // 4, []).append((p, raw))
        for some in todo.values():
            for (p, _), ids in zip(some, self.merge_many([r for _, r in some]), strict=True):
                self.young[p] = tuple(map(self.ids.__getitem__, ids))

    def forget_long(self, pieces: set[str]) -> None:
        for p in pieces:
            if len(p) > 64:
                del self.young[p]


FAR = 1 << 30


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Long pieces go through a heap, so that time stays in proportion to n log n."""
    if len(raw) > 96:
        return _merge_long(raw, ranks)
    parts = [raw[i : i + 1] for i in range(len(raw))]
    far = 1 << 60
    pairs = [ranks.get(a + b, far) for a, b in itertools.pairwise(parts)]
    while pairs and (least := min(pairs)) < far:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], far)
    return [ranks[p] for p in parts]


def _merge_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(raw)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(raw[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n):
        offer(i)
    gone = bytearray(n)
    while heap:
        _, i, mid, to = heapq.heappop(heap)
        if gone[i] or end[i] != mid or mid >= n or end[after[i]] != to:
            continue
        j = after[i]
        gone[j], end[i], after[i] = 1, to, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[raw[i : end[i]]])
        i = after[i]
    return out


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


_mergers: dict[str, tuple[Merger, list[bytes]]] = {}


def merger_of(raw: bytes) -> tuple[Merger, list[bytes]]:
    """The merger and the bytes of each id, kept by a worker from one task to the next."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _mergers:
        ranks = parse_ranks(raw)
        vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            vocabulary[i] = token
        _mergers[key] = Merger(ranks), vocabulary
    return _mergers[key]


def encode_batch(texts: list[str], merger: Merger) -> tuple[list[list[int]], list[np.ndarray]]:
    """Of each text: the ids, and the character offsets of its pieces."""
    pieces, counts, offsets = slices(texts)
    unknown = set(pieces).difference(merger.young)
    merger.learn(unknown)
    if len(merger.young) <= len(unknown):  # a new generation: all that this batch needs has to be in it
        merger.learn(set(pieces).difference(merger.young))
    known, ids, offs, at = merger.young, [], [], 0
    for k in counts.tolist():
        ids.append(list(itertools.chain.from_iterable(map(known.__getitem__, pieces[at : at + k]))))
        offs.append(offsets[at : at + k])
        at += k
    merger.forget_long(unknown)
    return ids, offs


def decode(ids: list[int], vocabulary: list[bytes]) -> bytes:
    return b"".join(map(vocabulary.__getitem__, ids))


def _texts(batch: pa.RecordBatch, column: int) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def _chunks(texts: list[str], most: int = 1_500_000):
    """Runs of texts of about `most` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


@functools.lru_cache(1)
def numerals(n: int) -> list[str]:
    return list(map(str, range(n)))


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _mapped(df: DataFrame, ranks_path: str, function, schema: str) -> DataFrame:
    spark = df.sparkSession
    store.ship(spark)
    store.small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_file(ranks_path))

    def run(batches):
        merger, vocabulary = merger_of(ranks.value)
        for batch in batches:
            yield function(batch, merger, vocabulary)

    return df.mapInArrow(run, schema)


def encoded(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids array<int>, offsets array<int> (character offset of each piece) of every row."""

    def function(batch, merger, _):
        ids, offsets = [], []
        for part in _chunks(_texts(batch, 1)):
            a, c = encode_batch(part, merger)
            ids += a
            offsets += [x.astype(np.int32) for x in c]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids", "offsets"])

    df = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return _mapped(df, ranks_path, function, "doc_id long, n_tokens long, ids array<int>, offsets array<int>")


def decoded(ids: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the text of the column ids."""

    def function(batch, _, vocabulary):
        texts = [decode(x or [], vocabulary).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _mapped(ids.select("doc_id", "ids"), ranks_path, function, "doc_id long, text string")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """encoded() and the decoding of its ids, as counts and digests."""

    def function(batch, merger, vocabulary):
        n, a, b, said = [], [], [], numerals(len(vocabulary))
        for part in _chunks(_texts(batch, 1)):
            ids, _ = encode_batch(part, merger)
            n += map(len, ids)
            a += [hashlib.sha256(",".join(map(said.__getitem__, x)).encode()).hexdigest() for x in ids]
            b += [hashlib.sha256(decode(x, vocabulary)).hexdigest() for x in ids]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs.select("doc_id", "text"), ranks_path, function, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
