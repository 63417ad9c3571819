"""Token-ID output (3): ORC files of token ids in ascending doc_id order.

Documents are dealt out by range of (doc_id, text hash), sorted, encoded and written, one file a range. ORC run-length
encodes the integers of each stripe, keeps row indexes, and has Bloom filters on doc_id; so a reader takes stripes in
parallel, and a look-up of some doc_ids skips files, stripes and row groups by their statistics and filters.

Columns of the format: part int (place of the file in the order), row long (in the file), doc_id long, start_in_part
long (ids of the file before this row), n_tokens long, ids array<int>.

Defined cases: a null text is empty and has just the end id; null doc_ids come first; equal doc_ids are ordered by text
hash and text; an empty table gives an empty folder that reads as no rows.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

SCHEMA = "part int, row long, doc_id long, start_in_part long, n_tokens long, ids array<int>"
ORC = {"orc.compress": "ZSTD", "orc.stripe.size": str(64 << 20), "orc.create.index": "true", "orc.row.index.stride": "10000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
END_ID = 2
#: Words that a worker remembers in each of two generations.
CACHE = 500_000

class WordEncoder:
    """Encodes texts by the tokenizers library, each distinct run between ASCII blanks once.

    The tokenizer drops white space, puts texts in lower case and makes no token across white space, so the ids of a
    text are those of its runs in order (`splits_at_blanks` tells whether a tokenizer is of that kind; others get whole
    texts).
    """

    def __init__(self, json_text: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.tokenizer.encode_special_tokens = True
        self.by_word = splits_at_blanks(json_text)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.ends = {c: self._ids([c])[0].tobytes() for c in ".,"}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, word: bytes) -> bytes:
        """A run of letters in normal form goes straight to the library's merges; all else takes its whole path."""
        text = word.decode("utf-8", "surrogatepass")
        end = self.ends.get(text[-1:], b"")
        core = text[:-1] if end else text
        if core.isalpha() and (core.isascii() or core.lower() == core and unicodedata.is_normalized("NFC", core)):
            mapped = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_LETTERS)
            return np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], "<u4").tobytes() + end
        return self._ids([text])[0].tobytes()

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Remembers words; returns those that are not to be remembered."""
        if len(self.young) + len(words) > CACHE:
            self.old, self.young = self.young, {}
        long = {}
        for w in words:
            ids = self.old.get(w)
            if ids is None:
                ids = self._encode(w)
            if len(w) <= 100:
                self.young[w] = ids
            else:
                long[w] = ids
        return long

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """texts: in UTF-8. The ids of each, as little-endian 32-bit integers."""
        if not self.by_word:
            return [x.tobytes() for x in self._ids([t.decode() for t in texts])]
        words = [t.lower().split() for t in texts]
        flat = list(itertools.chain.from_iterable(words))
        ids = list(map(self.young.get, flat))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if gaps:
            before = self.young
            rest = self._learn({flat[i] for i in gaps})
            for i in gaps:
                ids[i] = self.young.get(flat[i]) or rest.get(flat[i]) or before.get(flat[i], b"")
        out, at = [], 0
        for w in words:
            out.append(b"".join(ids[at : at + len(w)]))
            at += len(w)
        return out


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def splits_at_blanks(json_text: str) -> bool:
    """Whether texts are put in lower case, what the pattern does not match is dropped, and it matches no blank."""
    import json

    spec = json.loads(json_text)
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    alternatives = re.sub(r"\[\^\\s[^\]]*\]\+?|\[\\p\{[LN]\}\]\+?|'[a-z]+|\|", "", pattern)
    norm = spec.get("normalizer") or {}
    lower = any(x.get("type") == "Lowercase" for x in norm.get("normalizers", [norm]))
    return lower and first.get("type") == "Split" and bool(first.get("invert")) and first.get("behavior") == "Removed" and bool(pattern) and not alternatives


_encoders: dict[int, WordEncoder] = {}


def encoder_of(json_text: str) -> WordEncoder:
    key = zlib.crc32(json_text.encode())
    if key not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[key] = WordEncoder(json_text)
    return _encoders[key]


def write_ids(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes docs and writes them at path in ascending doc_id order."""
    spark = docs.sparkSession
    store.ship(spark)
    store.small_batches(spark)
    told = spark.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        from pyspark import TaskContext

        encode, end = encoder_of(told.value), np.array([end_id], "<u4").tobytes()
        part, row, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ids = [x + end for x in encode([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()])]
            n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            ends = start + np.cumsum(n)
            flat = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(ids))])
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(row, row + len(ids))), batch.column(0), pa.array(ends - n), pa.array(n), pa.ListArray.from_arrays(offsets, flat)],
                ["part", "row", "doc_id", "start_in_part", "n_tokens", "ids"],
            )
            row, start = row + len(ids), int(ends[-1]) if len(ids) else start

    df = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts = store.parts_for(df)
    tie = F.xxhash64("text")
    df = df.repartitionByRange(parts, F.col("doc_id").asc(), tie).sortWithinPartitions("doc_id", tie, "text")
    df.mapInArrow(run, SCHEMA).write.options(**ORC).mode("error").orc(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows at path; doc_ids: only these, found through statistics and Bloom filters."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))


def with_start(spark: SparkSession, path: str) -> DataFrame:
    """part, start_of_part: ids of all files before each, from two integer columns only. One row a file."""
    parts = read_ids(spark, path).groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("ids_in_part"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("ids_in_part").over(order), F.lit(0).cast("long")).alias("start_of_part"))


def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    path = store.fresh_path(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer)
    starts = {r["part"]: r["start_of_part"] for r in with_start(spark, path).collect()}  # one row a file

    def run(batches):
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            flat, offsets = c["ids"].flatten(), c["ids"].offsets.to_numpy()
            flat = np.ascontiguousarray(flat.to_numpy().astype("<u4"))
            offsets = offsets - offsets[0]
            crc = [zlib.crc32(flat[i:j]) for i, j in itertools.pairwise(offsets.tolist())]
            base = np.fromiter((starts[p] for p in c["part"].to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([c["doc_id"], pa.array(base + c["start_in_part"].to_numpy()), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_ids(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
