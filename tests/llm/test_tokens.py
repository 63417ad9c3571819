import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heddle.llm import bpe, store, token_store

RANKS = bpe.read_file(P.path("byte_bpe_multi_50k.tiktoken"))
MERGER, VOCABULARY = bpe.merger_of(RANKS)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(RANKS), special_tokens={})
with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
    JSON = f.read()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'strevlmd  \n\t\r1!?.,\x0b\x1c"), st.characters(codec="utf-8")), max_size=60), max_size=8))
def test_ids_equal_the_library(texts):
    ids, offsets = bpe.encode_batch(texts, MERGER)
    assert ids == [TIKTOKEN.encode_ordinary(t) for t in texts]
    for t, i, o in zip(texts, ids, offsets, strict=True):
        assert bpe.decode(i, VOCABULARY) == t.encode()
        assert list(o) == sorted(set(o)) and (len(o) == 0) == (t == "")


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000 + "'s", " " * 3000, "é" * 2000, "\n\n \t x" * 400])
def test_long_pieces(text):
    assert bpe.encode_batch([text], MERGER)[0] == [TIKTOKEN.encode_ordinary(text)]


def test_encode_and_decode_tables(spark, odd, none):
    enc = bpe.encoded(odd, P.path("byte_bpe_multi_50k.tiktoken"))
    assert enc.count() == odd.count()
    back = sorted((r["doc_id"] or -1, r["text"]) for r in bpe.decoded(enc, P.path("byte_bpe_multi_50k.tiktoken")).collect())
    assert back == sorted((r["doc_id"] or -1, r["text"] or "") for r in odd.collect())
    assert bpe.encoded(none, P.path("byte_bpe_multi_50k.tiktoken")).collect() == []


def whole(texts):
    t = Tokenizer.from_str(JSON)
    t.encode_special_tokens = True
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'sTREvlmd  \n\t\r1!?.,ΣσÉ́"), st.characters(codec="utf-8")), max_size=60), min_size=1, max_size=6))
def test_words_give_the_ids_of_whole_texts(texts):
    assert token_store.encoder_of(JSON)([t.encode() for t in texts]) == whole(texts)


def test_files_hold_all_ids_in_order(spark, odd, none):
    path = store.fresh_path(spark, "ids")
    token_store.write_ids(odd, path, JSON)
    starts = {r["part"]: r["start_of_part"] for r in token_store.with_start(spark, path).collect()}
    rows = sorted(token_store.read_ids(spark, path).collect(), key=lambda r: (r["part"], r["row"]))
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in odd.collect()), key=lambda x: (x is not None, x or 0))
    at = 0
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
    for r in rows:
        assert starts[r["part"]] + r["start_in_part"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        if r["doc_id"] is not None:
            assert zlib.crc32(np.array(r["ids"][:-1], "<u4").tobytes()) == zlib.crc32(whole([texts[r["doc_id"]]])[0])
        at += r["n_tokens"]
    assert [r["doc_id"] for r in token_store.read_ids(spark, path, [6]).collect()] == [6]
    empty = store.fresh_path(spark, "ids")
    token_store.write_ids(none, empty, JSON)
    assert token_store.read_ids(spark, empty).collect() == []


def test_run_order_is_random_free(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([(rng.randrange(10**6), "t%d" % i) for i in range(200)], "doc_id long, text string")
    path = store.fresh_path(spark, "ids")
    token_store.write_ids(df, path, JSON)
    ids = [r["doc_id"] for r in sorted(token_store.read_ids(spark, path).collect(), key=lambda r: (r["part"], r["row"]))]
    assert ids == sorted(ids)
