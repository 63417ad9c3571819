import collections
import random
import re

from pyspark.sql import functions as F

from heddle.llm import mixing, quality_rules
from tests_llm_helpers import WORDS, by_id, prose


def expected_measures(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count, covered = collections.Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "a b", "x " * 50, "# *\n# *\n\n  \n# *", prose(rng, 300, 5), prose(rng, 100), ("a b c d e f g h " * 3), "\x0bz\x0cy z w " * 9, "\x1c\x1d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["quality"] for r in quality_rules.measured(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][m] for m in quality_rules.MEASURES) == expected_measures(t), t
        n, r = got[i]["n_words"], got[i]["n_repeat_words"]
        assert (got[i]["short"], got[i]["repeats"]) == (n < 20, 100 * r > 30 * n)


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good, bad = "fine words in a line " * 1 + " ".join(f"t{k}" for k in range(40)), "short"
    rows = [(i, bad if i % 10 else good, "bad.example") for i in range(400)]
    rows += [(1000 + i, good if i % 20 else bad, f"host{i % 15}") for i in range(600)]
    rows += [(5000, bad, "new.example"), (5001, good, "new.example")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality_rules.keep_good(df).collect()}
    assert not kept & set(range(400))
    assert 5001 in kept and 1001 in kept and 1000 not in kept


def test_host_join_by_salt_gives_the_same(spark, odd, monkeypatch):
    one = sorted(map(str, quality_rules.keep_good(odd).collect()))
    monkeypatch.setattr(quality_rules.store, "BROADCAST_ROWS", 0)
    assert sorted(map(str, quality_rules.keep_good(odd).collect())) == one


def test_quality_odd_and_empty(odd, none):
    out = quality_rules.keep_good(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert 3 not in ids and 4 not in ids and 7 not in ids and {1, 2, 6}.issubset(ids)
    assert quality_rules.keep_good(none).collect() == []


def test_targets_fill_like_water(spark):
    sizes = {"a": 100, "b": 5000, "c": 70, "d": 0, "e": 900, None: 40}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = dict(zip(order, (5, 2, 1, 5, 2, 1), strict=True))
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[k] for k in full)
        open_ = [k for k in order if k not in full]
        share = {k: rest * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] > 2 * sizes[k]}
        if not over:
            break
        full |= over
    for k in order:
        assert abs(got[k] - (2 * sizes[k] if k in full else share[k])) < 1e-6


def test_copies_come_near_targets_and_reruns_agree(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, int(rng.lognormvariate(4, 1)) + 1), rng.choice(["hot"] * 6 + ["b", "c", "d", None])) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted((r["doc_id"], r["n_copies"], r["size"], str(r["source"]), r["target"]) for r in mixing.copies(x).collect()) for x in (df, df.repartition(7)))
    assert a == b and max(r[1] for r in a) <= 2
    for s in {r[3] for r in a}:
        taken, target = sum(r[1] * r[2] for r in a if r[3] == s), next(r[4] for r in a if r[3] == s)
        assert abs(taken - target) < 0.03 * target
    mixed = collections.Counter(r["doc_id"] for r in mixing.mixed(df).select("doc_id").collect())
    assert mixed == {r[0]: r[1] for r in a if r[1]}


def test_mixing_odd_and_empty(odd, none):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    out.collect()
    assert mixing.copies(none).collect() == [] and mixing.mixed(none).collect() == []
    sizes = by_id(mixing.copies(odd).filter(F.col("doc_id").isNotNull()), "size")
    assert sizes[3] == 0 and sizes[5] == 0 and sizes[6] == 30_000
