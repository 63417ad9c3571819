import random

import numpy as np

from heddle.llm import components, minhash, substring
from tests_llm_helpers import WORDS, prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def expected_components(rows):
    s = {i: shingles(t) for i, t in rows}
    up = {i: i for i in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a = len(s[i] & s[j])
            if a and 100 * a >= 75 * (len(s[i]) + len(s[j]) - a):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], ["new%d" % rng.randrange(50)], [w[k], "x"]])
    return " ".join(w)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    rows, base = [], prose(rng, 150)
    for _ in range(110):  # a large group of near copies, some too far from the others
        rows.append(edited(rng, base, rng.randrange(1, 12)))
    for _ in range(15):
        t = prose(rng, rng.randrange(1, 80), 300)
        rows += [t, t.upper(), edited(rng, t, rng.randrange(1, 4))]
    rows += ["a b c", "A  b\tc", "a b c d", "", None, "é a b c d e", "É a b c d e"]
    rng.shuffle(rows)
    rows = list(enumerate(rows, 10))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n"], r["component"]) for r in minhash.near_duplicates(df).collect()}
    assert got == expected_components(rows)


def test_pairs_that_just_miss_the_threshold_are_not_all_confirmed(spark, monkeypatch):
    rng = random.Random(34)
    base = prose(rng, 150).split()
    texts = [" ".join([*base, "end%d" % k]) for k in range(100)]  # one large component
    for k in range(60):  # each 0.744 like each of those, and linked with none
        at = rng.randrange(5, 120)
        texts.append(" ".join([*base[:at], *["new%d_%d" % (k, j) for j in range(17)], *base[at + 17 :]]))
    texts += [" ".join([*base[:40], *["new7_%d" % j for j in range(9)], *base[49:]]), " ".join([*base[:60], "one", "two", *base[62:]])]
    rng.shuffle(texts)
    rows, tried, real = list(enumerate(texts)), [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, of: tried.append(pairs.count()) or real(pairs, of))
    got = {r["id"]: (r["n"], r["component"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected_components(rows)
    assert sum(tried) < 2000  # of 6,000 pairs that just miss it


def test_links_across_sizes_are_not_lost_to_the_prefixes(spark):
    rng = random.Random(35)
    base = prose(rng, 300).split()
    rows = []
    for k in range(150):  # parts of one text, of many sizes
        size = rng.randrange(20, 300)
        at = rng.randrange(0, 300 - size)
        rows.append((k, edited(rng, " ".join(base[at : at + size]), rng.randrange(0, 1 + size // 25))))
    nodes = spark.createDataFrame([(7, i, len(shingles(t)), i) for i, t in rows], "key long, id long, n long, comp long")
    tried = spark.createDataFrame([], "a long, b long")
    texts = spark.createDataFrame(rows, "id long, text string")
    got = {(r["a"], r["b"]) for r in minhash._across(nodes, texts, tried).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = {(i, j) for i in sets for j in sets if i < j and sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(links) > 100 and links <= got


def test_near_duplicates_odd_and_empty(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {r["id"]: r["component"] for r in rows}
    assert got[2] == 1 and got[3] == 3 and got[4] == 4 and got[None] is None
    out = minhash.keep_one(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert ids.count(7) == 1 and 1 in ids and 2 not in ids and ids.count(None) == 2
    assert minhash.near_duplicates(none).collect() == [] and minhash.keep_one(none).collect() == []


def test_rows_of_one_id_have_the_links_of_each_text(spark):
    rng = random.Random(33)
    x, y, other = prose(rng, 100), prose(rng, 100), prose(rng, 100)
    rows = [(5, x), (5, y), (7, x + " one"), (9, y + " one"), (1, "one " + x), (20, other), (None, other)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"], r["component"]) for r in got if r["id"] is not None) == [(1, 1), (5, 1), (5, 1), (7, 1), (9, 1), (20, 20)]
    assert [r["component"] for r in got if r["id"] is None] == [None]
    rows = [(-1, other), (None, x), (-2, y), (None, x + " one"), (4, x + " two")]
    kept = [(r[0], r[1]) for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([(-1, other), (-2, y), (4, x + " two")], key=str)


def test_components_of_very_large_ids(spark):
    top = 2**62
    edges = [(top + i, top + i + 1) for i in range(12)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {top + i: top for i in range(1, 13)}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 140)}


def test_chain_follows_both_orders():
    up = [(0, 10, 100, 110), (20, 30, 125, 135), (60, 90, 20, 50)]
    chains = substring.chained(up)
    assert [(0, 10, 100, 110), (20, 30, 125, 135)] in chains and [(60, 90, 20, 50)] in chains


def test_passages_are_found_and_cut(spark):
    rng = random.Random(8)
    passage, other = prose(rng, 70), prose(rng, 55)
    fuzzy = passage.split()
    fuzzy[30] = "changed"
    del fuzzy[50]
    rows = [(1, prose(rng, 100) + " " + passage + " " + prose(rng, 50)), (2, prose(rng, 80) + "\n" + passage), (3, " ".join(fuzzy) + " " + prose(rng, 90)), (4, prose(rng, 200)), (5, other + " " + prose(rng, 20)), (6, prose(rng, 9) + " " + other)]
    rows += [(100 + k, prose(rng, 30) + " " + passage) for k in range(60)]  # one passage in very many documents
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {(r["id"], r["ref_id"]): r for r in substring.passages(df).collect()}
    assert {i for i, _ in spans} == {2, 3, 6} | {100 + k for k in range(60)} and all(ref in (1, 5) for _, ref in spans)
    s = spans[2, 1]
    assert (s["start"], s["end"], s["ref_start"], s["ref_end"], s["equal"]) == (80, 150, 100, 170, 70)
    assert spans[3, 1]["start"] == 0 and 66 <= spans[3, 1]["end"] <= 70
    left = {r["doc_id"]: r["text"] for r in substring.removed(df).collect()}
    assert left[1] == rows[0][1] and left[4] == rows[3][1]
    assert WORDS.findall(left[2]) == WORDS.findall(rows[1][1])[:80]
    assert passage.split()[60] not in left[150].split()[30:]


def test_passages_with_unlike_words_between_are_all_found(spark):
    rng = random.Random(21)
    rows, want = [], set()
    for k, (size, gap, ref_gap) in enumerate([(60, 0, 60), (60, 80, 0), (60, 0, 80), (100, 150, 0), (100, 100, 100), (200, 0, 500)]):
        one, two = prose(rng, size), prose(rng, size)
        rows += [(10 * k + 1, " ".join([one, prose(rng, ref_gap), two])), (10 * k + 2, " ".join([one, prose(rng, gap), two]))]
        want |= {(10 * k + 2, 10 * k + 1, 0, size), (10 * k + 2, 10 * k + 1, size + gap, 2 * size + gap)}
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {w for w in want if any((r["id"], r["ref_id"]) == w[:2] and r["start"] <= w[2] and w[3] <= r["end"] for r in got)}
    assert covered == want and all(r["equal"] >= 0.75 * max(r["end"] - r["start"], r["ref_end"] - r["ref_start"]) for r in got)


def test_words_in_common_order_at_any_length():
    rng = np.random.default_rng(3)
    for n, m, kinds in [(0, 5, 3), (7, 7, 2), (60, 90, 8), (450, 430, 30), (700, 650, 5)]:
        x, y = rng.integers(0, kinds, n).astype(np.uint32), rng.integers(0, kinds, m).astype(np.uint32)
        row = [0] * (m + 1)
        for a in x:
            last = row[:]
            for j in range(m):
                row[j + 1] = last[j] + 1 if y[j] == a else max(last[j + 1], row[j])
        assert substring._lcs(x, y) == row[-1]
    long = rng.integers(0, 4000, 30_000).astype(np.uint32)
    assert substring._lcs(long, long.copy()) == 30_000


def test_ends_around_a_long_middle_of_another_document(spark):
    rng = random.Random(22)
    middle, head, tail = prose(rng, 500), prose(rng, 300), prose(rng, 300)
    copy = " ".join([head, middle, tail])
    rows = [(1, prose(rng, 20) + " " + middle), (2, copy), (3, copy)]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any((r["id"], r["ref_id"], r["start"], r["end"], r["equal"]) == (3, 2, 0, 1100, 1100) for r in got)


def test_passages_of_pieces_and_of_repeats(spark):
    rng = random.Random(23)
    one, two, line = prose(rng, 30), prose(rng, 30), prose(rng, 9)
    rows = [(1, prose(rng, 40) + " " + one), (2, two + " " + prose(rng, 40))]
    rows += [(k, " ".join([prose(rng, 20), one, two, prose(rng, 20)])) for k in range(3, 40)]
    rows += [(50, " ".join([line] * 30)), (51, prose(rng, 12) + " " + " ".join([line] * 20)), (60, "word " * 200), (61, prose(rng, 5) + " word" * 90)]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covers = lambda i, refs, start, end: set(range(start, end)) <= {p for r in got if r["id"] == i and r["ref_id"] in refs for p in range(r["start"], r["end"])}
    assert all(covers(k, range(3, k), 20, 80) for k in range(4, 40))  # one that has a word more in common is named instead
    assert covers(51, [50], 12, 192) and covers(61, [60], 5, 95)


def test_every_exact_window_is_covered(spark):
    rng = random.Random(24)
    pool = [prose(rng, n, 60) for n in (10, 20, 30, 45, 60)]
    rows = [(k, " ".join(rng.choice(pool) if rng.random() < 0.8 else prose(rng, 15) for _ in range(12))) for k in range(60)]
    covered = {}
    for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        covered.setdefault(r["id"], set()).update(range(r["start"], r["end"]))
    first = {}
    for k, text in rows:
        words = text.split()
        for at in range(len(words) - 49):
            if first.setdefault(tuple(words[at : at + 50]), k) != k:
                assert set(range(at, at + 50)) <= covered.get(k, set()), (k, at)


def test_fuzzy_passages_with_every_tenth_word_changed(spark):
    rng = random.Random(25)
    rows = []
    for k in range(20):
        passage = prose(rng, 60).split()
        changed = ["x%d" % rng.randrange(10**6) if i % 10 == 9 else w for i, w in enumerate(passage)]
        rows += [(2 * k, prose(rng, 40) + " " + " ".join(passage)), (2 * k + 1, " ".join(changed) + " " + prose(rng, 40))]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["id"], r["ref_id"]) for r in got} == {(2 * k + 1, 2 * k) for k in range(20)}


def _best_local(x, y):
    """Brute force: (words of x, of y, equal words) of the best local alignment, +1 a match, -3 a gap or mismatch."""
    best, rows = (0, 0, 0), [[(0, 0, 0, 0)] * (len(y) + 1)]  # score, begin in x, begin in y, equal
    for i, a in enumerate(x):
        row = [(0, i + 1, 0, 0)]
        for j, b in enumerate(y):
            old = rows[-1][j]
            options = [(old[0] + 1, old[1], old[2], old[3] + 1) if a == b else (old[0] - 3, *old[1:])]
            options += [(o[0] - 3, *o[1:]) for o in (rows[-1][j + 1], row[j])]
            cell = max(options)
            row.append(cell if cell[0] > 0 else (0, i + 1, j + 1, 0))
            if row[-1][0] > best[0]:
                best, where = (row[-1][0], 0, 0), (row[-1][1], i + 1, row[-1][2], j + 1, row[-1][3])
        rows.append(row)
    return where if best[0] else (0, 0, 0, 0, 0)


def test_all_rows_against_brute_force(spark):
    rng = random.Random(31)
    pool = [prose(rng, n, 900).split() for n in (55, 70, 90)]

    def edited(words):
        out = []
        for w in words:
            r = rng.random()
            out += [] if r < 0.02 else ["x%d" % rng.randrange(10**6)] if r < 0.06 else [w, "y"] if r < 0.08 else [w]
        return out

    rows = []
    for k in range(18):
        parts = [edited(rng.choice(pool)) if rng.random() < 0.5 else prose(rng, 25, 900).split() for _ in range(3)]
        rows.append((k, " ".join(w for part in parts for w in part)))
    texts = {k: t.split() for k, t in rows}
    covered = {}
    for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        x, y = texts[r["id"]][r["start"] : r["end"]], texts[r["ref_id"]][r["ref_start"] : r["ref_end"]]
        row = [0] * (len(y) + 1)
        for a in x:
            last = row[:]
            for j, b in enumerate(y):
                row[j + 1] = last[j] + 1 if a == b else max(last[j + 1], row[j])
        assert r["ref_id"] < r["id"] and len(x) >= 50 and r["equal"] <= row[-1] and r["equal"] >= 0.75 * max(len(x), len(y))
        covered.setdefault(r["id"], set()).update(range(r["start"], r["end"]))
    wanted = found = 0
    for i in texts:
        for k in range(i):
            a, b, c, d, equal = _best_local(texts[i], texts[k])
            if b - a >= 50 and equal >= 0.85 * max(b - a, d - c):
                wanted += 1
                found += len(covered.get(i, set()) & set(range(a, b))) >= 0.8 * (b - a)
    assert wanted > 20 and found >= 0.95 * wanted


def test_recall_of_changed_passages(spark):
    rng, rows = random.Random(32), []
    cases = [(60, 0.10), (100, 0.20)]
    for c, (size, rate) in enumerate(cases):
        for k in range(60):
            words = prose(rng, size).split()
            changed = ["x%d" % rng.randrange(10**6) if rng.random() < rate else w for w in words]
            rows += [(1000 * c + 2 * k, prose(rng, 40) + " " + " ".join(words)), (1000 * c + 2 * k + 1, " ".join(changed) + " " + prose(rng, 40))]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for c, (size, _) in enumerate(cases):
        hits = {r["id"] for r in got if r["id"] // 1000 == c and r["id"] % 2 and r["ref_id"] == r["id"] - 1 and min(r["end"], size) - r["start"] >= size / 2}
        assert len(hits) >= 54


def test_substring_odd_and_empty(odd, none):
    out = substring.removed(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert 2 not in ids and 1 in ids and 3 in ids and ids.count(None) == 2  # the copy of 1 is cut to nothing
    assert substring.removed(none).collect() == [] and substring.passages(none).collect() == []


def test_cut_keeps_the_rest():
    assert substring.without("a b\nc  d e", [(1, 3)]) == "a d e"
    assert substring.without("a b c", [(0, 2), (1, 3)]) == ""
    assert substring.without("a b c", []) == "a b c"


def test_passages_leave_no_shuffle_files(spark):
    import glob
    import time

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for d in manager.localDirsString() for f in glob.glob(f"{d}/*/shuffle_*")}
    rng = random.Random(41)
    passage = prose(rng, 80)
    before = files()
    substring.passages(spark.createDataFrame([(1, passage), (2, prose(rng, 30) + " " + passage)], "doc_id long, text string"))
    for _ in range(50):  # files go a moment after their query
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before


def test_fuzzy_passages_with_every_sixth_word_changed(spark):
    rng = random.Random(42)
    rows = []
    for k in range(40):
        passage = prose(rng, 60).split()
        changed = ["x%d" % rng.randrange(10**6) if i % 6 == 5 else w for i, w in enumerate(passage)]
        rows += [(2 * k, prose(rng, 40) + " " + " ".join(passage)), (2 * k + 1, " ".join(changed) + " " + prose(rng, 40))]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["id"], r["ref_id"]) for r in got} == {(2 * k + 1, 2 * k) for k in range(40)}


def test_a_stretch_that_repeats_has_few_rows_and_all_of_its_words(spark):
    rng = random.Random(43)
    rows, want = [], {}
    for k, (words, first, later) in enumerate([(2, 600, 500), (2, 120, 600), (9, 270, 450), (60, 60, 600)]):
        line = ["v%d_%d" % (k, j) for j in range(words)]
        rows.append((100 * k, " ".join([prose(rng, 30), *(line * (first // words)), prose(rng, 30)])))
        for j in range(1, 6):
            rows.append((100 * k + j, " ".join([prose(rng, 10 * j), *(line * (later // words)), prose(rng, 20)])))
            want[100 * k + j] = (10 * j, 10 * j + later // words * words, 1 if first > later else 2 + later // (min(first, 128) - 49))
    texts = {k: t.split() for k, t in rows}
    got = {}
    for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["id"], []).append(r)
        assert r["ref_id"] < r["id"] and r["equal"] >= 0.75 * max(r["end"] - r["start"], r["ref_end"] - r["ref_start"])
        assert r["end"] <= len(texts[r["id"]]) and r["ref_end"] <= len(texts[r["ref_id"]])
    for i, (start, end, most) in want.items():
        assert set(range(start, end)) <= {p for r in got[i] for p in range(r["start"], r["end"])}, i
        assert len(got[i]) <= most, (i, len(got[i]))


def test_fewest_spans_hold_every_window_of_all():
    rng = random.Random(44)
    for _ in range(200):
        spans = [(s, s + rng.randrange(50, 90)) for s in (rng.randrange(0, 400) for _ in range(rng.randrange(0, 40)))]
        windows = lambda rows: {w for s, e in rows for w in range(s, e - 49)}
        few = substring.fewest(spans)
        assert set(few) <= set(spans) and windows(few) == windows(spans)
        assert all(windows([s for s in few if s != x]) != windows(spans) for x in few)
