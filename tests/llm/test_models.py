import hashlib
import random

import pytest

from heddle.llm import html_tree, lz, toxicity, url_filters
from tests_llm_helpers import prose


def parse(text):
    known, out, i = set(), [0], 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        if j > len(text):
            break
        known.add(text[i:j])
        out.append(j)
        i = j
    return out


def test_parse_and_branch():
    rng = random.Random(4)
    for _ in range(400):
        t = "".join(rng.choices("ab c", k=rng.randint(0, 60)))
        p = lz.Parse()
        p.feed(t, len(t) // 2)
        p.feed(t, len(t))
        assert p.bounds == parse(t)


def test_edits_are_nearer_than_strangers(spark):
    rng = random.Random(6)
    rows = [(i * 3, prose(rng, 200, 10**6)) for i in range(40)] + [(500, None), (501, ""), (502, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lz.edited_likeness(df).orderBy("doc_id").collect()
    texts = [t or "" for _, t in rows]
    for k, r in enumerate(got):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        n = len(t)
        e = t[: n - n // 2] + nxt[: n // 2]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == lz.fingerprint(t) and r["edited_fingerprint"] == lz.fingerprint(e)
        assert r["near_next"] == lz.likeness(lz.fingerprint(t), lz.fingerprint(nxt))
    assert all(r["near_edited"] > r["near_next"] for r in got[:40])
    assert lz.likeness(lz.EMPTY, lz.EMPTY) == 1 and lz.likeness(lz.fingerprint("abc"), lz.EMPTY) == 0


def test_fingerprints_odd_and_empty(odd, none):
    got = lz.fingerprints(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[1] == by[2] and by[3] == by[4] == lz.EMPTY
    slim = lambda df: df.select("doc_id", "text")
    assert len(lz.edited_likeness(slim(odd)).collect()) == odd.count()
    assert lz.edited_likeness(slim(none)).collect() == []


@pytest.fixture(scope="module")
def model():
    return html_tree.trained()


def test_held_out_pages(model):
    wrong = total = 0
    for page, marks in html_tree.labelled_pages(150, seed=123):
        p = html_tree.Page(page)
        m = model.marginals(p)
        for i, t in p.runs:
            total += 1
            wrong += (m[i] > 0.5) != any(w in marks for w in t.split())
    assert wrong < 0.03 * total


def test_messages_equal_enumeration(model):
    page = html_tree.Page("<body><nav><a href=x>Home</a></nav><div><p>Some text that is long enough to be read.</p><p>More</p></div></body>")
    n, m = len(page.tag), model.marginals(page)
    import itertools
    import math

    own = []
    for f in page.features():
        x = sum(model.weight.get(k, 0.0) for k in f)
        own.append(1 / (1 + math.exp(-x)))
    total, hit = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        w = (1e-3 if y[0] else 1.0) * math.prod(own[i] if y[i] else 1 - own[i] for i in range(n))
        for i in range(1, n):
            w *= model.step.get(page.tag[i], model.step[""])[y[page.parent[i]]][y[i]]
        total += w
        for i in range(n):
            hit[i] += w * y[i]
    for i in range(1, n):
        assert abs(m[i] - hit[i] / total) < 1e-9


def test_repairs_and_references(model):
    source = '<html><head><title>t</title><script>var a="</p><p>no</p>";</script></head><body><nav><a href="/">Home</a></nav><article><h1>Caf&eacute; &amp; more</h1><p><b>First  line &#8212; of a text that goes on\n for a while.<br><p>Second one, also long enough to be content.</p><div class="ad">Buy now</div></article><footer>&copy; me</footer>'
    assert model.text(source) == "Café & more\nFirst line — of a text that goes on for a while.\nSecond one, also long enough to be content."
    assert model.text(None) == "" and model.text("") == "" and model.text("<p") == "" and model.text("<div><nav><a>x</a></nav></div>") == ""


def test_pages_table(spark, model):
    rows = [(1, None, None), (None, "u", ""), (3, "u", "<article><p>A text that is of some length, and ends here.</p></article>" * 1), (3, "u", "<p>x</p>"), (4, "u", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_tree.extracted(df, model).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_tree.extracted(df.limit(0), model).collect() == []


def toxic_rows(rng, n):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = prose(rng, 40, 300).split()
        if toxic:
            w[rng.randrange(40)] = rng.choice(["idiot", "scum!", "Losers"])
        if rng.random() < (0.6 if toxic else 0.1):  # a group is named more often in abuse
            w[rng.randrange(40)] = "muslim"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_texts_and_neutral_mentions(spark):
    rows, labels = toxic_rows(random.Random(9), 1200)
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fair, plain = toxicity.trained(docs, lab), toxicity.trained(docs, lab, fairness=0.0)
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, fair).collect()}
    held = {r["doc_id"] for r in docs.filter(toxicity.held_out("doc_id")).collect()}
    y = dict(labels)
    right = [(score[i] >= 0.7) == bool(y[i]) for i in held]
    assert len(held) > 300 and sum(right) > 0.95 * len(right)
    a, b = "the muslim family went home", "the christian family went home"
    gap = lambda m: abs(m.scorer()(a) - m.scorer()(b))
    assert gap(fair) < gap(plain) and fair.scorer()(a) < 0.5


def test_toxicity_odd_and_empty(spark, odd, none):
    lab = spark.createDataFrame([(1, 1), (2, None), (None, 1), (6, 0), (99, 0)], "doc_id long, toxic int")
    model = toxicity.trained(odd.select("doc_id", "text"), lab)
    got = toxicity.scored(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scored(none, model).collect() == []
    assert toxicity.trained(none.select("doc_id", "text"), lab.limit(0)).scorer()("x") == 0.0


def test_lists_as_of_the_fetch(spark):
    e = [
        ("l", "example.com", "spam", "block", "add", "2024-02-01", 0), ("l", "example.com", "spam", "block", "remove", "2024-03-01", 1), ("l", "a.example.com", "ok", "allow", "add", "2024-01-01", 2), ("l", "b.org/x", "bad", "block", "add", "2024-01-15", 3),
        ("l", "c.net", "bad", "block", "add", "2024-01-10", 4), ("l", "c.net", "bad", "block", "remove", "2024-01-10", 5), (None, None, None, None, "add", None, 6),
    ]
    entries = spark.createDataFrame(e, "list string, key string, category string, verdict string, action string, dated string, seq int").withColumn("dated", url_filters.F.to_date("dated"))
    c = [
        (1, "http://x.Example.com./p", "2024-01-31", True), (2, "http://u@x.example.com:80/p", "2024-02-01", False), (3, "http://x.example.com", "2024-03-01", True), (4, "https://a.example.com/y", "2024-02-10", True), (5, "https://b.org/x/y?z", "2024-02-10", False),
        (6, "https://b.org/xx", "2024-02-10", True), (7, "http://c.net", "2024-02-01", True), (8, None, "2024-02-01", True), (9, "not a url", None, True), (2, "http://u@x.example.com:80/p", "2024-02-01", False),
    ]
    caps = spark.createDataFrame([r[:3] for r in c], "page_id long, url string, fetched_on string").withColumn("fetched_on", url_filters.F.to_date("fetched_on"))
    got = sorted((r["page_id"], r["allowed"]) for r in url_filters.filtered(caps, entries).collect())
    assert got == sorted((r[0], r[3]) for r in c)
    limit = url_filters.store.BROADCAST_ROWS
    try:
        url_filters.store.BROADCAST_ROWS = -1
        assert sorted((r["page_id"], r["allowed"]) for r in url_filters.filtered(caps, entries).collect()) == got
    finally:
        url_filters.store.BROADCAST_ROWS = limit
    assert url_filters.filtered(caps.limit(0), entries).collect() == []
    assert all(r["allowed"] for r in url_filters.filtered(caps, entries.limit(0)).collect())
