from pyspark.sql import functions as F

from heddle.functions import candidates
from heddle.operators import imports, metrics, reports


def test_ranks_come_from_counts(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 1, 3)] + [("b", 7), ("b", None), ("c", None)], "k string, v int")
    assert {r["k"]: r["v"] for r in metrics.upper_median(df, ["k"], "v").collect()} == {"a": 3, "b": 7}
    assert {r["k"]: r["v"] for r in metrics.nearest_rank(df, ["k"], "v", 1.0).collect()} == {"a": 5, "b": 7}
    assert [r["v"] for r in metrics.upper_median(df, [], "v").collect()] == [3]


def test_doubted_statements(spark):
    rows = [
        ("能说出水的沸点是100度", "水在100度沸腾", 2, "queue"),
        ("能说出学习方式和习惯是养成学习方式和习惯", "x", 0, "drop: circular"),
        ("能说出蜗牛的家应该是什么样的", "x", 0, "drop: no standard answer"),
        ("能说出水的沸点是100度", "讨论水的沸点", 0, "drop: no standard answer"),
        ("能说出在线课堂是进行线上学习的平台", None, 0, "drop: use made a definition"),
        ("能说出待人的意义是懂得谦让", "理解待人的意义，懂得谦让", 0, "drop: invented relation"),
        ("能说出水的沸点是100度", "水在100度沸腾", None, "downgrade"),
    ]
    df = spark.createDataFrame(rows, "s string, src string, n int, want string")
    got = df.select("want", candidates.suspect_outcome(F.col("s"), F.col("src"), F.col("n")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_audit_of_content(spark):
    rows = [
        ("能说出略读的目的是粗知大意", "学习略读，粗知大意", 3, 4, ("invented", None, None)),
        ("能说出略读的目的是粗知大意", "略读的目的", 3, 4, None),
        ("能说出阅读总量不少于100万字", "x", 3, 4, ("measure", None, None)),
        ("能说出1~2年级开设的课", "x", 3, 4, ("course plan", None, None)),
        ("能说出1~2年级的儿歌", "x", 3, 4, ("stage", 1, 2)),
        ("能说出第四学段的诗", "x", 3, 4, ("stage", 7, 9)),
        ("能说出第四学段的诗", "x", 7, 9, None),
        ("能说出第四学段的诗", "x", None, None, None),
        ("能说出儿歌", None, 3, 4, None),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "s string, src string, lo int, hi int")
    got = [r[0] for r in df.select(candidates.content_audit(*[F.col(c) for c in df.columns])).collect()]
    assert [None if g is None else tuple(g) for g in got] == [r[4] for r in rows]


def test_pool_places_and_fragments(spark):
    df = spark.createDataFrame([([("rule", "候选池 9 选 9"), ("llm", "候选池 23 选 6")],), ([("llm", None)],), ([],), (None,)], "e array<struct<kind string, detail string>>")
    assert [None if r[0] is None else tuple(r[0]) for r in df.select(reports.pool_place(F.col("e"))).collect()] == [(20, 5), None, None, None]
    texts = spark.createDataFrame([("a", "，形成敏感性"), ("a", "能说出细胞的构成"), ("b", "能画图2. 能说出细胞3."), ("b", "普通高中的课"), ("c", None)], "k string, text string")
    assert {r["k"]: (r["n"], r["n_flagged"], r["percent"]) for r in reports.fragment_rates(texts, "k").collect()} == {"a": (2, 1, 50.0), "b": (2, 2, 100.0), "c": (1, 0, 0.0)}


def test_holes_of_codes(spark):
    df = spark.createDataFrame([("s", c) for c in ("1.1.2", "1.1.5", "1.1.5", "1.2", "3", None)] + [("t", "1.1.1")], "k string, code string")
    assert sorted((r["k"], r["from"], r["to"]) for r in reports.code_holes(df, ["k"], "code").collect()) == [("s", 1, 1), ("s", 3, 4)]


def test_state_and_tasks(spark):
    schema = "status string, deprecated boolean, lo int, hi int, tagged boolean, targeted boolean, evidenceSource string"
    s = reports.state(spark.createDataFrame([("expert-confirmed", False, 1, 9, True, None, "curriculum-content"), ("disputed", None, 3, 4, None, True, None), ("auto-confirmed", True, 3, 12, True, True, None)], schema))
    r = s.first()
    assert (r["n_all"], r["n_live"], r["n_usable"], r["n_human"], r["n_pending"], r["n_narrow"], r["last_grade"], r["n_tagged"], r["n_targeted"], r["default_share"]) == (3, 2, 1, 1, 1, 0, 9, 1, 1, 1.0)
    empty = reports.state(spark.createDataFrame([], schema)).first()
    assert (empty["n_all"], empty["last_grade"], empty["default_share"]) == (0, 9, 1.0)
    tasks = reports.open_tasks(s, {"tagged": (F.col("n_tagged") > 0, F.col("n_tagged")), "all": (F.col("n_tagged") > F.lit(None), F.col("n_all"))})
    assert {t["task"]: (t["done"], t["got"]) for t in tasks.collect()} == {"tagged": (True, "1"), "all": (False, "3")}


def test_edge_labels(spark):
    e = spark.createDataFrame([("component", "hard", None, None, "skips a step"), ("component", "soft", False, "rule", "skips a step"), ("convention", "soft", None, None, "order"), (None, "soft", None, None, "")], "type string, strength string, inInferenceGraph boolean, strengthCappedBy string, failureSignature string")
    got = {r["type"]: tuple(r)[1:] for r in reports.edge_labels(e).collect()}
    assert got == {"component": (2, 1, 1, 1, 2, 1, 0.5), "convention": (1, 0, 0, 0, 1, 1, 0.25), None: (1, 1, 0, 0, 0, 0, 0.25)}
    assert reports.signature_length(e).first()["length"] == 12


def test_titles_that_two_works_have(spark):
    df = spark.createDataFrame([("凉州词", "黄河远上白云间一片", "王之涣"), ("凉州词", None, "王翰"), ("春晓", "春眠不觉晓", "孟浩然")], "key string, firstLine string, author string")
    assert sorted(r["shown"] for r in imports.shown_titles(df).collect()) == sorted(["凉州词（黄河远上白云间）", "凉州词·王翰", "春晓"])
    pages = spark.createDataFrame([("l", "p2"), ("l", "p4"), ("m", None)], "list string, page string")
    assert {r["list"]: (r["n"], r["page_range"]) for r in imports.list_container(pages, ["list"], "page").collect()} == {"l": (2, "p2–p4"), "m": (1, "")}
