import glob
import itertools
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from heddle import schema
from heddle.functions import classify, gate, text
from heddle.operators import dedup, graph, metrics, profile, rules, sequences
from heddle.plans import registry
from heddle.sources import jsonl, tables
from heddle.streaming import gate_stream

REJECT = [
    "分数的意义", "培养学生的观察能力", "了解古代中国的政治制度", "认识钟表", "感受诗歌的意境美", "掌握两位数加法", "形成初步的数感和符号意识", "感悟数学与现实世界的关联", "万以内数的认识", "能说出、写出、读出、认读常用汉字并组词造句",
    "知道中国境内原始社会时期的人类活动", "了解私有制、阶级和早期国家的产生", "知道保护环境的重要性", "了解中华优秀传统文化的意义", None, "  ",
]
ACCEPT = [
    "能把 3/4 标在 0 到 1 的数轴上并说明理由", "能默写《静夜思》全诗且无错别字", "能举例说明「举头」与「低头」的动作对比表达了什么情绪", "能比较两个同分母分数的大小并说明依据", "能计算两位数加两位数的进位加法", "能认、读、写万以内的数",
    "能熟练口算20以内数的加减法和表内乘除法", "能计算两位数和三位数的加减法", "能说出不同数位上的数表示的数值", "能描述四则运算的含义", "能根据具体问题中的数量关系列出方程", "能连接简单的串联电路和并联电路", "能参照范例仿写简单句",
    "能与同伴相互保护和帮助", "知道甲骨文是已知最早的汉字", "知道考古发现是了解原始社会的重要依据",
]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_gate_fixtures(spark):
    for v, r in zip(REJECT, column(spark, REJECT, gate.decidable), strict=True):
        assert not r["ok"] and r["reasons"], v
    for v, r in zip(ACCEPT, column(spark, ACCEPT, gate.decidable), strict=True):
        assert r["ok"] and r["verb"], (v, r)


@pytest.mark.parametrize(
    ("statement", "reason"),
    [("能计算", "too-short"), ("能计算" + "数" * 60, "too-long"), ("能从人类文明发展和世界文化交流的角度", "fragment:的角度"), ("能直观描述这些平面图形的特征", "dangling-pointer:这些"), ("能说出它是史料中最重要的部分", "dangling-pronoun:它"), ("能在解决问题的过程中，体会解决问题的道理", "weak-predicate:体会"), ("懂得比赛中的互相保护与行为礼仪", "weak-lead:懂得"), ("能把书写的内容都计算。", "no-object")],
)
def test_each_gate_rule_fires(spark, statement, reason):
    assert reason in column(spark, [statement], gate.decidable)[0]["reasons"]


def test_exceptions_do_not_fire(spark):
    for s in ("能比较这两个数和其他数的大小并说明", "能说出这三个图形中最大的一个", "能说出「比例尺」和它的两种写法", "能从统计图表达的意义出发判断大小"):
        assert not [x for x in column(spark, [s], gate.decidable)[0]["reasons"] if x.startswith("dangling") or x == "no-observable-verb"], s


def test_normal_form(spark):
    raw = ["能 说出, 分数(例6)的 意义.", "3,000:1", "a  b", "ＡＢＣ１２３", "甲…….4.", "colour (AmE color)", None, "（Ａ…：，）甲", "能说出（例6)", "甲 乙‍丙﻿"]
    got = column(spark, raw, text.normalized)
    assert got[0] == "能说出， 分数（例6）的意义" and got[1] == "3,000:1" and got[2] == "a b" and got[3] == "ABC123" and got[5] == "colour (AmE color)" and got[6] is None and got[8] == "能说出（例6）" and got[9] == "甲乙丙"
    assert column(spark, got, text.normalized) == got and all(column(spark, got, text.is_stable))


def test_signature_keeps_what_tells_apart(spark):
    rows = [("数学", "计算", "能计算圆锥的体积"), ("数学", "计算", "会计算圆锥的体积。"), ("物理", "描述", "会用线速度描述匀速圆周运动"), ("物理", "描述", "会用周期描述匀速圆周运动"), ("数学", "说出...解释", "能说出并解释说出")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, v string, s string")
    s = [r["x"] for r in df.select("i", text.signature(F.col("d"), F.col("v"), F.col("s")).alias("x")).orderBy("i").collect()]
    assert s[0] == s[1] == "数学|计算|圆锥的体积" and s[2] != s[3] and s[4].endswith("|并说出")


def test_small_text_functions(spark):
    assert column(spark, ["G6", "g10", "6", " 12 ", "13", None, "x"], text.grade_number) == [6, 10, 6, 12, None, None, None]
    assert column(spark, ["甲。乙！丙"], text.sentences) == [["甲。", "乙！", "丙"]]
    assert column(spark, ["第二学段", "3~4年级", "2~4年级", "其他", "G1-2", "G3-5", "8 ~ 9", " G7～G9 "], text.stage_band) == [(3, 4), (3, 4), None, None, (1, 2), (3, 4), (7, 9), (7, 9)]
    assert column(spark, ["abcdef", "abc", None], lambda c: text.cut(c, 4)) == ["abc…", "abc", None]
    assert column(spark, ["<a & 'b'>"], text.escape_html) == ["&lt;a &amp; &#39;b&#39;&gt;"]
    assert column(spark, ["能，说出这个的分数"], text.content_characters) == [["说", "出", "分", "数"]]
    assert column(spark, ["ＡＢ１．　", "，：（\ue001）"], text.half_width) == ["AB1. ", "，：（）"]
    assert column(spark, ["Colour (AmE color)", "colour(AmE  color) *", "a / b"], text.vote_key) == ["colour(ame color)", "colour(ame color)", "a/b"]
    assert column(spark, [" 甲, 乙(丙); ", "甲。；"], text.comparison_key) == ["甲，乙（丙）", "甲"]
    assert column(spark, ["１２\n普通高中数学课程标准（2 0 1 7年版）能画图\n 7 \n"], text.page_lines) == [["能画图"]]
    assert column(spark, ["选择性必修理解性技能1. 区分观点", "必修：听 3、复述", "区分"], text.labels_stripped) == ["区分观点", "复述", "区分"]
    assert column(spark, ["（家国情怀）认识长城", "（例6）画图"], lambda c: text.leading_tags(c, ("家国情怀", "史料实证"))) == [("认识长城", ["家国情怀"]), ("（例6）画图", [])]
    assert column(spark, ["能说出的意义", "能说出", "知道"], lambda c: text.object_after(c, F.lit("说出"))) == ["意义", "能说出", "知道"]
    assert column(spark, ["会计算", "学会计算", "能算"], text.with_can) == ["会计算", "能学会计算", "能算"]
    assert column(spark, ["能计算", "赛的规则"], text.opens_well) == [True, False]
    assert column(spark, ["（1）能描述水的三态，能解释蒸发现象；【学业要求】7列举$y=5x$的图象，形成初步的符号意识。"], text.requirements) == [["能描述水的三态", "能解释蒸发现象", "列举y=5x的图象"]]
    df = spark.createDataFrame([(3, 3), (1, 9), (3, 4), (10, 11), (None, 2)], "lo int, hi int")
    assert [r[0] for r in df.select(text.stage_words(F.col("lo"), F.col("hi"))).collect()] == ["三年级", "全学段", "三到四年级", "高一–高二年级", "学段未定"]
    assert column(spark, ["F001 x", "see W102", "none"], text.error_code) == ["F001", "W102", ""]
    assert column(spark, ['{"a": "x", "b": "y"}', '{"a": "x", "b": ', "no"], lambda c: text.salvaged(c, "a string, b string", ["a", "b"])) == [("x", "y"), ("x", None), (None, None)]
    number = column(spark, ["s"], lambda c: text.document_number(c, F.lit("t"), F.lit(None).cast("string"), F.lit("2026-03-09")))[0]
    assert number == "DZ-260309-" + hashlib.blake2s(b"s|t|", digest_size=3).hexdigest()[:5].upper()
    df = spark.createDataFrame([("abcd", "bcde"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(text.sequence_ratio("a", "b")).collect()] == [0.75, 1.0]


def test_tolerant_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"id":"ca_abcdefgh","n":1}\n\n// note\n{bad\n{"id":"ca_ABCDEFGH","n":2}\n', encoding="utf-8")
    rows = jsonl.parsed(jsonl.raw_lines(spark, str(tmp_path)), "id string, n int")
    good = jsonl.read_jsonl(spark, str(tmp_path), "id string, n int").collect()
    assert [(r["id"], r["n"], r["_line"]) for r in sorted(good, key=lambda r: r["_line"])] == [("ca_abcdefgh", 1, 1), ("ca_ABCDEFGH", 2, 5)]
    assert [r["error"].rsplit(":", 2)[1] for r in rows.filter("error is not null").collect()] == ["4"]
    assert jsonl.raw_lines(spark, str(tmp_path / "none")).count() == 0
    assert {r["id"] for r in jsonl.used_ids(jsonl.raw_lines(spark, str(tmp_path))).collect()} == {"ca_abcdefgh", "ca_ABCDEFGH"}
    with pytest.raises(Exception, match="not JSON"):
        jsonl.read_jsonl(spark, str(tmp_path), "id string, n int", strict=True).collect()


def test_array_or_lines_and_dialects(spark, tmp_path):
    (tmp_path / "a.json").write_text(' [{"title":"x"},{"title":"y"}]', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"title":"z"}\n// c\n', encoding="utf-8")
    assert sorted(r["title"] for r in jsonl.read_array_or_lines(spark, str(tmp_path), "title string").collect()) == ["x", "y", "z"]
    doc = {"schema": "v1", "reviewer": "Li", "reviewedAt": "2026-01-01", "rows": [{"anchorId": "a", "verdict": "ok", "note": "", "discipline": "d"}]}
    (tmp_path / "r1.json").write_text(json.dumps(doc))
    (tmp_path / "r2.json").write_text(json.dumps({"anchorId": "b", "issue": "stage", "reviewer": "Wu"}) + "\n")
    got = {(r["anchorId"], r["verdict"], r["reviewer"], r["kind"]) for p in ("r1", "r2") for r in jsonl.read_reviews(spark, str(tmp_path / f"{p}.json")).collect()}
    assert got == {("a", "ok", "Li", "anchor"), ("b", "stage", "Wu", "anchor")}
    (tmp_path / "w.jsonl").write_text('{"student_ref":"s","stage":"G10"}\n{"anchor_id":"a","status":"touched"}\n{"anchor_id":"b","status":"evidenced"}\n')
    work = jsonl.read_work(spark, str(tmp_path / "w.jsonl")).collect()
    assert len(work) == 1 and [i["anchor_id"] for i in work[0]["items"]] == ["a", "b"]


def test_files_and_tombstones(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, d string")
    v = tables.rewrite(df, str(tmp_path / "t"), ["d"])
    assert spark.read.parquet(v).count() == 2
    left = tables.with_tombstones(df, F.col("id") == 2, F.lit("why"), str(tmp_path / "gone"))
    assert left.count() == 1 and spark.read.parquet(str(tmp_path / "gone")).first()["retired_reason"] == "why"
    tables.sorted_jsonl(df, str(tmp_path / "j"), "id")
    assert {len(r["sha256"]) for r in tables.manifest(spark, str(tmp_path / "j"), "*.json").collect()} == {64}


def dag(rng, n, m):
    return sorted({(b, a) for a, b in (sorted(rng.sample(range(n), 2)) for _ in range(m))})


def reach(edges):
    out = {}
    for a, p in edges:
        out.setdefault(a, set()).add(p)
    full = {a: set(ps) for a, ps in out.items()}
    for a in sorted(full):
        for p in sorted(out[a]):
            full[a] |= full.get(p, set())
    return {(a, p) for a, ps in full.items() for p in ps}


def test_graph_against_brute_force(spark):
    e = dag(random.Random(3), 25, 60)
    df = spark.createDataFrame(e, "a long, p long")
    assert {(r["a"], r["p"]) for r in graph.closure(df).collect()} == reach(e)
    red = {(r["a"], r["p"]) for r in graph.redundancy(df).filter("alt_hops is not null").collect()}
    assert red == {x for x in e if x in reach([y for y in e if y != x])}
    assert reach([x for x in e if x not in red]) == reach(e)
    assert graph.cycle_core(df).isEmpty()
    paths = {(r["a"], r["p"]): r["path"] for r in graph.alternative_paths(df, spark.createDataFrame(sorted(red), "a long, p long")).collect()}
    assert set(paths) == red and all((x, y) in set(e) for p in paths.values() for x, y in itertools.pairwise(p)) and all(len(p) > 2 for p in paths.values())


def test_three_nodes(spark):
    df = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "C")], "a string, p string")
    assert [(r["a"], r["p"], r["alt_hops"]) for r in graph.redundancy(df).filter("alt_hops is not null").collect()] == [("A", "C", 2)]


def test_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (3, 5), (6, 6), (7, 8), (8, 7)], "a long, p long")
    assert {r["id"]: r["component"] for r in graph.strong_components(df).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    with pytest.raises(ValueError, match="acyclic"):
        graph.redundancy(df)
    assert {(r["a"], r["p"], r["fault"]) for r in graph.edge_faults(df).collect()} == {(6, 6, "self-loop"), (7, 8, "two-cycle"), (8, 7, "two-cycle")}
    kept = graph.greedy_acyclic(df.withColumn("g", F.lit("x")).withColumn("o", F.monotonically_increasing_id()), "g", ["o"]).filter("kept").select("a", "p")
    assert kept.count() == 5 and graph.cycle_core(kept).isEmpty()


def test_inference_graph_keeps_unknown_types(spark):
    df = spark.createDataFrame([(1, 2, None, None), (1, 3, "convention", None), (1, 4, "component", False), (1, 5, "semantic", True)], "a long, p long, type string, inInferenceGraph boolean")
    assert sorted(r["p"] for r in graph.inference_edges(df).collect()) == [2, 5]


WORK = [("ca_dbH3sgz6", "ca_zZdYc8ZT", "component", "hard"), ("ca_dbH3sgz6", "ca_VJFBAS6E", "semantic", "hard"), ("ca_dbH3sgz6", "ca_CPcH7FwR", "component", "hard"), ("ca_umpGy8fU", "ca_NX27FyuA", "instrument", "hard"), ("ca_xDVQGxh2", "ca_8hPuC52W", "component", "soft")]


@pytest.mark.parametrize(("third", "expected"), [(True, {"ca_dbH3sgz6"}), (False, set())])
def test_golden_pair(spark, third, expected):
    edges = spark.createDataFrame(WORK, "a string, p string, type string, strength string")
    ids = sorted({x for e in WORK for x in e[:2]})
    anchors = spark.createDataFrame([(i, False, 10, 12, "必修") for i in ids], "id string, deprecated boolean, stage_min int, stage_max int, course string").withColumn("course", F.when(classify.course_required(F.col("course")), "required"))
    seen = [(x,) for x in ("ca_zZdYc8ZT", "ca_VJFBAS6E", "ca_CPcH7FwR", "ca_NX27FyuA", "ca_8hPuC52W")]
    touched = spark.createDataFrame(seen, "id string")
    evidenced = touched if third else touched.filter("id <> 'ca_CPcH7FwR'")
    assert {r["id"] for r in profile.avoided(anchors, edges, touched, evidenced, grade=10).collect()} == expected


CLEAN = {
    "id": "ca_abcdefgh", "discipline": "数学", "track": "DAG", "topic": None, "dimension": None, "type": "PROCEDURAL", "literacy": ["运算能力"], "cognitive": "掌握", "stageHint": ("G3", "G3"), "courseType": None, "evidence": ["写出三道题"],
    "assessment": None, "evidenceSource": "standard", "reviewStatus": "llm-proposed", "deprecated": False, "supersededBy": None, "dropReason": None,
}
KINDS = "id string, discipline string, track string, topic string, dimension string, type string, literacy array<string>, cognitive string, stageHint struct<min:string,max:string>, courseType string, evidence array<string>, assessment string, evidenceSource string, reviewStatus string, deprecated boolean, supersededBy string, dropReason string"


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({}, None), ({"id": "ca_short"}, "A001"), ({"discipline": "魔法"}, "A010"), ({"track": "TREE"}, "A011"), ({"type": "X"}, "A012"), ({"cognitive": None}, "A013"), ({"reviewStatus": "ok"}, "A014"), ({"evidence": []}, "A020"),
        ({"evidence": ["能完成：减法"]}, "A021"), ({"evidenceSource": "fallback"}, "A022"), ({"assessment": "做题"}, "A030"), ({"literacy": ["a", "b", "c"]}, "A040"), ({"stageHint": ("G13", "G3")}, "A050"), ({"stageHint": ("G5", "G3")}, "A051"),
        ({"courseType": "必修"}, "A052"), ({"deprecated": True}, "A060"), ({"supersededBy": "ca_x"}, "A061"), ({"track": "MATRIX"}, "A070"),
    ],
)
def test_one_dirty_row_per_rule(spark, change, code):
    row = CLEAN | change
    df = spark.createDataFrame([tuple(row[k.split()[0]] for k in KINDS.split(", "))], KINDS)
    found = {r["code"] for r in rules.violations(df, rules.anchor_rules(), "id").collect()}
    assert (code in found) if code else not found


def test_edge_rules(spark):
    anchors = spark.createDataFrame([("a", "DAG", 5, 6), ("b", "DAG", 1, 2), ("l", "LIST", 1, 2), ("m", "MATRIX", 1, 2), ("n", "MATRIX", 1, 2)], "id string, track string, stage_min int, stage_max int")
    kinds = "anchorId string, prerequisiteId string, type string, strength string, failureSignature string, inInferenceGraph boolean, reason string, evidence array<struct<kind:string,detail:string>>, containment struct<list:string,subset:string>"
    good = ["a", "b", "component", "soft", "把进位的一漏加到十位上，得数少十", True, "要先会不进位加法", [("standard", "x")], None]

    def codes(policy=None, **change):
        row = [change.get(k.split()[0], v) for k, v in zip(kinds.replace("struct<kind:string,detail:string>", "S").replace("struct<list:string,subset:string>", "S").split(", "), good, strict=True)]
        return {(r["code"], r["severity"]) for r in rules.edge_violations(spark.createDataFrame([tuple(row)], kinds), anchors, policy).collect()}

    assert codes() == set()
    assert ("E001", "error") in codes(anchorId="zz") and ("E003", "error") in codes(prerequisiteId="a") and ("E022", "error") in codes(anchorId="b", prerequisiteId="a")
    assert ("F005", "error") in codes(failureSignature="这个学生基础不牢所以做不出来") and ("F004", "error") in codes(failureSignature="短")
    assert ("F001", "warning") in codes(rules.Policy({"edgeTyping"}), type=None)
    assert ("E020", "error") in codes(strength="hard", failureSignature="", evidence=[("llm", "x")]) and ("E020", "error") not in codes(strength="hard", evidence=[("llm", "x")])
    assert ("E021", "error") in codes(anchorId="l") and ("E021", "error") in codes(anchorId="m", strength="hard") and ("E021", "error") not in codes(anchorId="m", prerequisiteId="n", strength="hard")


def test_reviews_need_a_signature(spark):
    anchors = spark.createDataFrame([("a", "ai-reviewed", ["ai:x"]), ("b", "ai-reviewed", None), ("c", "disputed", []), ("d", "llm-proposed", [])], "id string, reviewStatus string, reviewedBy array<string>")
    reviews = spark.createDataFrame([("a", "ok", "", "Li", 1), ("b", "ok", "", "", 1), ("c", "ok", "", "Li", 1), ("d", "ok", "", "Li", 1), ("d", "stage", "", "Li", 2), ("z", "ok", "", "Li", 1)], "anchorId string, verdict string, note string, reviewer string, seq int")
    got = {r["id"]: r["new_status"] for r in classify.apply_reviews(anchors, reviews).collect()}
    assert got == {"a": "expert-confirmed", "b": "ai-reviewed", "c": "disputed", "d": "disputed"}
    unsigned = spark.createDataFrame([("a", "wrong", "", "", 1), ("b", "成立", "", "Li", 1), ("d", None, "", " ", 1)], "anchorId string, verdict string, note string, reviewer string, seq int")
    rows = {r["id"]: r for r in classify.apply_reviews(anchors, unsigned).collect()}
    assert {i: rows[i]["new_status"] for i in "abd"} == {"a": "disputed", "b": "expert-confirmed", "d": "disputed"}
    assert rows["a"]["reviewedBy"] == ["ai:x", "teacher:anonymous"] and rows["a"]["issue"] == "wrong" and rows["d"]["issue"] == "other"
    assert {r["id"]: r["new_status"] for r in classify.apply_reviews(anchors, reviews, overturn_disputed=True).collect()}["c"] == "expert-confirmed"
    assert [r["id"] for r in classify.missing_keys(reviews, anchors).collect()] == ["z"]


def test_sequences(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 2, 5)] + [("b", n) for n in (1, 2)], "k string, n int")
    assert [(r["k"], r["n_missing"], r["n_duplicated"]) for r in sequences.sequence_gaps(df, "k", "n").collect()] == [("a", 2, 1)]
    assert {(r["run_start"], r["run_end"], r["n"]) for r in sequences.islands(df.filter("k = 'a'"), "k", "n").collect()} == {(1, 2, 2), (5, 5, 1)}
    v = spark.createDataFrame([("k", "x", 2), ("k", "y", 1), ("k", "x", 3), ("k", "y", 4)], "k string, v string, o int")
    assert sequences.mode_with_votes(v, "k", "v", "o").first()["v"] == "y"
    marks = spark.createDataFrame([("a", "ok", 1), ("a", "ok", 2), ("b", "ok", 1), ("b", "bad", 2)], "k string, m string, o int")
    assert {(r["k"], r["m"]) for r in profile.toggled(marks, ["k"], "m", "o").collect()} == {("b", "bad")}
    pages = spark.createDataFrame([("d", 1, ["s1", "s1", None]), ("d", 2, [None, None, "s2"]), ("d", 3, ["s2", "s3", "s3"])], "d string, p int, v array<string>")
    got = sequences.carried_vote(pages, "d string, p int, v array<string>, start_section string", "d", "p", "v", "s0").orderBy("p").collect()
    assert [r["start_section"] for r in got] == ["s0", "s1", "s1"]


def test_near_pairs_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), rng.sample("abcdefghij", rng.randint(1, 6))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, discipline string, tokens array<string>")
    first = {}
    for i, g, t in rows:
        first.setdefault((g, frozenset(t)), i)
    want = {(min(a, b), max(a, b)) for (ka, a), (kb, b) in itertools.combinations(first.items(), 2) if ka[0] == kb[0] and 100 * len(ka[1] & kb[1]) >= 60 * len(ka[1] | kb[1])}
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in dedup.near_pairs(df, 60).collect()} == want


def test_null_model_and_detour(spark):
    e = spark.createDataFrame([(3, 2), (3, 1), (2, 1)], "a long, p long")
    got = metrics.null_model(e, e, trials=3).collect()
    assert {(r["redundant"], r["n"]) for r in got} == {(1, 3)}
    d = graph.group_detour(e.withColumn("t", F.when(F.col("p") == 1, "g")), F.col("t") == "g").collect()
    assert all(r["detour"] is None for r in d)


def test_closed_sets_have_no_drift():
    assert rules.set_drift(list(schema.REVIEW), list(metrics.CITABLE))[1] == []


def test_stream_has_the_same_gate(spark, tmp_path):
    spark.createDataFrame([("能计算两位数加两位数的进位加法",), ("认识钟表",)], "statement string").write.json(str(tmp_path / "in"))
    s = gate_stream.gated(spark.readStream.schema("statement string").json(str(tmp_path / "in")))
    q = gate_stream.append_versions(s, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["ok"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [False, True]


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", ["leverage_queue", "avoided", "transitive_redundancy", "sequence_gaps", "contaminated_sources", "fallback_chain", "near_duplicate_statements", "violation_summary"])
def test_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.QUERIES[name](spark, DATA)
    r = c.sql(registry.ORACLE[name])
    at = [list(r.columns).index(k) for k in df.columns]
    assert sorted(map(str, (tuple(x) for x in df.collect()))) == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())


def test_classifiers_in_their_order(spark):
    rows = [("教师引导学生观察", "观察", "植物生长", 1, 2), ("植物的生长过程", "", "", 1, 2), ("能观察植物，能记录变化", "观察", "植物生长", 1, 2), ("能观察植物", "观察", "植物生长", 1, 9), ("能观察植物", "观察", "植物生长", None, None), ("能观察植物", "观察", "植物生长", 1, 2), ("能观察植物", "观察", "植物", 1, 2)]
    df = spark.createDataFrame(rows, "s string, v string, o string, lo int, hi int")
    assert [r[0] for r in df.select(classify.triage(*[F.col(c) for c in df.columns])).collect()] == ["JUNK", "JUNK", "SPLIT", "NO_STAGE", "NO_STAGE", "READY", "JUDGE"]
    rows = [("convention", 3, "diff", 5, "diff"), ("semantic", 2, "diff", 5, "diff"), ("semantic", None, "diff", 5, "diff"), ("semantic", 1, "unk", 3, "diff"), ("semantic", 0, "same", 2, "diff"), ("semantic", 0, "same", 2, "same"), (None, 0, "unk", 2, "unk")]
    df = spark.createDataFrame(rows, "t string, g int, s string, h int, p string")
    assert [r[0] for r in df.select(classify.redundancy_group(*[F.col(c) for c in df.columns])).collect()] == [f"R{k}" for k in range(7)]
    df = spark.createDataFrame([(7, 5, 3, 9), (1, 12, 3, 8), (None, None, 3, 9), (4, 5, 1, 9)], "lo int, hi int, a int, b int")
    assert [tuple(r[0]) for r in df.select(classify.clamp_stage(*[F.col(c) for c in df.columns])).collect()] == [(3, 3), (3, 8), (3, 9), (4, 5)]
    long = "不会把分数化成小数再比较大小"
    df = spark.createDataFrame([("semantic", "firm", long), ("instrument", "hard", long), ("convention", "hard", "x"), ("semantic", "hard", "短"), ("semantic", "hard", long), ("other", "hard", long), ("semantic", "hard", "孩子的基础不牢所以后面都学不会了")], "t string, s string, g string")
    got = [r[0] and (r[0]["strength"], r[0]["signature"]) for r in df.select(classify.accepted_label(*[F.col(c) for c in df.columns])).collect()]
    assert got == [("soft", long), ("soft", long), ("soft", "无可观测影响"), None, ("hard", long), None, None]
    df = spark.createDataFrame([("", "甲乙"), ("甲丙丁戊", "甲乙"), ("甲乙", "甲乙丙")], "o string, s string")
    assert [r[0] for r in df.select(classify.drifted(F.col("o"), F.col("s"))).collect()] == [False, True, False]
    df = spark.createDataFrame([("能说出甲", "说出甲能", 0, True), ("甲乙丙丁", "甲", 0, True), ("甲乙丙丁", "甲", 2, True), ("甲乙丙丁", "甲", 2, False)], "a string, b string, n int, s boolean")
    assert [r[0] for r in df.select(classify.independent_verdict(*[F.col(c) for c in df.columns])).collect()] == ["grounded-verbatim", "not-applicable", "suspect", "passed"]
    df = spark.createDataFrame([("必修",), ("选修",), (None,), ("",)], "c string")
    answers = lambda **k: [r[0] for r in df.select(classify.course_required(F.col("c"), **k)).collect()]
    assert answers() == [True, False, False, False] and answers(policy="lenient", grade=9) == [True, False, True, True] and answers(policy="lenient", grade=10) == answers()
    assert column(spark, ["会画图、测量", "会测量并记录", "会测量并说明", "会测量", "会测量，说出结果"], classify.compound_signal) == [True, False, True, False, True]
