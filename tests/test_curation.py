import pytest
from pyspark.sql import functions as F

from heddle.operators import curation


def test_ids_are_new_and_unlike(spark):
    df = spark.range(300).withColumnRenamed("id", "key")
    first = curation.minted(df, "key", spark.createDataFrame([], "id string"))
    used = first.limit(50).select("id")
    again = curation.minted(df, "key", used)
    ids = [r["id"] for r in again.collect()]
    assert len(set(ids)) == 300 and all(len(i) == 11 for i in ids)
    assert not set(ids) & {r["id"] for r in used.collect()}


def test_tags_keep_to_the_vocabulary(spark):
    df = spark.createDataFrame([(["a"], ["x", "b", "c", "b", "d"]), (["a"], ["x"]), (["a"], None)], "old array<string>, new array<string>")
    assert [r[0] for r in df.select(curation.accepted_tags(F.col("old"), F.col("new"), ("b", "c", "d"))).collect()] == [["b", "c"], ["a"], ["a"]]


def test_split_gate(spark):
    rows = [
        (1, "能说出加法和减法的意义", 1, "能说出加法的意义", True, "s1"), (1, "能说出加法和减法的意义", 2, "能说出减法的意义", True, "s2"), (2, "能写出汉字", 1, "能写出汉字", True, "s3"), (3, "能说出加法并计算", 1, "能说出加法", True, "s1"), (3, "能说出加法并计算", 2, "能计算乘法", True, "s5"),
        (4, "能画图并说明", 1, "能画图", True, "s6"), (4, "能画图并说明", 2, "它能说明", True, "s7"),
    ]
    df = spark.createDataFrame(rows, "parent int, parent_statement string, nth int, statement string, ok boolean, signature string")
    assert {r["parent"]: r["split"] for r in curation.split_gate(df).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_sources_and_examples(spark):
    a = spark.createDataFrame([("x", "能说出植物的生长", 1, "见例 3 和例12")], "id string, statement string, page int, text string")
    s = spark.createDataFrame([(1, "动物会跑。植物能生长。水会流。")], "page int, source string")
    r = curation.best_sentence(a, s, "page", least=4).first()
    assert r["sentence"] == "植物能生长。" and r["share"] > 0.5
    e = spark.createDataFrame([(3, "e3"), (12, "e12"), (13, "e13")], "number int, key string")
    assert sorted(x["example"] for x in curation.example_references(a, e).collect()) == ["e12", "e3"]


def test_disputes_and_stages(spark):
    rows = [(["undecidable"], False, 3, 4, 3, 4), (["stage"], False, 3, 4, 3, 4), (["stage"], True, 3, 4, 3, 4), (["stage"], True, 3, 3, 3, 4), (["stage"], True, 2, 3, 3, 4), (["stage", "truncated"], True, 3, 4, 3, 4), (["stage"], True, 3, 4, None, None), (["undecidable"], True, 3, 4, 3, 4)]
    df = spark.createDataFrame(rows, "i array<string>, ok boolean, lo int, hi int, slo int, shi int")
    got = [r[0] for r in df.select(curation.dispute_outcome(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["deprecate", "keep: gate", "release: stage was right", "release: stage restored", "keep: stage conflict", "keep: other issues", "keep: unresolved", "keep: unresolved"]
    own = [("d", 1, 1, 2), ("d", 2, 3, 5), ("d", 3, 6, 7), ("d", 4, 8, 9)]
    bands = spark.createDataFrame([*own, ("e", 2, 3, 5)], "discipline string, band int, lo int, hi int")
    rows = [("a", "d", 2, 1, 2, False), ("b", "e", 2, 3, 3, False), ("c", "e", 2, 4, 5, False), ("f", "e", None, 4, 5, False), ("g", "d", 2, 1, 2, True), ("h", "x", 4, 7, 9, False), ("i", "x", 4, None, None, False)]
    a = spark.createDataFrame(rows, "id string, discipline string, srcStage int, stage_min int, stage_max int, deprecated boolean")
    got = {r["id"]: (r["stage_min"], r["stage_max"], r["stage_conflict"]) for r in curation.restored_stage(a, bands).collect()}
    assert got == {"a": (3, 5, False), "b": (3, 4, False), "c": (4, 5, True), "f": (4, 5, False), "g": (1, 2, False), "h": (7, 9, False), "i": (None, None, True)}


def test_promotion_keeps_all_but_junk(spark):
    rows = [("JUNK", "x", ["long enough"]), ("JUDGE", "能画图", ["abc", None]), ("READY", "y", ["one!", "two!", "xx", "three", "four", "five!"])]
    got = {r["triageBucket"]: (r["evidence"], r["evidenceSource"]) for r in curation.promoted(spark.createDataFrame(rows, "bucket string, statement string, evidence array<string>")).collect()}
    assert got == {"JUDGE": (["能完成：能画图"], "fallback"), "READY": (["one!", "two!", "three", "four"], "llm-draft")}


def test_small_curation_steps(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (None, ["c"])], "old array<string>, new array<string>")
    assert [r[0] for r in df.select(curation.merged_evidence(F.col("old"), F.col("new"))).collect()] == [["a", "b", "c"], ["c"]]
    df = spark.createDataFrame([("2026-01-02",), (None,)], "d string")
    assert [r[0]["day"] for r in df.select(curation.issued_on(F.col("d"), None, "2026-05-05")).collect()] == ["2026-01-02", "2026-05-05"]
    a = spark.createDataFrame([("a", "ai-reviewed", False), ("b", "expert-confirmed", False), ("c", "disputed", True)], "id string, reviewStatus string, deprecated boolean")
    assert [r["id"] for r in curation.reviewable(a).collect()] == ["a"]
    with pytest.raises(ValueError):
        curation.reviewable(a, ("expert-confirmed",))


def test_agreement_ignores_runs_that_gave_up(spark):
    df = spark.createDataFrame([(1, 1, "abcdefghij"), (1, 2, "abcdefghiX"), (1, 3, "ab")], "page int, run int, t string")
    assert abs(curation.transcript_agreement(df, "page", "t").first()["agreement"] - 0.9) < 1e-9


def test_external_join_names_ambiguity(spark):
    items = spark.createDataFrame([("k1", "春晓", "春眠不觉晓"), ("k2", "无题", "相见时难别亦难"), ("k3", "无题", "昨夜星辰昨夜风")], "key string, title string, line string")
    anchors = spark.createDataFrame([("a1", "春晓", "春眠不觉晓"), ("a2", "无题", "相见时难别亦难"), ("a3", "无题", "昨夜星辰昨夜风")], "id string, title string, line string")
    assert {r["key"]: r["anchor"] for r in curation.external_join(items, anchors).collect()} == {"k1": "a1", "k2": "a2", "k3": "a3"}
