"""Mappings, funnels, pages, coercions and markers on rows written by hand."""

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import imports, reports, rules


def test_mapping_violations(spark):
    schema = "key string, framework string, code string, textIncluded boolean, summary string, anchorIds array<string>"
    rows = [
        ("f:1", "f", "1", False, "words", ["a"]),
        ("f:2", "f", "2", False, "", ["a", "gone"]),
        ("f:3", "f", "3", True, "words", None),
        ("f:4", "f", "5", None, "words", []),
        ("f:3", "f", "3", None, None, ["a"]),
        ("f:3", "f", "3", None, None, ["a"]),
        (None, "f", "6", None, None, ["a"]),
    ]
    anchors = spark.createDataFrame([("a",)], "id string")
    got = rules.mapping_violations(spark.createDataFrame(rows, schema), anchors)
    assert {(r["key"], r["code"], r["detail"]) for r in got.collect()} == {
        ("f:1", "CODES_ONLY", None), ("f:2", "DANGLING_ANCHOR", "gone"), ("f:4", "KEY_PARTS", None), ("f:3", "DUPLICATE_KEY", "2"), (None, "KEY_PARTS", None),
    }
    assert rules.mapping_violations(spark.createDataFrame([], schema), anchors).isEmpty()


def test_funnel_counts_what_passed_all_before(spark):
    df = spark.createDataFrame([("s", True, True), ("s", False, True), ("s", True, None), ("t", None, True)], "g string, a boolean, b boolean")
    got = reports.funnel(df, ["g"], [("first", F.col("a")), ("second", F.col("b"))])
    assert {tuple(r) for r in got.collect()} == {("s", 3, 2, 1), ("t", 1, 0, 0)}


def test_page_span(spark):
    df = spark.createDataFrame([([(3,), (1,), (None,), (3,)],), ([],), ([(None,)],), (None,)], "items array<struct<page:int>>")
    got = [r["s"] for r in df.select(imports.page_span(F.col("items"), "page").alias("s")).collect()]
    assert [(s["pages"], s["first"], s["last"]) for s in got] == [([1, 3], 1, 3), ([], None, None), ([], None, None), (None, None, None)]


def test_json_values(spark):
    rows = [('["a", "b"]', ["a", "b"]), (' [ ]', []), ('"a"', ["a"]), ('"[x"', ["[x"]), ('""', []), ("null", []), ("false", []), ("0", []), ("7", ["7"]), (None, [])]
    df = spark.createDataFrame(rows, "j string, want array<string>")
    for r in df.select("j", "want", T.json_values(F.col("j")).alias("got")).collect():
        assert r["got"] == r["want"], r["j"]


def test_markers_and_what_fills_them(spark):
    text = "a <!--N:n--> 5 <!--/N--> b <!--N:cost-->\n1\n<!--/N--> <!--N:no-->x<!--/N--> <!--N:n-->6<!--/N-->"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "none")], "id long, text string")
    values = spark.createDataFrame([("n", "5"), ("cost", "$1\\2")], "key string, wanted string")
    got = {(r["nth"], r["key"], r["shown"], r["state"]) for r in reports.markers(docs, values).collect()}
    assert got == {(1, "n", "5", "fresh"), (2, "cost", "1", "stale"), (3, "no", "x", "unknown"), (4, "n", "6", "stale")}
    out = docs.filter("id = 1").select(reports.filled(F.col("text"), {"n": "5", "cost": "$1\\2"}).alias("t"))
    assert out.first()["t"] == "a <!--N:n-->5<!--/N--> b <!--N:cost-->$1\\2<!--/N--> <!--N:no-->x<!--/N--> <!--N:n-->5<!--/N-->"
    assert reports.markers(out.select(F.lit(1).alias("id"), F.col("t").alias("text")), values).filter("state = 'stale'").isEmpty()


def test_works_are_imported_once(spark):
    schema = "seq long, title string, author string, dynasty string, grade string, tags array<string>"
    rows = [
        (1, " 静夜思 ", "李白", "唐", "G2", ["月"]),
        (2, "静夜思", "李白", "唐", "G3", None),
        (3, "春晓", "孟浩然", "", "G1", None),
        (4, "悯农", "李绅", "唐", None, None),
        (5, "悯农", "李绅", "唐", "G13", None),
        (6, None, None, None, "G1", None),
        (7, "咏鹅", "骆宾王", "唐", "G1", ["唐诗"]),
        (8, "登鹳雀楼", "王之涣", "唐", "G2", None),
    ]
    works = spark.createDataFrame(rows, schema)
    listed = spark.createDataFrame([("春晓",)], "key string")
    known = spark.range(1).select(T.signature(F.lit("语文"), F.lit("默写"), F.lit("能默写《咏鹅》全诗且无错别字")).alias("sig"))
    queued = spark.createDataFrame([("NEED_ANCHOR", "春晓", "情感体悟")], "kind string, title string, dimension string")
    used = spark.createDataFrame([], "id string")
    got = imports.import_works(works, listed, known, queued, used)
    anchors = {r["title"]: r for r in got.anchors.collect()}
    assert set(anchors) == {"静夜思", "春晓", "登鹳雀楼"} and anchors["静夜思"]["grade"] == "G2"
    assert anchors["春晓"]["statement"] == "能默写《春晓》全诗且无错别字" and len({r["id"] for r in anchors.values()}) == 3
    items = {r["title"]: (r["tags"], r["anchor_id"]) for r in got.list_items.collect()}
    assert items == {"静夜思": (["月", "唐诗"], anchors["静夜思"]["id"]), "咏鹅": (["唐诗"], None), "登鹳雀楼": (["唐诗"], anchors["登鹳雀楼"]["id"])}
    queue = {(r["kind"], r["title"], r["dimension"]) for r in got.queue.collect()}
    assert queue == {("NEED_GRADE", "悯农", None)} | {("NEED_ANCHOR", t, s) for t in anchors for s in imports.SIDES} - {("NEED_ANCHOR", "春晓", "情感体悟")}
    assert {(r["seq"], r["reason"]) for r in got.skipped.collect()} == {(2, "anchor is known"), (4, "no year"), (5, "no year"), (6, "no title"), (7, "anchor is known")}

    again = imports.import_works(works, spark.createDataFrame([(t,) for t in ("春晓", *items)], "key string"), known.union(got.anchors.select("sig")), got.queue.unionByName(queued, allowMissingColumns=True), used)
    assert again.list_items.isEmpty() and again.anchors.isEmpty() and again.queue.isEmpty()


def test_fields_that_are_not_in_normal_form(spark):
    df = spark.createDataFrame([("水 在 沸腾", "ok"), (None, "ok")], "a string, b string")
    got = df.select(F.explode(T.unnormalized(["a", "b"])).alias("u")).select("u.*").collect()
    assert [tuple(r) for r in got] == [("a", "水 在 沸腾", "水在沸腾")]
