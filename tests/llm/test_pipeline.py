import random

import corpus_pipeline
from tests_llm_helpers import prose


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(12)
    passage, twin = prose(rng, 80), prose(rng, 200)
    rows = [(1, twin), (2, twin + " tail"), (3, prose(rng, 150) + " " + passage), (4, passage + " " + prose(rng, 150)), (5, "too short"), (6, "x y z " * 60)]
    rows += [(10 + k, prose(rng, 100)) for k in range(12)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept) == {1, 3, 4} | {10 + k for k in range(12)}
    assert passage in kept[3] and passage.split()[40] not in kept[4].split()[:20]
    assert all(kept[i] == t for i, t in rows if i >= 10 or i == 1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= set(kept) and all(len(r["ids"]) == r["n_tokens"] for r in out)


def test_odd_rows_go_through(spark, odd, none, tmp_path):
    for df in (odd, none):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            assert name == corpus_pipeline.STAGES[-1][0] or stage(spark, docs, "").columns == df.columns
            docs = stage(spark, docs, "")
        docs.collect()


def test_names_of_their_own_do_not_clash(spark):
    """Every stage with the names that the operators use inside as further columns, with unique and with repeated ids."""
    inside = ["_gone", "_key", "_copy", "_spans", "_cut_id", "_row", "_node", "_bucket", "_host", "_salt", "_ok", "_quality", "_kept", "_words", "_hashes", "_starts", "_n", "_lines", "id", "row", "n", "root", "component", "start", "end", "hash", "class", "part", "key", "size"]
    rng = random.Random(14)
    passage = prose(rng, 70)
    rows = [(k, prose(rng, 60) + " " + passage, "en", "s", 1, *["x"] * len(inside)) for k in range(4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in inside)
    for data in (rows, [*rows, rows[0]]):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.count() > 0, name
