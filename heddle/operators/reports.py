"""Report tables: edge labels, places in candidate pools, holes in numbered codes, fragments and the state of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators import metrics

# How a proposal's evidence names its place in the pool; signs of a requirement that was cut or glued.
POOL_NOTE = r"候选池\s*(\d+)\s*选\s*(\d+)"
FRAGMENT_LEAD = "^[，、；。等和与或）]"
FRAGMENT_GLUED = r"[^0-9]\d\.\s*\S.{4,}\d\."
FRAGMENT_HEADING = "课程类别|普通高中|课程标准"


def pool_place(evidence: Column) -> Column:
    """struct(pool_from, rank_from): the tens of the pool's size and the fives of the choice that the first llm evidence
    (structs kind, detail) names; null where it names none."""
    note = F.get(F.filter(evidence, lambda e: e["kind"] == "llm"), F.lit(0))["detail"]
    part = lambda k: F.regexp_extract(F.coalesce(note, F.lit("")), POOL_NOTE, k).try_cast("long")
    pool, choice = part(1), part(2)
    return F.when(pool.isNotNull() & choice.isNotNull(), F.struct((pool - pool % 10).alias("pool_from"), (choice - 1 - (choice - 1) % 5).alias("rank_from")))


def rates(df: DataFrame, bucket: str, flag: Column) -> DataFrame:
    """bucket, n, n_flagged: rows of each bucket and those of the flag; rows without a bucket do not count."""
    return df.filter(F.col(bucket).isNotNull()).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(flag, 1)).alias("n_flagged"))


def edge_labels(edges: DataFrame) -> DataFrame:
    """type (null: not labelled yet), n, n_in_graph, n_hard, n_capped, n_signed, n_signatures, share of all edges.

    edges: live ones with type, strength, inInferenceGraph, strengthCappedBy, failureSignature. Conventions are in no graph.
    """
    count = lambda c: F.count(F.when(c, 1))
    signed = F.nullif("failureSignature", F.lit(""))
    in_graph = ~F.coalesce(F.col("type") == "convention", F.lit(False)) & F.coalesce("inInferenceGraph", F.lit(True))
    per = edges.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), count(in_graph).alias("n_in_graph"), count(F.col("strength") == "hard").alias("n_hard"),
        count(F.coalesce("strengthCappedBy", F.lit("")) != "").alias("n_capped"), F.count(signed).alias("n_signed"), F.countDistinct(signed).alias("n_signatures"),
    )
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a handful of types


def signature_length(edges: DataFrame) -> DataFrame:
    """length: the upper median of the failure signatures' lengths, conventions aside; no row without any."""
    said = edges.filter((F.coalesce("failureSignature", F.lit("")) != "") & ~F.coalesce(F.col("type") == "convention", F.lit(False)))
    return metrics.upper_median(said.select(F.length("failureSignature").alias("length")), [], "length")


def code_holes(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    """keys, from, to: runs of numbers that codes of three levels (1.2.3) leave out, counted from 1 in each group.

    Codes of other depth start anew under many headings and are not checked. Neighbours are compared, so no list of
    numbers is gathered.
    """
    n = F.regexp_extract(code, r"^[^.]*\.[^.]*\.(\d+)\z", 1).try_cast("long")
    per = rows.select(*keys, n.alias("_n")).filter("_n is not null").distinct()
    before = F.coalesce(F.lag("_n").over(Window.partitionBy(*keys).orderBy("_n")), F.lit(0))
    return per.withColumn("_before", before).filter("_n > _before + 1").select(*keys, (F.col("_before") + 1).alias("from"), (F.col("_n") - 1).alias("to"))


def is_fragment(text: Column) -> Column:
    """Whether a requirement begins with a mark or conjunction, holds a second number, or words of the page's head.

    A missing stop at the end says nothing: some subjects have none at all.
    """
    return text.rlike(FRAGMENT_LEAD) | text.rlike(FRAGMENT_GLUED) | text.rlike(FRAGMENT_HEADING)


def fragment_rates(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n, n_flagged, percent of fragments."""
    return rates(items, key, is_fragment(F.col(text))).withColumn("percent", F.col("n_flagged") / F.col("n") * 100)


def state(anchors: DataFrame) -> DataFrame:
    """One row: how many anchors there are, live, usable (by kind of confirmation) and pending; how many usable ones have a
    stage of two grades at most; the last grade; how many live ones are tagged or have targets; and the share of anchors
    from curriculum text that have the default stage 1 to 9 (1 if there is none).

    anchors: status, deprecated, lo, hi, tagged, targeted, evidenceSource.
    """
    live = ~F.coalesce("deprecated", F.lit(False))
    usable = live & F.col("status").isin(*metrics.CITABLE)
    count = lambda c: F.count(F.when(c, 1))
    of_text = live & (F.col("evidenceSource") == "curriculum-content")
    default = count(of_text & (F.col("lo") == 1) & (F.col("hi") == 9)) / F.nullif(count(of_text), F.lit(0))
    return anchors.agg(
        F.count(F.lit(1)).alias("n_all"), count(live).alias("n_live"), count(usable).alias("n_usable"),
        *[count(usable & (F.col("status") == s)).alias(n) for s, n in (("expert-confirmed", "n_human"), ("ai-adjudicated", "n_adjudicated"), ("auto-confirmed", "n_objective"))],
        (count(live) - count(usable)).alias("n_pending"), count(usable & (F.col("hi") - F.col("lo") <= 1)).alias("n_narrow"),
        F.coalesce(F.max(F.when(live, F.col("hi"))), F.lit(9)).cast("long").alias("last_grade"), count(live & F.coalesce("tagged", F.lit(False))).alias("n_tagged"),
        count(live & F.coalesce("targeted", F.lit(False))).alias("n_targeted"), F.coalesce(default, F.lit(1.0)).alias("default_share"),
    )


def open_tasks(state: DataFrame, tasks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """task, done, got of tasks that are a condition on the state and what to show of it; a null condition is not done."""
    rows = [F.struct(F.lit(k).alias("task"), F.coalesce(done, F.lit(False)).alias("done"), got.cast("string").alias("got")) for k, (done, got) in tasks.items()]
    return state.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def funnel(rows: DataFrame, group: list[str], stages: list[tuple[str, Column]]) -> DataFrame:
    """group, raw and, for each named stage, the rows that pass it and all stages before it (null does not pass)."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("raw")]
    for name, c in stages:
        passed = passed & c
        counts.append(F.count(F.when(passed, 1)).alias(name))
    return rows.groupBy(*group).agg(*counts)


#: A number in a text that is kept up to date, with its key and what it shows.
MARKER = r"<!--N:([A-Za-z][\w-]*)-->([\s\S]*?)<!--/N-->"


def markers(documents: DataFrame, values: DataFrame) -> DataFrame:
    """id, nth, key, shown, wanted, state (unknown: no such key; stale; fresh) of each marker. documents: id, text; values:
    key, wanted. Blanks around what is shown or wanted do not count."""
    text = F.coalesce("text", F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(MARKER), 1).alias("key"), F.regexp_extract_all(text, F.lit(MARKER), 2).alias("shown"))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    found = documents.select("id", F.posexplode(both).alias("nth", "m")).select("id", (F.col("nth") + 1).alias("nth"), "m.key", bare("m.shown").alias("shown"))
    state = F.when(F.col("wanted").isNull(), "unknown").when(F.col("shown") != bare("wanted"), "stale").otherwise("fresh")
    return found.join(values.select("key", "wanted"), "key", "left").select("id", "nth", "key", "shown", "wanted", state.alias("state"))


def filled(text: Column, values: dict[str, str]) -> Column:
    """The text with each marker of a known key showing its value; others stay."""
    for key, value in values.items():
        plain = str(value).replace("\\", "\\\\").replace("$", "\\$")
        text = F.regexp_replace(text, rf"(<!--N:{key}-->)[\s\S]*?(<!--/N-->)", f"$1{plain}$2")
    return text
