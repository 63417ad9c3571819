"""Curation steps: ids, tags, proposals, splits, disputes, stage repair, source matching and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators.rules import first_match
from heddle.sources.tables import settled

#: Letters and digits of minted ids: all but those that are read for one another.
ID_LETTERS = "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" if c not in "0O1lIo")


def _id_of(key: Column, salt: int) -> Column:
    h = F.sha2(F.concat(key, F.lit(f"#{salt}")), 256)
    n = len(ID_LETTERS)
    digit = lambda k: F.substring(F.lit(ID_LETTERS), (F.conv(F.substring(h, 1 + 7 * k, 7), 16, 10).cast("long") % n + 1).cast("int"), F.lit(1))
    return F.concat(F.lit("ca_"), *[digit(k) for k in range(8)])


def minted(df: DataFrame, key: str, used: DataFrame, out: str = "id", rounds: int = 20) -> DataFrame:
    """df with new ids: hashes of the key; one that is used, or that two rows get, is tried again with another salt.

    used: id. Of rows with one candidate the one with the smallest key keeps it. Keys are unique.
    """
    todo, done, taken = df, None, used.select("id").distinct()
    for salt in range(rounds):
        mine = todo.withColumn(out, _id_of(F.col(key).cast("string"), salt))
        first = mine.groupBy(out).agg(F.min(key).alias("_winner"))
        free = first.join(taken.select(F.col("id").alias(out)), out, "left_anti")
        won = settled(mine.join(free, out).filter(F.col(key) == F.col("_winner")).drop("_winner").select(*df.columns, out))
        done = won if done is None else done.unionByName(won)
        todo = settled(todo.join(won.select(key), key, "left_anti"))
        if todo.isEmpty():
            return done
        taken = settled(taken.union(won.select(F.col(out).alias("id"))))
    raise ValueError(f"ids still collide after {rounds} rounds")


def accepted_tags(old: Column, new: Column, vocabulary: tuple[str, ...], most: int = 2) -> Column:
    """The proposed tags that the vocabulary has, `most` at most; without any the old ones stay."""
    ok = F.slice(F.array_distinct(F.filter(new, lambda t: t.isin(*vocabulary))), 1, most)
    return F.when(F.size(ok) > 0, ok).otherwise(old)


def with_literacy(anchors: DataFrame, proposals: DataFrame, vocabulary: dict[str, tuple[str, ...]]) -> DataFrame:
    """Fills literacy where there is none, and a matrix anchor's dimension from its first value. proposals: id, tags."""
    words = F.create_map(*[x for k, v in vocabulary.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    j = anchors.join(proposals.select("id", F.col("tags").alias("_tags")), "id", "left")
    target = ~F.coalesce("deprecated", F.lit(False)) & ((F.coalesce(F.size("literacy"), F.lit(0)) <= 0) | ((F.col("track") == "MATRIX") & F.col("dimension").isNull()))
    ok = F.array_intersect(F.col("_tags"), words[F.col("discipline")])
    lit = F.when(target & (F.coalesce(F.size("literacy"), F.lit(0)) <= 0) & (F.size(ok) > 0), F.slice(ok, 1, 2)).otherwise(F.col("literacy"))
    return j.withColumn("literacy", lit).withColumn("dimension", F.when(target & (F.col("track") == "MATRIX") & F.col("dimension").isNull(), F.get("literacy", F.lit(0))).otherwise(F.col("dimension"))).drop("_tags")


def cross_pool(targets: DataFrame, priority: DataFrame, cap: int = 12, per_group: int = 4) -> DataFrame:
    """a, p, nth: candidates of other disciplines, taken in turn from each. targets: id, discipline, stage; priority: id, weight.

    A discipline gives its `per_group` heaviest anchors of the target's stage or an earlier one. For each stage that list
    is short and made once, so targets meet (disciplines * per_group) rows and not all anchors.
    """
    t = targets.join(priority, "id", "left").na.fill(0, ["weight"])
    stages = t.select(F.col("stage").alias("upto")).distinct()
    heads = F.broadcast(stages)  # grades: at most twelve
    best = Window.partitionBy("upto", "discipline").orderBy(F.desc("weight"), "id")
    short = t.join(heads, F.col("stage") <= F.col("upto")).withColumn("round", F.row_number().over(best)).filter(F.col("round") <= per_group)
    short = settled(short.select(F.col("upto").alias("stage"), F.col("discipline").alias("p_discipline"), F.col("id").alias("p"), "round", "weight"))
    pairs = targets.select(F.col("id").alias("a"), "discipline", "stage").join(short, "stage").filter("discipline <> p_discipline and a <> p")
    turn = Window.partitionBy("a").orderBy("round", F.desc("weight"), "p")
    return pairs.withColumn("nth", F.row_number().over(turn)).filter(F.col("nth") <= cap).select("a", "p", "nth")


def accepted_proposals(proposals: DataFrame, most: int = 3, most_cross: int = 2, least_reason: int = 6) -> DataFrame:
    """Proposed edges with an index in the pool, a reason of some length, and no more than the cap an anchor."""
    ok = proposals.filter((F.col("index") >= 0) & (F.col("index") < F.col("pool_size")) & (F.length(F.coalesce("reason", F.lit(""))) >= least_reason)).dropDuplicates(["a", "p"])
    w = Window.partitionBy("a", "cross").orderBy("seq")
    return ok.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= F.when(F.col("cross"), most_cross).otherwise(most)).drop("_n")


#: Issues that a stage does not settle, and those that the gate decides too; the bands of most disciplines.
OTHER_ISSUES = ("undecidable", "not-a-capability", "evidence-weak", "truncated")
GATE_ISSUES = ("undecidable", "not-a-capability")
STANDARD_BANDS = {1: (1, 2), 2: (3, 4), 3: (5, 6), 4: (7, 9)}


def dispute_outcome(issues: Column, gate_ok: Column, lo: Column, hi: Column, source_lo: Column, source_hi: Column) -> Column:
    """What becomes of a disputed anchor, first match. issues: the kinds of objection; source: the band that its source names.

    A statement that gate and objection both reject is deprecated; one that the gate rejects stays disputed. An objection to
    a stage that equals the source's is withdrawn, a narrower stage is restored to it, another is a conflict for people.
    """
    any_of = lambda kinds: F.exists(issues, lambda i: i.isin(*kinds))
    about = any_of(["stage"]) & source_lo.isNotNull() & source_hi.isNotNull() & lo.isNotNull() & hi.isNotNull()
    inside = (lo >= source_lo) & (hi <= source_hi)
    return first_match(
        [
            (~gate_ok & any_of(GATE_ISSUES), "deprecate"),
            (~gate_ok, "keep: gate"),
            (about & ~inside, "keep: stage conflict"),
            (about & any_of(OTHER_ISSUES), "keep: other issues"),
            (about & (lo == source_lo) & (hi == source_hi), "release: stage was right"),
            (about, "release: stage restored"),
        ],
        "keep: unresolved",
    )


def restored_stage(anchors: DataFrame, bands: DataFrame) -> DataFrame:
    """anchors (id, discipline, srcStage 1 to 4, stage_min, stage_max, deprecated) with the band that their source names.

    bands: discipline, band, lo, hi as their documents print them. A discipline whose bands differ from the standard ones
    has its own if all four are known, and its anchors are set to them; others have the standard bands, and only a stage
    inside of the band is widened to it: any other is a conflict and stays.
    """
    standard = F.create_map(*[x for k, v in STANDARD_BANDS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("lo"), F.lit(v[1]).alias("hi")))])
    odd = (F.col("lo") != standard[F.col("band")]["lo"]) | (F.col("hi") != standard[F.col("band")]["hi"])
    whole = bands.groupBy("discipline").agg(F.countDistinct("band").alias("_n"), F.max(odd).alias("_odd")).filter("_n = 4 and _odd").select("discipline")
    own = bands.join(whole, "discipline", "left_semi").select("discipline", F.col("band").alias("srcStage"), F.struct("lo", "hi").alias("_own"))
    j = anchors.join(own, ["discipline", "srcStage"], "left").withColumn("_band", F.coalesce("_own", standard[F.col("srcStage")]))
    lo, hi = F.col("_band.lo"), F.col("_band.hi")
    same = F.col("stage_min").eqNullSafe(lo) & F.col("stage_max").eqNullSafe(hi)
    inside = F.coalesce((F.col("stage_min") >= lo) & (F.col("stage_max") <= hi), F.lit(False))
    asked = F.col("_band").isNotNull() & ~F.coalesce(F.col("deprecated"), F.lit(False)) & ~same
    move = asked & (F.col("_own").isNotNull() | inside)
    out = j.withColumn("stage_conflict", asked & ~move).withColumn("_move", move)
    return out.withColumn("stage_min", F.when(F.col("_move"), lo).otherwise(F.col("stage_min"))).withColumn("stage_max", F.when(F.col("_move"), hi).otherwise(F.col("stage_max"))).drop("_own", "_band", "_move")


def split_gate(parts: DataFrame) -> DataFrame:
    """parents with the parts that may replace them. parts: parent, parent_statement, nth, statement, ok (gate), signature.

    All parts of a parent pass the gate, add no content character and begin with no pronoun; there are two or more, and a
    signature belongs to the first parent that claims it (smallest id, in order of parts), whether that one is split or not.
    """
    claim = Window.partitionBy("signature").orderBy("parent", "nth")
    new = F.array_except(T.content_characters(F.col("statement")), T.content_characters(F.col("parent_statement")))
    checked = parts.withColumn("_first", F.row_number().over(claim) == 1).withColumn("_new", F.size(new)).withColumn("_loose", F.col("statement").rlike("^(能|会)?(它们|它|其|该|此|这些|这)"))
    good = F.col("ok") & F.col("_first") & (F.col("_new") == 0) & ~F.col("_loose")
    return checked.groupBy("parent").agg(F.count(F.lit(1)).alias("n_parts"), F.min(good.cast("int")).alias("_all")).select("parent", "n_parts", ((F.col("_all") == 1) & (F.col("n_parts") >= 2)).alias("split"))


def best_sentence(anchors: DataFrame, sources: DataFrame, key: str, least: int = 8, most_pair: int = 220) -> DataFrame:
    """id, sentence, share: what covers most of a statement, of a source's sentences and then of neighbours together.

    The first wins ties, and a sentence wins over a pair. Short sentences and long pairs are left out; an anchor that
    nothing covers has no row. anchors: id, statement and key; sources: key, source text.
    """
    parts = sources.select(key, F.posexplode(T.sentences(F.col("source"))).alias("pos", "s")).filter(F.length("s") >= least)
    pairs = parts.withColumn("s2", F.concat("s", F.lead("s").over(Window.partitionBy(key).orderBy("pos")))).filter(F.length("s2") <= most_pair)
    options = parts.select(key, F.lit(0).alias("kind"), "pos", "s").union(pairs.select(key, F.lit(1).alias("kind"), "pos", F.col("s2").alias("s")))
    share = T.coverage(T.content_characters(F.col("statement")), T.content_characters(F.col("s")))
    best = F.min(F.struct((-share).alias("x"), "kind", "pos", "s")).alias("b")
    return anchors.join(options, key).filter(share > 0).groupBy("id").agg(best).select("id", F.col("b.s").alias("sentence"), (-F.col("b.x")).alias("share"))


def example_references(anchors: DataFrame, examples: DataFrame) -> DataFrame:
    """id, example: the numbered examples that a text names. examples: number, key."""
    named = anchors.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("例\\s*([0-9]+)"), 1))).alias("number"))
    return named.join(examples.select(F.col("number").cast("string").alias("number"), F.col("key").alias("example")), "number").select("id", "example")


def transcript_agreement(runs: DataFrame, key: str, text: str) -> DataFrame:
    """Least pairwise similarity of a page's transcripts; runs below 0.8 of the longest gave up and do not count."""
    most = runs.groupBy(key).agg(F.max(F.length(text)).alias("_most"))
    kept = runs.join(most, key).filter(F.length(text) >= 0.8 * F.col("_most")).select(key, "run", F.col(text).alias("t"))
    x, y = kept.alias("x"), kept.alias("y")
    pairs = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.run") < F.col("y.run")))  # a few runs a page
    return pairs.select(F.col(f"x.{key}").alias(key), T.sequence_ratio("x.t", "y.t").alias("r")).groupBy(key).agg(F.min("r").alias("agreement"))


def external_join(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """List items with their anchor by title key, and by five characters more where a title repeats. items: key, title, line; anchors: id, title, line."""
    keyed = lambda df: df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(T.match_key(F.col("title"))))).withColumn("match_key", T.ambiguous_key(F.col("title"), F.col("line"), F.col("_n")))
    a = keyed(anchors).groupBy("match_key").agg(F.min("id").alias("anchor"), F.count(F.lit(1)).alias("_k"))
    return keyed(items).join(a, "match_key", "left").select("key", "match_key", F.when(F.col("_k") == 1, F.col("anchor")).alias("anchor"), (F.coalesce("_k", F.lit(0)) > 1).alias("ambiguous"))


def without_source_text(anchors: DataFrame) -> DataFrame:
    """The published copy: source texts are out, and a mark says so."""
    return anchors.withColumn("srcTextStripped", F.col("provenance.srcText").isNotNull()).withColumn("provenance", F.col("provenance").dropFields("srcText"))


def with_targets(anchors: DataFrame, targets: DataFrame, ids: list[str]) -> DataFrame:
    """The per-stage targets as an array on the anchors named. targets: stage, band, recognize, write."""
    all_ = targets.agg(F.array_sort(F.collect_list(F.struct("band", "stage", "recognize", "write"))).alias("stageTargets"))  # a handful of rows
    return anchors.withColumn("_k", F.lit(1)).join(F.broadcast(all_.withColumn("_k", F.lit(1))), "_k").withColumn("stageTargets", F.when(F.col("id").isin(ids), F.col("stageTargets"))).drop("_k")


def promoted(candidates: DataFrame) -> DataFrame:
    """Candidates that are no junk as proposed anchors: the first four drafts of evidence of four characters or more; those
    without any get the template and say so. candidates: bucket, statement, evidence."""
    drafts = F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.length(e) >= 4)
    none = F.size(drafts) == 0
    kept = candidates.filter("bucket <> 'JUNK'").withColumn("evidenceSource", F.when(none, "fallback").otherwise("llm-draft"))
    kept = kept.withColumn("evidence", F.when(none, F.array(F.concat(F.lit("能完成："), F.col("statement")))).otherwise(F.slice(drafts, 1, 4)))
    return kept.withColumn("reviewStatus", F.lit("llm-proposed")).withColumnRenamed("bucket", "triageBucket")


def files_by_prefix(manifest: DataFrame) -> DataFrame:
    """The data index: files grouped by their first folder, with sizes and short hashes."""
    name = F.regexp_extract("file", r"([^/]+)/[^/]+\z", 1)
    return manifest.groupBy(name.alias("prefix")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.substring("sha256", 1, 12))).alias("hashes"))


def catalogue(anchors: DataFrame, facet: Column | None = None, search: str | None = None) -> DataFrame:
    """Rows of the list page in its order; a facet and a text narrow them."""
    df = anchors if facet is None else anchors.filter(facet)
    if search:
        df = df.filter(F.lower(F.concat_ws(" ", "id", "statement", "discipline", "strand")).contains(search.lower()))
    return df.orderBy("discipline", "stage", "id")


def child_view(anchors: DataFrame, lo: int, hi: int) -> DataFrame:
    """Of one band: the anchors whose interval meets it, numbered in their discipline; objective ones first, then by statement."""
    hit = anchors.filter((F.col("stage_min") <= hi) & (F.col("stage_max") >= lo))
    w = Window.partitionBy("discipline").orderBy((F.col("status") != "auto-confirmed").cast("int"), "statement", "id")
    return hit.withColumn("nth", F.row_number().over(w))


def merged_evidence(old: Column, new: Column) -> Column:
    """The old evidence and what is new, in order."""
    old = F.coalesce(old, F.array().cast("array<string>"))
    return F.concat(old, F.array_except(F.coalesce(new, F.array().cast("array<string>")), old))


def issued_on(record: Column, option: str | None, today: str) -> Column:
    """struct(day, note): the record's day, else the option, else today with a note."""
    given = F.coalesce(F.nullif(record, F.lit("")), F.lit(option).cast("string"))
    return F.struct(F.coalesce(given, F.lit(today)).alias("day"), F.when(given.isNull(), "（未指定出具日期，取生成当日）").otherwise("").alias("note"))


def reviewable(anchors: DataFrame, want: tuple[str, ...] | None = None) -> DataFrame:
    """Live anchors that may be judged again; raises if a status is asked for that people or rules have confirmed."""
    confirmed = ("expert-confirmed", "auto-confirmed")
    if want and set(want) & set(confirmed):
        raise ValueError(f"confirmed anchors are not judged again: {sorted(set(want) & set(confirmed))}")
    out = anchors.filter(~F.coalesce("deprecated", F.lit(False)) & ~F.col("reviewStatus").isin(*confirmed))
    return out.filter(F.col("reviewStatus").isin(*want)) if want else out


def detail(anchors: DataFrame, fields: list[str]) -> DataFrame:
    """id, field, value, empty: one row a field, empty ones too."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return anchors.select("id", F.explode(rows).alias("r")).select("id", "r.field", "r.value", (F.coalesce("r.value", F.lit("")) == "").alias("empty"))
