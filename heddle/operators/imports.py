"""Lists of works as anchors: titles that are told apart, statements, and one anchor for a whole list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import gate
from heddle.functions import text as T
from heddle.operators import curation
from heddle.sources.tables import settled

# What is written out by heart, the years of school, and the sides of a work that need a judgement.
RECITED, VERB, SUBJECT = "全诗", "默写", "语文"
YEAR = r"^G(1[0-2]|[1-9])\z"
SIDES = ("意象理解", "情感体悟", "语言品味")


def shown_titles(items: DataFrame) -> DataFrame:
    """items (key, firstLine, author, ...) with shown: the title, and of titles that more than one work has the first seven
    characters of its text in brackets, or its author where the text is not known."""
    many = items.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("_many"))
    first, author = F.substring(F.coalesce("firstLine", F.lit("")), 1, 7), F.coalesce("author", F.lit(""))
    shown = F.when(~F.col("_many"), F.col("key")).when(first != "", F.concat("key", F.lit("（"), first, F.lit("）"))).otherwise(F.concat("key", F.lit("·"), author))
    return items.join(many, "key").withColumn("shown", shown).drop("_many")


def recital_statement(shown: Column) -> Column:
    """The statement of a work to be recited, cut to 60 characters."""
    return F.substring(F.concat(F.lit("能背诵《"), shown, F.lit("》全文且不错漏")), 1, 60)


def list_container(items: DataFrame, keys: list[str], page: str) -> DataFrame:
    """keys, n, page_range: what one anchor of a whole list says of its items; pages as text, without a range if unknown."""
    ends = F.concat(F.min(page), F.lit("–"), F.max(page))
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(ends, F.lit("")).alias("page_range"))


def page_span(items: Column, page: str) -> Column:
    """struct(pages, first, last): the distinct pages of an array of structs in order, without those that are not known;
    no ends where none is."""
    pages = F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: x[page]), lambda x: x.isNotNull())))
    return F.struct(pages.alias("pages"), F.array_min(pages).alias("first"), F.array_max(pages).alias("last"))


@dataclass
class Imported:
    """list_items: title, author, dynasty, grade, tags, anchor_id; anchors: id, title, statement, verb, object, sig, grade;
    queue: kind, title, author, dimension; skipped: seq, title, reason."""

    list_items: DataFrame
    anchors: DataFrame
    queue: DataFrame
    skipped: DataFrame


def import_works(works: DataFrame, listed: DataFrame, signatures: DataFrame, queued: DataFrame, used: DataFrame) -> Imported:
    """Works as list items and anchors, each once however often it is run, and what people have to judge.

    works: seq, title, author, dynasty, grade, tags (array); listed: key; signatures: sig, made with the statement; queued:
    kind, title, dimension (null: none); used: ids. The first row with a year makes a title's item and anchor; a title
    without a year is queued, never guessed. Rows without a title, without a year, with a statement that cannot be
    decided, or of a known anchor are skipped with their reason. Normal forms, gate and ids are written once.
    """
    rows = settled(works.withColumn("title", T.normalized(T.trimmed(F.coalesce("title", F.lit(""))))))
    named = rows.filter("title <> ''")
    dated = F.coalesce(F.col("grade").rlike(YEAR), F.lit(False))
    first = named.filter(dated).groupBy("title").agg(F.min_by(F.struct("author", "dynasty", "grade", "tags"), "seq").alias("_w"), F.min("seq").alias("seq")).select("title", "seq", "_w.*")
    stated = settled(first.withColumn("statement", T.normalized(F.concat(F.lit(f"能{VERB}《"), "title", F.lit(f"》{RECITED}且无错别字")))).withColumn("object", F.concat("title", F.lit(RECITED))))
    judged = settled(stated.withColumn("ok", gate.decidable(F.col("statement"))["ok"]))
    signed = settled(judged.withColumn("sig", T.signature(F.lit(SUBJECT), F.lit(VERB), F.col("statement"))))
    new = signed.filter("ok").join(signatures.select("sig").distinct(), "sig", "left_anti")
    new = settled(new.join(new.groupBy("sig").agg(F.min("seq").alias("seq")), ["sig", "seq"], "left_semi"))
    anchors = curation.minted(new, "title", used).withColumn("verb", F.lit(VERB))

    fresh = signed.join(listed.select(F.col("key").alias("title")).distinct(), "title", "left_anti")
    items = fresh.join(anchors.select("title", F.col("id").alias("anchor_id")), "title", "left")
    labels = F.array_distinct(F.array_compact(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.concat(F.nullif("dynasty", F.lit("")), F.lit("诗"))))))

    undated = named.filter(~dated).groupBy("title").agg(F.min_by("author", "seq").alias("author")).select(F.lit("NEED_GRADE").alias("kind"), "title", "author", F.lit(None).cast("string").alias("dimension"))
    sides = anchors.select(F.lit("NEED_ANCHOR").alias("kind"), "title", "author", F.explode(F.array(*[F.lit(s) for s in SIDES])).alias("dimension"))
    asked = queued.select("kind", "title", F.coalesce("dimension", F.lit("")).alias("_side")).distinct()
    queue = undated.union(sides).withColumn("_side", F.coalesce("dimension", F.lit(""))).join(asked, ["kind", "title", "_side"], "left_anti").drop("_side")

    of_title = rows.join(signed.select("title", "ok"), "title", "left").join(anchors.select("seq", F.lit(True).alias("_made")), "seq", "left")
    reason = F.when(F.col("title") == "", "no title").when(~dated, "no year").when(~F.col("ok"), "not decidable").when(F.col("_made").isNull(), "anchor is known")
    return Imported(
        items.select("title", "author", "dynasty", "grade", labels.alias("tags"), "anchor_id"),
        anchors.select("id", "title", "statement", "verb", "object", "sig", "grade"),
        queue.select("kind", "title", "author", "dimension"),
        of_title.select("seq", "title", reason.alias("reason")).filter("reason is not null"),
    )
