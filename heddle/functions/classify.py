"""Classifiers over candidates, edges and reviews, as ordered cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators.rules import first_match

CONFIRM, DISPUTE, SKIP = "expert-confirmed", "disputed", "skip"


# Words of those who teach, marks of what pupils do, joints between two abilities, words that allow a repair.
TEACHING_TALK = (
    "教师", "教学中", "教材", "编写", "本学段", "本单元", "建议", "应注意", "要注意", "可以让学生", "引导学生", "组织学生", "鼓励学生", "帮助学生理解", "在教学",
    "让学生", "使学生", "教学应", "教学要", "教学时", "学习活动", "素材", "呈现方式", "课程内容", "本课程", "课时", "评价时", "命题", "试题",
)
STUDENT_MARK = "(能|会|学会|掌握|运用|独立|自主|尝试|参与)"
SEVERAL_ABILITIES = "[；;]|，(?:能|会|并能|同时能)"
COMPOUND_AND = "并(能|会|进行|说明|解释|运用|判断|表达|描述|用)"


def triage(statement: Column, verb: Column, obj: Column, lo: Column, hi: Column) -> Column:
    """JUNK (about teaching, or not about pupils), SPLIT (several abilities), NO_STAGE (none, or all of 1 to 9), READY
    (short, with a verb and an object) or JUDGE, first match."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return first_match(
        [
            (statement.rlike("|".join(TEACHING_TALK)), "JUNK"),
            (~statement.rlike(STUDENT_MARK), "JUNK"),
            (statement.rlike(SEVERAL_ABILITIES), "SPLIT"),
            ((lo.isNull() & hi.isNull()) | ((lo == 1) & (hi == 9)), "NO_STAGE"),
            ((F.length(statement) <= 32) & has(verb) & (F.length(F.coalesce(obj, F.lit(""))) >= 3), "READY"),
        ],
        "JUDGE",
    )


def compound_signal(s: Column, verbs: tuple[str, ...] = T.REQUIREMENT_VERBS) -> Column:
    """Whether a statement looks like several: a list comma, an `and` with a verb, a verb after a comma, or two nouns with 和."""
    return s.contains("、") | s.rlike(COMPOUND_AND) | s.rlike("，\\s*(?:" + "|".join(verbs) + ")") | (s.rlike("[一-鿿]{2,}和[一-鿿]{2,}") & (F.length(s) >= 20))


def redundancy_group(type_: Column, band_gap: Column, strand_rel: Column, alt_hops: Column, topic_rel: Column) -> Column:
    """R0 to R6 of a redundant edge, first match: convention, two bands apart, other strand, a long way round, other topic,
    same topic, nothing known."""
    return first_match([(type_ == "convention", "R0"), (band_gap >= 2, "R1"), (strand_rel == "diff", "R2"), (alt_hops >= 3, "R3"), (topic_rel == "diff", "R4"), (topic_rel == "same", "R5")], "R6")


def heading_like(label: Column) -> Column:
    return F.coalesce(F.length(label) > 12, F.lit(False))


def grounded(statement: Column, source: Column, threshold: float = 0.62) -> Column:
    """Whether the source has enough of a statement's content characters; a statement without any is not grounded."""
    return F.coalesce(T.coverage(T.content_characters(statement), T.content_characters(source)) >= threshold, F.lit(False))


def drifted(obj: Column, source: Column, threshold: float = 0.45) -> Column:
    """Whether a rewritten object has too few of its content characters from the source; an empty object has not drifted."""
    mine = T.content_characters(obj)
    share = F.size(F.array_intersect(mine, T.content_characters(source))) / F.greatest(F.size(mine), F.lit(1))
    return F.coalesce((obj != "") & (share < threshold), F.lit(False))


def adds_nothing(part: Column, whole: Column, allowed: int = 0) -> Column:
    """Whether a part has at most `allowed` content characters that the whole has not."""
    return F.size(F.array_except(T.content_characters(part), T.content_characters(whole))) <= allowed


def independent_verdict(statement: Column, source: Column, n_facts: Column, suspect: Column) -> Column:
    """What an independent reading says: nearly verbatim, nothing to check (no facts found), suspect or passed."""
    mine, theirs = (F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(T.CJK), 0)) for c in (statement, source))
    verbatim = F.size(F.array_intersect(mine, theirs)) / F.greatest(F.size(mine), F.lit(1))
    return first_match([(verbatim >= 0.9, "grounded-verbatim"), (F.coalesce(n_facts, F.lit(0)) == 0, "not-applicable"), (suspect, "suspect")], "passed")


def apply_reviews(anchors: DataFrame, reviews: DataFrame, overturn_disputed: bool = False, skip_deprecated: bool = False) -> DataFrame:
    """anchors with new_status, reviewedBy and issue. reviews: anchorId, verdict, note, reviewer, seq (the last one counts).

    ok and 成立 confirm if somebody has signed, and do not overturn a dispute unless the policy says so. Any other verdict
    disputes, signed or not (then as teacher:anonymous). skip_deprecated: deprecated anchors stay as they are.
    """
    last = reviews.groupBy(F.col("anchorId").alias("id")).agg(F.max_by(F.struct("verdict", "note", "reviewer"), "seq").alias("_v"))
    j = anchors.join(last, "id", "left")
    name = F.trim(F.coalesce(F.col("_v.reviewer"), F.lit("")))
    verdict = F.coalesce(F.nullif(F.col("_v.verdict"), F.lit("")), F.lit("other"))
    ok = verdict.isin("ok", "成立")
    rules = [(F.col("_v").isNull(), None), (ok & (name == ""), SKIP), (ok & (F.col("reviewStatus") == DISPUTE) & F.lit(not overturn_disputed), SKIP), (ok, CONFIRM)]
    if skip_deprecated:
        rules.insert(1, (F.coalesce(F.col("deprecated"), F.lit(False)), SKIP))
    j = j.withColumn("_o", first_match(rules, DISPUTE))
    changed = F.col("_o").isin(CONFIRM, DISPUTE)
    who = F.concat(F.lit("teacher:"), F.when(name != "", name).otherwise("anonymous"))
    by = F.coalesce("reviewedBy", F.array().cast("array<string>"))
    j = j.withColumn("new_status", F.when(changed, F.col("_o")).otherwise(F.col("reviewStatus"))).withColumn("issue", F.when(F.col("_o") == DISPUTE, verdict))
    return j.withColumn("reviewedBy", F.when(changed & ~F.array_contains(by, who), F.concat(by, F.array(who))).otherwise(F.col("reviewedBy"))).drop("_v", "_o")


def missing_keys(reviews: DataFrame, anchors: DataFrame) -> DataFrame:
    return reviews.select(F.col("anchorId").alias("id")).distinct().join(anchors.select("id"), "id", "left_anti")


def gate_over_opinion(status: Column, ok: Column) -> Column:
    """A statement that fails the gate is disputed whatever was said of it."""
    return F.when(~ok, DISPUTE).otherwise(status)


def human_signed(reviewed_by: Column) -> Column:
    return F.exists(reviewed_by, lambda r: ~r.startswith("ai:"))


def course_required(course: Column, policy: str = "strict", grade: int | None = None) -> Column:
    """必修 is required. lenient: where no type is known it is, in grades up to 9."""
    unknown = F.coalesce(course, F.lit("")) == ""
    return F.coalesce(course == "必修", F.lit(False)) | (unknown & F.lit(policy == "lenient" and grade is not None and grade <= 9))


def clamp_stage(lo: Column, hi: Column, opens: Column, closes: Column) -> Column:
    """The interval cut to the years in which its discipline is taught; an end that is missing is theirs, and an interval
    that is turned round becomes the first year."""
    ends = [F.greatest(opens, F.least(closes, F.coalesce(x, y))) for x, y in ((lo, opens), (hi, closes))]
    return F.when(ends[1] < ends[0], F.struct(opens.alias("min"), opens.alias("max"))).otherwise(F.struct(ends[0].alias("min"), ends[1].alias("max")))


def accepted_label(type_: Column, strength: Column, signature: Column) -> Column:
    """struct(type, strength, signature) of a proposed edge label as it is taken over; null if it is rejected.

    A convention has its fixed signature and is soft; others need a signature that is long enough and not vague. A strength
    that is unknown becomes soft, and an instrument is never hard.
    """
    from heddle import schema as V

    said = F.trim(F.coalesce(signature, F.lit("")))
    vague = F.exists(F.array(*[F.lit(x) for x in V.VAGUE_SIGNATURES]), lambda x: said.contains(x))
    convention = type_ == "convention"
    hard = F.coalesce((strength == "hard") & ~type_.isin("convention", "instrument"), F.lit(False))
    label = F.struct(type_.alias("type"), F.when(hard, "hard").otherwise("soft").alias("strength"), F.when(convention, V.CONVENTION_SIGNATURE).otherwise(said).alias("signature"))
    return F.when(type_.isin(*V.EDGE_TYPES) & (convention | ((F.length(said) >= V.SIGNATURE_MIN) & ~vague)), label)


def informative_evidence(evidence: Column) -> Column:
    """Evidence without entries that only say that two equal stages are in order."""
    return F.filter(evidence, lambda e: ~F.coalesce(e["detail"].rlike(r"(G(?:1[0-2]|[1-9]))\s*(?:→|->|≤|<=)\s*\1(?![0-9])"), F.lit(False)))


def first_verb(s: Column, verbs: tuple[str, ...]) -> Column:
    """The verb that stands first in a text (the earlier of the list where two begin at one place)."""
    hits = F.filter(F.array(*[F.struct(F.instr(s, F.lit(v)).alias("at"), F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in enumerate(verbs)]), lambda x: x["at"] > 0)
    return F.array_min(hits)["v"]
