"""Row rules as data: every rule in one scan, with codes, severities and a summary; reference checks as joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rule:
    code: str
    message: str
    broken: Column
    detail: Column | None = None
    severity: str = "error"
    family: str | None = None


@dataclass
class Policy:
    """Families that only report: their errors count as warnings."""

    reporting: set[str] = field(default_factory=set)

    def severity(self, rule: Rule) -> str:
        return "warning" if rule.family in self.reporting else rule.severity


def violations(df: DataFrame, rules: list[Rule], key: str, policy: Policy | None = None, kind: str = "row") -> DataFrame:
    """record_kind, key, code, severity, message, detail: a row for each broken rule; null conditions do not break."""
    policy = policy or Policy()
    hits = [
        F.when(r.broken, F.struct(F.lit(r.code).alias("code"), F.lit(policy.severity(r)).alias("severity"), F.lit(r.message).alias("message"), (r.detail if r.detail is not None else F.lit(None)).cast("string").alias("detail")))
        for r in rules
    ]
    found = df.select(F.lit(kind).alias("record_kind"), F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*hits))).alias("v"))
    return found.select("record_kind", "key", "v.*")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def first_match(cases: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for c, v in cases[1:]:
        out = out.when(c, v)
    return out.otherwise(otherwise)


def dangling(references: DataFrame, known: DataFrame, id: str) -> DataFrame:
    """Distinct ids that are referred to and not there."""
    return references.select(id).filter(F.col(id).isNotNull()).distinct().join(known.select(id), id, "left_anti")


def unambiguous(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and the value of those that have just one."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.countDistinct(value).alias("_n")).filter("_n = 1").drop("_n")


def fallback(df: DataFrame, columns: list[str], default: Column, out: str) -> DataFrame:
    """The first value that is there, and in `origin` the column that it came from."""
    origin = F.when(F.col(columns[0]).isNotNull(), columns[0])
    for c in columns[1:]:
        origin = origin.when(F.col(c).isNotNull(), c)
    return df.withColumn("origin", origin.otherwise("default")).withColumn(out, F.coalesce(*[F.col(c) for c in columns], default))


def in_set(column: str, values: tuple[str, ...]) -> Column:
    """True where a value is there and outside its closed set."""
    return F.col(column).isNotNull() & ~F.col(column).isin(*values)


def set_drift(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """Values that only one of two definitions of a closed set has."""
    return [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]


def required_or_raise(df: DataFrame, known: DataFrame, key: str) -> None:
    """Fails if a key has no entry in the look-up."""
    missing = dangling(df, known, key).limit(20).collect()
    if missing:
        raise KeyError(f"{key} without an entry: {[r[0] for r in missing]}")


def anchor_rules() -> list[Rule]:
    """The row rules of anchors (see schema.py for the closed sets)."""
    from heddle import schema as V
    from heddle.functions import text as T

    lo, hi = T.grade_number(F.col("stageHint.min")), T.grade_number(F.col("stageHint.max"))
    senior = F.coalesce(lo >= 10, F.lit(False))
    fallback_evidence = F.exists("evidence", lambda x: x.rlike(V.FALLBACK_EVIDENCE))
    return [
        Rule("A001", "id has the wrong form", ~F.coalesce(F.col("id").rlike(V.ANCHOR_ID), F.lit(False)), F.col("id")),
        *[Rule(f"A01{k}", f"{c} is outside its closed set", ~F.coalesce(F.col(c).isin(*v), F.lit(False)), F.col(c)) for k, (c, v) in enumerate(V.ENUMS.items())],
        Rule("A020", "no evidence", F.coalesce(F.size("evidence"), F.lit(0)) < 1),
        Rule("A021", "template evidence claims another source", fallback_evidence & (F.coalesce(F.col("evidenceSource"), F.lit("")) != "fallback"), F.col("evidenceSource")),
        Rule("A022", "source says template, evidence is none", (F.col("evidenceSource") == "fallback") & ~fallback_evidence, severity="warning"),
        Rule("A030", "assessment has no placeholder", F.col("assessment").isNotNull() & ~F.col("assessment").rlike(r"\{\{[^}]+\}\}")),
        Rule("A031", "assessment refers to what it does not show", F.col("assessment").rlike(r"(这些|上述|下列|下面)") & ~F.substring_index("assessment", "{{", 1).rlike(r"[：:]")),
        Rule("A040", "more than two literacies", F.size("literacy") > 2),
        Rule("A050", "grade has the wrong form", F.exists(F.array_compact(F.array("stageHint.min", "stageHint.max")), lambda g: ~g.rlike(V.GRADE))),
        Rule("A051", "stage interval is inverted", lo > hi),
        Rule("A052", "course type outside the senior grades", F.col("courseType").isNotNull() & ~senior),
        Rule("A060", "deprecated without successor or reason", F.coalesce("deprecated", F.lit(False)) & F.col("supersededBy").isNull() & (F.coalesce(F.col("dropReason"), F.lit("")) == "")),
        Rule("A061", "successor of a live anchor", ~F.coalesce("deprecated", F.lit(False)) & F.col("supersededBy").isNotNull()),
        Rule("A070", "matrix anchor without dimension", (F.col("track") == "MATRIX") & F.col("dimension").isNull()),
        Rule("A071", "matrix anchor without topic", (F.col("track") == "MATRIX") & F.col("topic").isNull(), severity="warning"),
    ]


def edge_violations(edges: DataFrame, anchors: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Rules of edges that need both ends. edges: anchorId, prerequisiteId, type, strength, failureSignature, inInferenceGraph, reason, evidence, containment."""
    from heddle import schema as V

    end = lambda k: anchors.select(F.col("id").alias(k), F.col("track").alias(f"{k}_track"), F.col("stage_min").alias(f"{k}_min"), F.col("stage_max").alias(f"{k}_max"))
    j = edges.join(end("anchorId"), "anchorId", "left").join(end("prerequisiteId"), "prerequisiteId", "left").withColumn("_key", F.concat_ws("<-", "anchorId", "prerequisiteId"))
    sig = F.coalesce(F.col("failureSignature"), F.lit(""))
    vague = F.exists(F.array(*[F.lit(x) for x in V.VAGUE_SIGNATURES]), lambda x: sig.contains(x))
    specific = (F.length(sig) >= V.SIGNATURE_MIN) & ~vague
    convention = F.col("type") == "convention"
    typed = {"family": "edgeTyping"}
    track_rule = first_match(
        [
            ((F.col("anchorId_track") == "LIST") & F.col("containment").isNull(), "list anchor as dependent"),
            ((F.col("anchorId_track") == "MATRIX") & (F.col("prerequisiteId_track") == "MATRIX") & (F.col("type") == "component"), None),
            ((F.col("anchorId_track") == "MATRIX") & (F.col("strength") == "hard"), "hard edge of a matrix anchor"),
        ]
    )
    rules = [
        Rule("E001", "dependent is missing", F.col("anchorId_track").isNull()),
        Rule("E002", "prerequisite is missing", F.col("prerequisiteId_track").isNull()),
        Rule("E003", "self-loop", F.col("anchorId") == F.col("prerequisiteId")),
        Rule("E010", "strength is outside its closed set", ~F.coalesce(F.col("strength").isin("hard", "soft"), F.lit(False))),
        Rule("E011", "reason is too short", F.length(F.coalesce(F.col("reason"), F.lit(""))) < 6),
        Rule("E012", "no evidence", F.coalesce(F.size("evidence"), F.lit(0)) < 1),
        Rule("F001", "type is missing or outside its closed set", ~F.coalesce(F.col("type").isin(*V.EDGE_TYPES), F.lit(False)), **typed),
        Rule("F002", "convention edge in the inference graph", convention & F.coalesce(F.col("inInferenceGraph"), F.lit(True)), **typed),
        Rule("F003", "convention edge with a failure signature", convention & ~sig.isin("", V.CONVENTION_SIGNATURE), **typed),
        Rule("F004", "failure signature is too short", ~F.coalesce(convention, F.lit(False)) & (F.length(sig) < V.SIGNATURE_MIN), **typed),
        Rule("F005", "failure signature is vague", vague, **typed),
        Rule("E020", "hard edge without a credential", (F.col("strength") == "hard") & ~F.coalesce(F.exists("evidence", lambda e: e["kind"] != "llm"), F.lit(False)) & ~specific),
        Rule("E021", "track rule", track_rule.isNotNull(), track_rule),
        Rule("E022", "prerequisite comes after its dependent", F.col("prerequisiteId_min") > F.col("anchorId_max")),
    ]
    return violations(j, rules, "_key", policy, "edge")


def successor_violations(anchors: DataFrame) -> DataFrame:
    """Successors that are missing or deprecated themselves."""
    target = anchors.select(F.col("id").alias("supersededBy"), F.coalesce("deprecated", F.lit(False)).alias("_dead"))
    j = anchors.filter("supersededBy is not null").join(target, "supersededBy", "left")
    return violations(j, [Rule("A080", "successor is missing", F.col("_dead").isNull(), F.col("supersededBy")), Rule("A081", "successor is deprecated", F.col("_dead"), F.col("supersededBy"))], "id", kind="anchor")


def derived_violations(anchors: DataFrame) -> DataFrame:
    """Rewritten anchors whose source is missing, deprecated, of another type or discipline."""
    source = anchors.select(F.col("id").alias("_from"), F.coalesce("deprecated", F.lit(False)).alias("_dead"), F.col("type").alias("_type"), F.col("discipline").alias("_discipline"))
    j = anchors.withColumn("_from", F.col("provenance.derivedFrom")).filter("_from is not null").join(source, "_from", "left")
    return violations(
        j,
        [
            Rule("A090", "source is missing", F.col("_dead").isNull(), F.col("_from")),
            Rule("A091", "source is deprecated", F.col("_dead"), F.col("_from")),
            Rule("A092", "source is no knowledge anchor", F.col("_type") != "KNOWLEDGE", F.col("_type")),
            Rule("A093", "source is of another discipline", F.col("_discipline") != F.col("discipline"), F.col("_discipline")),
        ],
        "id",
        kind="anchor",
    )


def mapping_violations(mappings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Violations of mappings (key, framework, code, textIncluded, summary, anchorIds): parts that do not make the key, text
    where only codes may be, keys that repeat (detail: by how many rows) and anchors that are not there. anchors: id."""
    parts = ~F.col("key").eqNullSafe(F.concat("framework", F.lit(":"), "code"))
    text = (F.col("textIncluded") == False) & (F.coalesce("summary", F.lit("")) != "")  # noqa: E712
    rows = violations(mappings, [Rule("KEY_PARTS", "key is not framework:code", parts), Rule("CODES_ONLY", "summary beside codes only", text)], "key", kind="mapping")
    found = lambda df, code, message, detail: df.select(F.lit("mapping").alias("record_kind"), "key", F.lit(code).alias("code"), F.lit("error").alias("severity"), F.lit(message).alias("message"), F.col(detail).cast("string").alias("detail"))
    again = mappings.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("again")).filter("again > 0")
    named = mappings.select("key", F.explode("anchorIds").alias("id")).join(anchors.select("id"), "id", "left_anti")
    return rows.union(found(again, "DUPLICATE_KEY", "key repeats", "again")).union(found(named, "DANGLING_ANCHOR", "anchor is not there", "id"))
