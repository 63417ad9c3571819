"""Text functions as column expressions; NFKC, sequence ratio and blake2s as Arrow UDFs, as Spark has none of them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

CJK = "[\\u4e00-\\u9fff]"
WIDE = "[\\u4e00-\\u9fff\\u3000-\\u303f]"
# Fixed values of the normal form: look-alikes, and half-width marks with their full-width forms.
LOOK_ALIKES = {"‧": "·", "•": "·", "―": "—", "─": "—", "“": '"', "”": '"', "‘": "'", "’": "'"}
FULL_WIDTH = {",": "，", ";": "；", ":": "：", "?": "？", "!": "！", "<": "《", ">": "》"}
SIGNATURE_MARKS = r"（）《》「」【】，。、；：？！\"'·—"
#: Three stop lists for content characters; callers choose.
STOP_MERGE = "的了和与及或在是有能会把用从对将为等其这那一个中上下"
MODAL = r"^(能够|能|会|学会)"
# Running heads and page numbers, labels, verbs, openers and noise around requirements, names of grades.
RUNNING_HEAD = "普\\s*通\\s*高\\s*中[^）]{0,24}课\\s*程\\s*标\\s*准\\s*（?\\s*2\\s*0?\\s*1?\\s*7?[^）]{0,20}）?"
PAGE_NUMBER = "^\\s*(\\d{1,3}|[│|]\\s*.{0,20}\\s*[│|])\\s*$"
COURSE_LABELS = (
    "选择性必修", "选修", "必修", "理解性技能", "表达性技能", "元认知策略", "认知策略", "交际策略", "情感管理策略", "资源策略",
    "语言知识", "文化知识", "学习策略", "语言技能", "主题", "语篇", "听", "说", "读", "写", "译", "看",
)
REQUIREMENT_VERBS = (
    "了解", "知道", "理解", "认识", "掌握", "会", "能", "运用", "应用", "说明", "解释", "描述", "分析", "比较", "判断", "设计", "制作",
    "操作", "探究", "计算", "测量", "表达", "交流", "评价", "举例", "列举", "识别", "归纳", "论证", "感受", "体会", "说出", "指出",
)
OPENERS = (
    "能", "会", "通过", "根据", "在", "用", "利用", "结合", "尝试", "初步", "正确", "独立", "主动", "积极", "进一步", "学会", "熟悉", "关注", "养成",
    "选择", "收集", "整理", "观察", "发现", "完成", "参与", "合作", "遵守", "针对", "围绕", "以", "从", "对", "把", "将", "借助",
)
SPLIT_VERBS = ("能", "会", "可以", "理解", "掌握", "知道", "了解", "说出", "描述", "解释", "计算", "比较", "判断", "运用", "应用", "设计", "制作", "识别", "区分", "归纳", "分析")
GLUE_VERBS = ("根据", "用", "在", "通过", "结合", "借助", "选择", "利用", "运用")
NUMBERED_VERBS = ("列举", "概述", "举例", "说明", "描述", "分析", "比较", "关注", "注重", "根据", "理解", "掌握", "运用", "设计", "制作", "能", "会")
LEAD_NOISE = "^(?:[\\s·•●○◇\\-—]|[）)]|[（(]\\s*[^）)]{0,40}[）)]|\\d+(?:\\.\\d+)*\\s*[-–.、)]|\\d{1,2}(?=(?:" + "|".join(NUMBERED_VERBS) + ")))+\\s*"
BLOCK_MARK = "^【[^】]{2,8}】\\s*"
FORMULA = "\\$([^$]{1,30})\\$"
SLOGAN = "[，,]?(?:形成|发展|增强|提高|培养|感悟|体会|养成|逐步形成)[^，。；]*(?:意识|观念|能力|素养|精神|态度|习惯)。?$"
GRADE_WORDS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "高一", "高二", "高三")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _sub(c: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, to in pairs:
        c = F.regexp_replace(c, pattern, to)
    return c


def trimmed(c: Column) -> Column:
    """Without white space of any script, and without byte-order marks, at both ends."""
    return _sub(c, (r"(?U)^[\s﻿]+|[\s﻿]+\z", ""))


def normalized_once(c: Column, latin: bool | Column = False) -> Column:
    """One pass of the normal form, of text that is in NFKC already."""
    blanks = lambda x: trimmed(_sub(x, (r"[​-‍﻿ ]", ""), (r"(?U)[\s﻿]+", " ")))
    plain = blanks(c)
    is_latin = (latin if isinstance(latin, Column) else F.lit(latin)) | (~c.rlike(CJK) & c.rlike("[A-Za-z]"))
    s = _sub(plain, (rf"(?<={CJK})(?U)\s+(?={CJK})", ""))
    for a, b in LOOK_ALIKES.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    for a, b in FULL_WIDTH.items():
        s = _sub(s, (rf"(?<![0-9A-Za-z+\-*/=]){re.escape(a)}(?![0-9A-Za-z])", b))
    s = _sub(
        s,
        ("[.。・]{3,}", "……"), ("…{2,}", "……"), ("…+[.。]+", "……"), ("[.。]+…+", "……"),
        (r"(?<![0-9A-Za-z.…])\.(?![0-9A-Za-z.…])", "。"),
        (rf"(?<={WIDE})\(", "（"), (rf"\)(?={WIDE})", "）"), (rf"\((?={WIDE})", "（"), (rf"(?<={WIDE})\)", "）"),
        (r"（([^（）()]*)\)", "（$1）"), (r"\(([^（）()]*)）", "（$1）"),
        (r"[。．.]+\z", ""),
    )
    return F.when(is_latin, plain).otherwise(s)


def normalized(c: Column, latin: bool | Column = False, rounds: int = 4) -> Column:
    """The fixpoint of the normal form: up to `rounds` passes (a pass need not be the last one).

    What a pass reads is the variable of a lambda: written out, each pass would repeat all passes before it four times.
    """
    for _ in range(rounds):
        c = F.get(F.transform(F.array(nfkc(c)), lambda x: normalized_once(x, latin)), F.lit(0))
    return c


def is_stable(c: Column, latin: bool | Column = False) -> Column:
    """Whether another pass changes nothing."""
    return normalized_once(nfkc(c), latin).eqNullSafe(c)


def unnormalized(fields: list[str]) -> Column:
    """Structs (field, raw, normalized) of the fields that are not in normal form."""
    each = [F.when(F.col(f).isNotNull() & (normalized(F.col(f)) != F.col(f)), F.struct(F.lit(f).alias("field"), F.col(f).alias("raw"), normalized(F.col(f)).alias("normalized"))) for f in fields]
    return F.array_compact(F.array(*each))


def without_first(s: Column, part: Column) -> Column:
    """s without the first occurrence of part."""
    at = F.instr(s, part)
    return F.when((part != "") & (at > 0), F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + F.length(part), F.length(s)))).otherwise(s)


def signature(discipline: Column, verb: Column, statement: Column) -> Column:
    """discipline|verb|statement without its modal beginning and the first occurrence of each part of the verb."""
    marks = rf"(?U)[{SIGNATURE_MARKS}\s]"
    clean = lambda x: F.lower(_sub(normalized(F.coalesce(x, F.lit(""))), (marks, "")))
    rest = _sub(F.coalesce(statement, F.lit("")), (MODAL, ""))
    parts = F.split(F.coalesce(verb, F.lit("")), r"[.．…]{2,}")
    rest = F.aggregate(F.transform(parts, lambda p: _sub(p, (marks, ""))), rest, lambda acc, p: without_first(acc, p))
    return F.concat_ws("|", F.coalesce(discipline, F.lit("")), clean(verb), clean(rest))


def match_key(c: Column) -> Column:
    return F.lower(_sub(c, (r"(?U)[\s\p{Punct}（）《》「」【】，。、；：？！“”‘’·—…]", "")))


def ambiguous_key(title: Column, first_line: Column, n_same: Column) -> Column:
    """The title's key, with five characters of the text where a title is not unique."""
    return F.when(n_same > 1, F.concat_ws("|", match_key(title), F.substring(match_key(first_line), 1, 5))).otherwise(match_key(title))


def vote_key(c: Column) -> Column:
    """Of entries of a word list: lower case, single blanks, none around brackets and slashes, no stars at the end.

    What brackets hold stays: `colour (AmE color)` and `colour(AmE color)` are one entry.
    """
    tight = _sub(F.lower(trimmed(c)), (r"(?U)\s+", " "), (r"\s*([(（/])\s*", "$1"), (r"\s*([)）])", "$1"), (r"[*＊ ]+\z", ""))
    return trimmed(tight)


def comparison_key(c: Column) -> Column:
    """Of transcripts: without blanks, ASCII marks as full-width ones, no stop at the end."""
    return _sub(F.translate(_sub(c, (r"(?U)\s+", "")), ",;:().", "，；：（）。"), ("[。；]+\\z", ""))


def half_width(c: Column) -> Column:
    """Full-width digits, letters, stop and blank as ASCII, private-use characters gone; other marks stay."""
    ascii_ = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz."
    full = "".join(chr(ord(x) + 0xFEE0) for x in ascii_)
    return _sub(F.translate(c, full + "\u3000\u2003", ascii_ + "  "), ("[\ue000-\uf8ff]", ""))


def page_lines(c: Column) -> Column:
    """Lines of a page as an array, in half width; running heads go wherever they stand, and lines of a page number only."""
    each = F.transform(F.split(c, "\n"), lambda x: trimmed(_sub(half_width(x), (RUNNING_HEAD, ""))))
    return F.filter(each, lambda x: (x != "") & ~x.rlike(PAGE_NUMBER))


def sentences(c: Column) -> Column:
    """Sentences with their final marks."""
    return F.filter(F.transform(F.split(c, "(?<=[。？！；])"), lambda x: trimmed(x)), lambda x: x != "")


def clauses(c: Column, verbs: tuple[str, ...]) -> Column:
    """Parts of a requirement: cut after a comma that a requirement verb follows."""
    return F.filter(F.split(c, "(?<=，)(?=(?:" + "|".join(map(re.escape, verbs)) + "))"), lambda x: x != "")


def labels_stripped(c: Column) -> Column:
    """Without course types, skill labels and numbers glued to the beginning, however many there are."""
    return trimmed(_sub(c, (r"(?U)^(?:" + "|".join(COURSE_LABELS) + r"|\d+\s*[.．、]|[：:，、 ]|\s)+", "")))


def leading_tags(c: Column, vocabulary: tuple[str, ...]) -> Column:
    """struct(rest, tags): the vocabulary's words in a bracket at the beginning, and the text after it.

    A bracket without any of them is part of the text.
    """
    s = trimmed(c)
    bracket = F.regexp_extract(s, "^([（(][^）)]{2,40}[）)])", 1)
    tags = F.filter(F.array(*[F.lit(v) for v in vocabulary]), lambda v: bracket.contains(v))
    return F.when(F.size(tags) > 0, F.struct(trimmed(F.substring(s, F.length(bracket) + 1, F.length(s))).alias("rest"), tags.alias("tags"))).otherwise(F.struct(c.alias("rest"), tags.alias("tags")))


def object_after(statement: Column, verb: Column, most: int = 40, both_ends: bool = False) -> Column:
    """What follows the verb (the whole statement without one, or with nothing after it), cut to `most` characters.

    Particles and commas at its beginning go; both_ends: marks and blanks at either end go instead.
    """
    at = F.instr(statement, verb)
    rest = F.when(at > 0, F.substring(statement, at + F.length(verb), F.length(statement))).otherwise(statement)
    if both_ends:
        rest = F.when(at > 0, _sub(rest, ("^[，。；、 ]+|[，。；、 ]+\\z", ""))).otherwise(rest)
    else:
        rest = trimmed(_sub(rest, ("^[的地得，,、]+", "")))
    return F.substring(F.when(rest != "", rest).otherwise(statement), 1, most)


def opens_well(c: Column) -> Column:
    """Whether a requirement begins with a word that one may begin with (and not in the middle of a word)."""
    return c.rlike("^(?:" + "|".join(REQUIREMENT_VERBS + OPENERS) + ")")


def requirements(c: Column) -> Column:
    """The single requirements of a sentence as an array: cut at semicolons, before verbs after a comma, and where two are
    glued together; marks, numbers and whole brackets before them and slogans after them go, and parts of under 6 characters."""
    edges = lambda x: _sub(x, ("^[ ，,。]+|[ ，,。]+\\z", ""))
    verbs = "|".join(SPLIT_VERBS)
    cut = F.split(_sub(trimmed(c), ("。+\\z", "")), f"[；;]|(?<=[，,])(?=(?:{verbs})[^，。；]{{2,}})|(?<=[一-龥]{{2}})(?=(?:能|会)(?:{'|'.join(GLUE_VERBS)})[^，。；]{{2,}})")
    bare = lambda x: edges(_sub(edges(x), (BLOCK_MARK, ""), (FORMULA, "$1"), (LEAD_NOISE, ""), (SLOGAN, "")))
    return F.filter(F.transform(cut, bare), lambda x: F.length(x) >= 6)


def with_can(c: Column) -> Column:
    return F.when(c.rlike("^[能会]"), c).otherwise(F.concat(F.lit("能"), c))


def cut(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def filled(template: Column, name: str, value: Column) -> Column:
    return F.replace(template, F.lit("{{" + name + "}}"), value)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def content_characters(c: Column, stop: str = STOP_MERGE) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(c, F.lit(CJK), 0)), F.array(*[F.lit(x) for x in stop]))


def tokens(c: Column) -> Column:
    """Distinct letters, digits and CJK characters."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[\\u4e00-\\u9fff0-9a-zA-Z]"), 0))


def coverage(x: Column, y: Column) -> Column:
    """Share of the set x that is in y; null for an empty x."""
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))


def jaccard(x: Column, y: Column) -> Column:
    return F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def overlap_of_smaller(x: Column, y: Column) -> Column:
    return F.when(F.least(F.size(x), F.size(y)) > 0, F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def grade_number(c: Column) -> Column:
    """1 to 12 of G6, g6, 6; null otherwise."""
    n = F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"^\s*[Gg]?(1[0-2]|[1-9])\s*\z", 1)
    return n.try_cast("int")


def number_at_end(c: Column) -> Column:
    """The number that a position key such as `@7@10` ends with, for sorting; 0 without one."""
    return F.coalesce(F.regexp_extract(c, r"(\d+)\z", 1).try_cast("long"), F.lit(0))


def stage_band(c: Column) -> Column:
    """struct(min, max) of the band in which a stage named as G3-5, 第N学段 or a~b年级 begins; null for others."""
    s = trimmed(c)
    bands = {1: (1, 2), 3: (3, 4), 5: (5, 6), 7: (7, 9)}
    band = lambda k: F.struct(*[F.lit(x).alias(n) for x, n in zip(bands[k], ("min", "max"), strict=True)])
    plain = F.regexp_extract(s, r"^G?(\d)\s*[-~～]\s*G?\d\z", 1)
    named, years = F.regexp_extract(s, "第([一二三四])学段", 1), F.regexp_extract(s, r"(\d)\s*[~～-]\s*\d\s*年级", 1)
    first = F.regexp_extract(s, r"第[一二三四]学段|\d\s*[~～-]\s*\d\s*年级", 0).startswith("第")
    out = F.when((plain != "") & (plain == "0"), None)
    for k, (lo, hi) in bands.items():
        out = out.when((plain >= str(lo)) & (plain <= str(hi)) & (plain != ""), band(k))
    for k, word in zip(bands, "一二三四", strict=True):
        out = out.when((plain == "") & first & (named == word), band(k)).when((plain == "") & ~first & (years == str(k)), band(k))
    return out


def stage_words(lo: Column, hi: Column) -> Column:
    """A stage in words for people: 三年级, 全学段, 三到四年级, 高一–高二年级; 学段未定 without both ends."""
    word = lambda n: F.coalesce(F.element_at(F.array(*[F.lit(x) for x in GRADE_WORDS]), F.when(n.between(1, 12), n)), n.cast("string"))
    return (
        F.when(lo.isNull() | hi.isNull(), "学段未定").when(lo == hi, F.concat(word(lo), F.lit("年级"))).when((lo == 1) & (hi == 9), "全学段")
        .when(hi <= 9, F.concat(word(lo), F.lit("到"), word(hi), F.lit("年级"))).otherwise(F.concat(word(lo), F.lit("–"), word(hi), F.lit("年级")))
    )


def first_section(title: Column, table: list[tuple[str, str]]) -> Column:
    """The section of the first pattern that a title matches."""
    out = F.when(title.rlike(table[0][0]), table[0][1])
    for p, name in table[1:]:
        out = out.when(title.rlike(p), name)
    return out


def salvaged(raw: Column, schema: str, keys: list[str]) -> Column:
    """from_json, or, of broken JSON, what string values of the keys can be found."""
    rest = F.struct(*[F.nullif(F.regexp_extract(raw, rf'"{k}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit("")).alias(k) for k in keys])
    whole = F.from_json(raw, schema)
    return F.coalesce(F.when(F.coalesce(*[whole[k] for k in keys]).isNotNull(), F.struct(*[whole[k].alias(k) for k in keys])), rest)


def first_json(c: Column, schema: str) -> Column:
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema)


def error_code(c: Column) -> Column:
    return F.regexp_extract(c, r"\b([FW]\d{3})\b", 1)


def hash_prefix(c: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


@F.pandas_udf(StringType())
def _number_tail(s: pd.Series) -> pd.Series:
    import hashlib

    return s.map(lambda x: hashlib.blake2s(x.encode(), digest_size=3).hexdigest()[:5].upper())


def document_number(student: Column, title: Column, stage: Column, issued_on: Column) -> Column:
    """DZ-yymmdd-xxxxx: the day, and five digits that the same work always gets."""
    seed = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (student, title, stage)])
    return F.concat(F.lit("DZ-"), F.substring(F.replace(issued_on, F.lit("-"), F.lit("")), 3, 100), F.lit("-"), _number_tail(seed))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity (not edit distance)."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def json_values(json: Column) -> Column:
    """A JSON value as an array of strings: an array's elements, a scalar alone; none for null, false, 0 and an empty string."""
    one = F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")
    many = F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))
    return F.when(json.rlike(r"^\s*\["), many).when(F.coalesce(one, F.lit("")).isin("", "false", "0"), F.array().cast("array<string>")).otherwise(F.array(one))
