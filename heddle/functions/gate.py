"""The decidability gate: can a statement be answered for one child at one time? A column of (ok, verb, reasons)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.text import trimmed

# Fixed values of the gate, in their order; of equal words the first counts.
ACTION_VERBS = (
    "说出", "讲出", "复述", "朗读", "背诵", "默写", "写出", "写下", "抄写", "听写", "指出", "推测", "提出", "数出", "读出", "认读", "拼读", "翻译", "转述", "概括", "归纳", "提取", "复现",
    "画出", "标出", "标注", "圈出", "连线", "补全", "填出", "绘制", "制作", "搭建", "演示", "操作", "算出", "计算", "求解", "化简", "求出", "估算", "换算", "测量", "称量", "读数",
    "口算", "笔算", "心算", "演算", "推算", "数数", "清点", "诵读", "默读", "跟读", "书写", "组词", "造句", "摘抄", "标点", "表达", "表示", "呈现", "陈述", "概述", "交流", "讨论", "汇报", "讲述", "提问", "质疑",
    "探索", "收集", "整理", "归类", "命名", "标记", "记录", "实验", "尝试", "完成", "比较", "排序", "分类", "辨认", "识别", "区分", "选择", "判断", "匹配", "对应", "检验", "验证",
    "解释", "说明", "论证", "证明", "举例", "举出", "描述", "分析", "推断", "预测", "推理", "评价", "应用", "运用", "使用", "改写", "修改", "纠正", "订正", "设计", "规划", "解决",
    "列出", "列举", "连接", "组装", "拆装", "搭配", "调节", "控制", "处理", "仿写", "临摹", "模仿", "创编", "编排", "演奏", "演唱", "表演", "朗诵", "讲解",
    "保护", "帮助", "配合", "合作", "参与", "遵守", "执行", "维护", "清洁", "投掷", "传接", "运球", "起跳", "跑动", "游泳", "攀爬", "滚翻", "支撑", "摆动",
)
VAGUE_HEADS = ("能力", "素养", "意识", "精神", "观念", "态度", "兴趣", "习惯", "思想", "情感", "品格", "价值观")
SLOGAN_VERBS = ("培养", "提高", "增强", "树立", "形成", "激发", "发展", "养成", "具有", "具备", "提升")
CHAPTER_TAILS = ("的意义", "的概念", "的认识", "的理解", "的性质", "的应用", "的特点", "的分类", "简介", "初步认识")
WEAK_VERBS = ("了解", "知道", "认识", "感受", "体会", "体验", "欣赏", "培养", "树立", "形成", "增强", "提高", "激发")
ABSTRACT_TAILS = (
    "重要性", "必要性", "意义", "作用", "价值", "影响", "道理", "内涵", "精神", "情怀", "观念", "意识", "素养", "能力", "思想感情", "重要作用", "深远影响", "关系", "联系", "优越性", "优势", "本质", "规律性", "一般规律",
)
FRAGMENT_TAILS = ("的角度", "的基础上", "的前提下", "的情况下", "过程中")
SINGLE_VERBS = "认读写画量摆拼剪贴算说数比排分"
WEAK_LEADS = ("懂得", "知道", "了解", "认识到", "认识", "体会", "感受", "意识到", "明白")
POINTERS = ("这些", "这类", "这几", "上述", "该类", "其中的", "此类")
NO_PRONOUN = ("其他", "其它", "其次", "其余", "尤其", "极其", "与其", "及其", "其间", "何其")
NUMERALS = "一二三四五六七八九十百千万0-9"

_any = "|".join
SYNTHETIC = "说出"


def _contains(s: Column, words: tuple[str, ...]) -> Column:
    return s.rlike(_any(words))


def _first(s: Column, words: tuple[str, ...], before: str = "", after: str = "") -> Column:
    """The first of the list (not of the text) that occurs in this context; null if none."""
    out = F.when(s.rlike(before + words[0] + after), words[0])
    for w in words[1:]:
        out = out.when(s.rlike(before + w + after), w)
    return out


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(s) + F.length(F.regexp_replace(s, "[\\x{0000}-\\x{FFFF}]", ""))


def decidable(statement: Column) -> Column:
    """struct(ok, verb, reasons): reasons are codes, with what they refer to after a colon."""
    s = trimmed(F.coalesce(statement, F.lit("")))
    # All verbs have two characters, so the longest that is used as a predicate is the first of the list that is.
    plain = _first(s, ACTION_VERBS, after="(?!的)")
    listed = F.substring(F.nullif(F.regexp_extract(s, rf"[能会]((?:[{SINGLE_VERBS}][、,，])+[{SINGLE_VERBS}])", 1), F.lit("")), 1, 1)
    concrete = s.rlike(r"[^，。；]{2,}是[^，。；]{2,}") | s.rlike(r"《[^》]+》") | s.rlike("[0-9]")
    found = F.coalesce(plain, listed)
    askable = found.isNull() & s.rlike("^[^，。；]{0,4}?(知道|了解)") & ~_contains(s, ABSTRACT_TAILS) & concrete
    verb = F.coalesce(found, F.when(askable, SYNTHETIC))
    at = F.instr(s, verb)
    lead = F.nullif(F.regexp_extract(s, rf"^[^，。；]{{0,4}}?({_any(WEAK_LEADS)})", 1), F.lit(""))
    knows = lead.rlike("^(知道|了解)")
    tail = _first(s, ABSTRACT_TAILS)
    slogan = F.nullif(F.regexp_extract(s, rf"({_any(SLOGAN_VERBS)})[^，。]{{0,10}}({_any(VAGUE_HEADS)})", 0), F.lit(""))
    after = F.regexp_replace(F.substring(s, at + F.length(verb), F.length(s)), r"(?U)[，。、；：？！\s]", "")
    pointer = F.nullif(F.regexp_extract(s, f"({_any(POINTERS)})", 1), F.lit(""))
    counted = s.rlike(rf"({_any(POINTERS)})[^，。]{{0,4}}(的)?[{NUMERALS}]")
    bare = F.regexp_replace(s, "^(能够|能|会|学会)", "")
    # The first pronoun that is none of the exceptions, if neither a quotation mark nor six characters stand before it.
    masked = F.regexp_replace(bare, _any(NO_PRONOUN), "〇〇")
    lead_in = F.regexp_extract(masked, r"^([^它其该此]*)(它们|它|其|该|此)", 1)
    pronoun = F.nullif(F.regexp_extract(masked, r"^([^它其该此]*)(它们|它|其|该|此)", 2), F.lit(""))
    loose = pronoun.isNotNull() & ~lead_in.rlike("[「」『』《》“”‘’\"']") & (F.length(F.regexp_replace(lead_in, r"[^一-鿿〇]", "")) < 6)
    weak_end = F.nullif(F.regexp_extract(s, rf"({_any(WEAK_VERBS)})[^，。；]{{0,12}}\z", 1), F.lit(""))
    code = lambda name, detail=None: F.lit(name) if detail is None else F.concat(F.lit(name + ":"), detail)
    none = verb.isNull()
    reasons = [
        F.when(utf16_length(s) < 8, code("too-short")),
        F.when(utf16_length(s) > 60, code("too-long")),
        F.when(none, code("no-observable-verb")),
        *[F.when(s.endswith(t), code("chapter-title", F.lit(t))) for t in CHAPTER_TAILS],
        *[F.when(s.endswith(t), code("fragment", F.lit(t))) for t in FRAGMENT_TAILS],
        *[F.when(none & s.contains(h), code("vague-head", F.lit(h))) for h in VAGUE_HEADS],
        F.when(slogan.isNotNull(), code("slogan", slogan)),
        F.when(lead.isNull() | (F.coalesce(knows, F.lit(False)) & F.coalesce(verb == SYNTHETIC, F.lit(False))), F.lit(None)).when(knows & tail.isNotNull(), code("abstract-object", tail)).when(knows, code("no-fact", lead)).otherwise(code("weak-lead", lead)),
        F.when(none & _contains(s, WEAK_VERBS), code("weak-verb", _first(s, WEAK_VERBS))),
        F.when(found.isNotNull() & (utf16_length(after) < 2), code("no-object")),
        F.when(pointer.isNotNull() & ~counted, code("dangling-pointer", pointer)),
        F.when(loose, code("dangling-pronoun", pronoun)),
        F.when(weak_end.isNotNull() & found.isNotNull() & (at < F.instr(s, weak_end)), code("weak-predicate", weak_end)),
        F.when(F.length(F.regexp_replace(s, "[^、，]", "")) >= 3, code("too-many-items")),
    ]
    all_ = F.array_compact(F.array(*reasons))
    return F.struct((F.size(all_) == 0).alias("ok"), verb.alias("verb"), all_.alias("reasons"))
