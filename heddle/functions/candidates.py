"""What a candidate's words say of it: type, level, track, propositions, circular and invented statements, predicate use, audits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators.rules import first_match

# Fixed values of the classifiers.
TRACKS = {"DAG": ("数学", "物理", "化学"), "LIST": ("语文", "英语"), "MATRIX": ("科学", "生物学", "历史", "地理", "道德与法治", "信息科技", "劳动", "艺术", "体育与健康")}
TYPE_VERBS = {
    "PROCEDURAL": ("计算", "口算", "笔算", "心算", "演算", "估算", "换算", "测量", "称量", "求解", "化简", "制作", "搭建", "组装", "拆装", "连接", "操作", "演示", "绘制", "画出", "书写", "默写", "演奏", "演唱", "表演", "仿写", "临摹", "投掷", "传接", "运球", "起跳", "游泳", "滚翻"),
    "REPRESENTATIONAL": ("标出", "标注", "圈出", "连线", "补全", "填出", "列出", "呈现", "表示"),
    "LANGUAGE": ("朗读", "诵读", "默读", "跟读", "认读", "拼读", "组词", "造句", "摘抄", "翻译", "听写"),
    "META": ("反思", "评价", "规划", "监控", "调节"),
}
LEVEL_WORDS = (("熟练", "应用"), ("运用", "应用"), ("应用", "应用"), ("解决", "应用"), ("说明", "理解"), ("解释", "理解"), ("描述", "理解"), ("比较", "理解"), ("说出", "了解"), ("列举", "了解"))
ABOUT_THE_DOCUMENT = (
    "本?课程内容", "本课程", "课程标准", "本标准", "课程目标", "本学段设置", "教学中", "教学应", "教材编写", "评价建议", "学业质量标准", "课时", "板块", "学习主题", "课程的?主要线索", "义务教育课程", "占总课时", "学段目标", "课程性质", "课程理念", "教学提示", "学业要求是",
    "页码是", "………", "根本遵循", "重要论述", "修订", "指导思想", r"附录\d", "内容模块", "任务群", "侧重在", "学段侧重", "模块包括", r"设置\d+个", r"安排\d+个", r"^\d+\s*[~～-]\s*\d+\s*年级", "第[一二三四]学段的?(内容|跨学科)", "跨学科主题是",
)
PROPOSITION = r"[^，。；]{2,}是[^，。；]{2,}|《[^》]+》|\d"
HOLLOW = r"是(必要|重要|有益|有用|有意义|有价值|关键|核心|基础)的?\z|很重要\z|不可或缺\z"
TOPIC_TAILS = ("基本常识和?要求", "常识", "知识", "内容", "要求", "方法", "过程", "特点", "意义", "作用", "影响", "关系", "表现", "途径", "措施")
CIRCULAR_STOP = "的了和与及或在中对能会把被为是有个之其等这那所以并且但"
ABSTRACT_NOUNS = ("意义", "作用", "目的", "价值", "危害", "好处", "特点")
NOUN_ENDINGS = ("原则", "方法", "方式", "能力", "意识", "观念", "素养", "过程", "活动", "作品", "成果", "者", "类别", "要素", "定义", "规律", "思路", "理念", "技法", "技能", "水平", "领域", "环节", "阶段", "工具", "手段")
PASSIVE_LEADS = ("经过", "所", "被", "受", "加以", "得到", "进行了")
TEACHER = ("教学重点", "教学建议", "教学提示", "教学策略", "本学习任务", "本任务", "引导学生", "组织学生", "指导学生", "鼓励学生", "帮助学生", "教师应", "教师可", "教师要", "建议教师", "可安排", "应安排")
# Fixed values of the audits: no standard answer, talk as a source, a use made a definition, notes on the course's order,
# judgements and their words, measures, named grades.
NO_ANSWER = "(是什么样的|有哪些|怎么样|如何[^，。]{0,6}\\z|应该是)"
DISCUSSION = "讨论|探讨|交流|说一说|想一想|议一议"
TOOL_DEFINITION = "是(进行|用于|用来|开展)[^，。]{2,}的(平台|工具|方式|方法|途径|手段)"
COURSE_ORDER = r"\d\s*[~～-]\s*\d\s*年级(注重|主要|侧重)|注重让学生|经历一系列"
JUDGEMENT = "的(作用|目的|意义|功能|价值|特点|本质|定义)是"
JUDGEMENT_SOURCE = "作用|目的|意义|功能|价值|特点|本质|定义"
MEASURE = r"\d+\s*(万?词|字|篇|次|分钟|米|秒|个左右)以?上?|不少于|累计达到|每分钟|总量"
NAMED_GRADES = r"(\d)\s*[~～-]\s*(\d)\s*年级|第([一二三四])学段"
COURSE_PLAN = "开设|选项|学习任务为|主要满足|依托|每位学生至少|课时|学段设置"

_any = "|".join


def anchor_type(verb: Column) -> Column:
    return first_match([(verb.isin(*v), k) for k, v in TYPE_VERBS.items()], "CONCEPTUAL")


def cognitive_level(statement: Column) -> Column:
    return first_match([(statement.contains(w), level) for w, level in LEVEL_WORDS], "掌握")


def track(discipline: Column) -> Column:
    return first_match([(discipline.isin(*v), k) for k, v in TRACKS.items()])


def about_the_document(statement: Column) -> Column:
    return statement.rlike(f"({_any(ABOUT_THE_DOCUMENT)})")


def is_proposition(statement: Column) -> Column:
    """Whether a rewritten statement asks something that has a standard answer."""
    return ~statement.rlike(rf"(的?({_any(TOPIC_TAILS)}))\z") & ~statement.rlike(HOLLOW) & statement.rlike(PROPOSITION)


def circular(statement: Column, share: float = 0.75) -> Column:
    """Whether what is said of the subject is the subject again."""
    body = T.without_first(statement, F.lit("能说出"))
    side = lambda k: T.content_characters(F.regexp_extract(body, r"^(.{4,}?)是(.{4,})\z", k), CIRCULAR_STOP)
    return F.coalesce(T.overlap_of_smaller(side(1), side(2)) >= share, F.lit(False))


def invented_relation(statement: Column, source: Column) -> Column:
    """Whether a statement makes a judgement of what the source only puts side by side."""
    noun = F.regexp_extract(statement, f"的({_any(ABSTRACT_NOUNS)})是(.{{3,}})", 1)
    return F.coalesce((noun != "") & source.rlike(f"({_any(ABSTRACT_NOUNS)})[，,、]") & F.exists(F.regexp_extract_all(source, F.lit(f"({_any(ABSTRACT_NOUNS)})[，,、]"), 1), lambda x: x == noun), F.lit(False))


def predicate_use(source: Column, verb: str) -> Column:
    """Whether a verb is a predicate somewhere in a source, and not part of a noun, passive or attributive."""
    free = f"(?<!{_any(PASSIVE_LEADS).replace('|', ')(?<!')}){verb}(?!{_any(NOUN_ENDINGS)})"
    return source.rlike(rf"{free}(?!的|\z)") | source.rlike(rf"(?:(?<=[能会要需应][^，。；]{{0,4}})|(?<=尝试|学会|初步|[，。；：、（(])|(?<=\A)){free}(?!的\z)")


def for_teachers(source: Column) -> Column:
    return source.rlike(_any(TEACHER))


def suspect_outcome(statement: Column, source: Column, n_facts: Column) -> Column:
    """What becomes of a statement that independent reading doubts: `drop: ` and the bad pattern, downgrade or queue.

    Where the reading found facts of its own the doubt is weak, and people are asked (queue). Without any, a pattern that a
    rule can name is dropped, and any other statement leaves the usable ones (downgrade). A null source is empty.
    """
    src = F.coalesce(source, F.lit(""))
    return first_match(
        [
            (F.coalesce(n_facts, F.lit(0)) > 0, "queue"),
            (circular(statement), "drop: circular"),
            (statement.rlike(NO_ANSWER) | src.rlike(DISCUSSION), "drop: no standard answer"),
            (statement.rlike(TOOL_DEFINITION), "drop: use made a definition"),
            (invented_relation(statement, src), "drop: invented relation"),
            (statement.rlike(COURSE_ORDER), "drop: order of the course"),
        ],
        "downgrade",
    )


def content_audit(statement: Column, source: Column, lo: Column, hi: Column) -> Column:
    """struct(finding, min, max) of an anchor from curriculum text: invented, measure, course plan, or stage with the grades
    that the statement names where they are not lo and hi (a missing stage is left alone); null where nothing is found."""
    named = lambda k: F.regexp_extract(statement, NAMED_GRADES, k)
    band = F.when(named(3) != "", T.stage_band(F.concat(F.lit("第"), named(3), F.lit("学段"))))
    first, last = (F.coalesce(band[k], named(i).try_cast("int")) for k, i in (("min", 1), ("max", 2)))
    grades = statement.rlike(NAMED_GRADES)
    finding = first_match(
        [
            (statement.rlike(JUDGEMENT) & ~F.coalesce(source, F.lit("")).rlike(JUDGEMENT_SOURCE), "invented"),
            (statement.rlike(MEASURE), "measure"),
            (grades & statement.rlike(COURSE_PLAN), "course plan"),
            (grades & lo.isNotNull() & hi.isNotNull() & ((lo != first) | (hi != last)), "stage"),
        ]
    )
    stage = finding == "stage"
    return F.when(finding.isNotNull(), F.struct(finding.alias("finding"), F.when(stage, first).alias("min"), F.when(stage, last).alias("max")))
