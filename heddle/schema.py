"""Closed sets and record schemas, each defined once."""

from __future__ import annotations

# Fixed values of the data model.
ANCHOR_ID = r"^ca_[A-Za-z0-9]{8}\z"
LIST_ID = r"^lst_[a-z0-9-]{3,40}\z"
GRADE = r"^G(1[0-2]|[1-9])\z"
DISCIPLINES = (
    "语文", "数学", "英语", "物理", "化学", "生物学", "历史", "地理", "道德与法治", "思想政治", "科学", "信息科技", "劳动", "艺术", "体育与健康",
    "信息技术", "通用技术", "音乐", "美术", "日语", "俄语", "德语", "法语", "西班牙语",
)
COURSE_TYPES = ("必修", "选择性必修", "选修")
TRACKS = ("DAG", "LIST", "MATRIX")
TYPES = ("CONCEPTUAL", "PROCEDURAL", "REPRESENTATIONAL", "LANGUAGE", "KNOWLEDGE", "META")
COGNITIVE = ("了解", "理解", "掌握", "应用")
REVIEW = ("llm-proposed", "ai-reviewed", "ai-adjudicated", "auto-confirmed", "expert-confirmed", "disputed")
EDGE_TYPES = ("component", "instrument", "semantic", "convention")
VAGUE_SIGNATURES = ("基础不牢", "基本功不扎实", "能力不足", "理解不深", "知识欠缺", "思维能力差", "学习习惯不好", "掌握不牢", "理解不到位")
SIGNATURE_MIN = 12
CONVENTION_SIGNATURE = "无可观测影响"
FALLBACK_EVIDENCE = r"^(能在.{1,8}(课堂|作业).{0,6}情境中完成：|能完成：)"

ENUMS = {"discipline": DISCIPLINES, "track": TRACKS, "type": TYPES, "cognitive": COGNITIVE, "reviewStatus": REVIEW}

ANCHOR = (
    "id string, discipline string, track string, strand string, topic string, dimension string, statement string, verb string, object string, type string, literacy array<string>, crosscutting array<string>, "
    "practice array<string>, cognitive string, stageHint struct<min:string,max:string>, courseType string, evidence array<string>, assessment string, evidenceSource string, reviewStatus string, "
    "reviewedBy array<string>, deprecated boolean, supersededBy string, dropReason string, provenance struct<srcSubject:string,srcPage:int,srcText:string,method:string,derivedFrom:string,why:string>, schemaVersion string"
)
EDGE = (
    "anchorId string, prerequisiteId string, strength string, type string, failureSignature string, inInferenceGraph boolean, reason string, evidence array<struct<kind:string,detail:string>>, "
    "containment struct<list:string,subset:string>, reviewStatus string, reviewedBy array<string>, retired boolean, schemaVersion string"
)
LIST_ITEM = "listId string, key string, kind string, stage string, level string, seq int, meta map<string,string>, tags array<string>, anchorIds array<string>, source string, schemaVersion string"
MAPPING = "key string, framework string, code string, discipline string, stage string, strand string, title string, summary string, textIncluded boolean, anchorIds array<string>, schemaVersion string"
ASSERTION = "assertionId string, subject string, predicate string, anchorId string, listRef struct<listId:string,key:string>, freeText string, level double, validFrom date, validUntil date, holder string, confidence string, evidence array<string>, supersedes string, sourceApp string, schemaVersion string"
