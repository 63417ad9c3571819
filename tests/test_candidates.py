from pyspark.sql import functions as F

from heddle.functions import candidates as C


def column(spark, values, f):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, v string" + (", w string" if isinstance(values[0], tuple) else ""))
    return [r["x"] for r in df.select("i", f(*[F.col(c) for c in df.columns[1:]]).alias("x")).orderBy("i").collect()]


def test_types_levels_and_tracks(spark):
    assert column(spark, ["计算", "标出", "朗读", "评价", "说出", None], C.anchor_type) == ["PROCEDURAL", "REPRESENTATIONAL", "LANGUAGE", "META", "CONCEPTUAL", "CONCEPTUAL"]
    assert column(spark, ["能熟练说出", "能说明", "能列举", "能画"], C.cognitive_level) == ["应用", "理解", "了解", "掌握"]
    assert column(spark, ["数学", "语文", "历史", "x"], C.track) == ["DAG", "LIST", "MATRIX", None]


def test_statements_without_an_answer(spark):
    s = ["能说出历史课程内容包括七个板块", "1~2年级侧重在其中选择", "能说出甲骨文是最早的汉字"]
    assert column(spark, s, C.about_the_document) == [True, True, False]
    assert column(spark, ["能说出甲骨文是最早的汉字", "能说出在线技能是必要的", "能说出诗歌的意义", "能说出主题"], C.is_proposition) == [True, False, False, False]
    assert column(spark, ["能说出植物生长过程是植物的生长过程", "能说出长江是中国最长的河流"], C.circular) == [True, False]
    pairs = [("能说出谦让的意义是懂得礼让", "理解谦让的意义，懂得礼让"), ("能说出谦让的意义是懂得礼让", "谦让的意义是懂得礼让"), ("能说出谦让", "意义，x")]
    assert column(spark, pairs, C.invented_relation) == [True, False, False]


def test_predicate_use(spark):
    s = ["能设计一件作品", "说明设计原则", "日常生活用品都是经过设计的", "学会设计", "被设计的产品", "尝试，设计图案"]
    assert column(spark, s, lambda c: C.predicate_use(c, "设计")) == [True, False, False, True, False, True]
    assert column(spark, ["教师应组织活动", "能说出"], C.for_teachers) == [True, False]
