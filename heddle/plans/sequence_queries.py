"""Queries on votes, gaps, runs, joins with fall-backs, rule checks and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import dedup, metrics, profile, rules
from heddle.operators import sequences as S
from heddle.plans import bindings as B
from heddle.sources.tables import settled, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""WITH n AS (SELECT l_partkey AS part, l_returnflag AS flag, count(*) AS votes FROM lineitem GROUP BY 1, 2)
SELECT part, flag, votes, CAST(sum(votes) OVER (PARTITION BY part) AS BIGINT) AS total FROM n QUALIFY row_number() OVER (PARTITION BY part ORDER BY votes DESC, flag) = 1""")
def vote_mode(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag").toDF("part", "flag")
    return S.mode_with_votes(li, "part", "flag")


@query("""WITH one AS (SELECT DISTINCT l_suppkey AS supp, lower(l_returnflag || '.' || l_linestatus) AS key, l_returnflag || '.' || l_linestatus AS form, l_linenumber AS run FROM lineitem)
SELECT supp, key, min(form) AS form, count(DISTINCT run) AS runs FROM one GROUP BY 1, 2 HAVING count(DISTINCT run) >= 6""")
def vote_threshold(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber")
    v = li.select(F.col("l_suppkey").alias("supp"), F.concat_ws(".", "l_returnflag", "l_linestatus").alias("form"), F.col("l_linenumber").alias("run"))
    return S.threshold_vote(v, ["supp"], F.lower("form"), "form", "run", 6)


@query("""WITH per AS (SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS c FROM lineitem GROUP BY 1, 2)
SELECT k AS order_key, CAST(max(n) - count(*) AS BIGINT) AS n_missing, count(*) FILTER (c > 1) AS n_duplicated FROM per GROUP BY 1 HAVING max(n) > count(*) OR count(*) FILTER (c > 1) > 0""")
def sequence_gaps(spark, sf_dir: str) -> DataFrame:
    return S.sequence_gaps(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").toDF("order_key", "n"), "order_key", "n")


@query("""WITH s AS (SELECT user_id, event_id, value, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS down FROM events)
SELECT user_id, event_id, CAST(sum(down) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sequence FROM (
  SELECT user_id, event_id, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS down FROM events)""")
def sequence_restarts(spark, sf_dir: str) -> DataFrame:
    return S.restarts(table(spark, sf_dir, "events", "user_id", "event_id", "value"), "user_id", ["event_id"], "value").select("user_id", "event_id", "sequence")


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""")
def forward_fill(spark, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "value")
    first = ev.agg(F.min("event_type")).first()[0]
    return S.forward_fill(ev, "user_id", ["event_id"], F.when(F.col("event_type") == first, F.col("value")), "filled").select("user_id", "event_id", "filled")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS cust, CAST(floor(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 30) AS BIGINT) AS n FROM orders),
b AS (SELECT cust, n, CASE WHEN n - lag(n) OVER (PARTITION BY cust ORDER BY n) > 2 THEN 1 ELSE 0 END AS new FROM d), r AS (SELECT cust, n, sum(new) OVER (PARTITION BY cust ORDER BY n) AS run FROM b)
SELECT cust, min(n) AS run_start, max(n) AS run_end, count(*) AS n FROM r GROUP BY cust, run""")
def month_runs(spark, sf_dir: str) -> DataFrame:
    n = F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) / 30).alias("n")
    runs = S.islands(table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").select(F.col("o_custkey").alias("cust"), n), "cust", "n", gap=1)
    return runs


@query("""WITH d AS (SELECT DISTINCT o_custkey AS cust, CAST(floor(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 30) AS BIGINT) AS n FROM orders),
r AS (SELECT cust, min(n) AS run_start, max(n) AS run_end, count(*) AS n FROM (SELECT cust, n, n - row_number() OVER (PARTITION BY cust ORDER BY n) AS g FROM d) GROUP BY cust, g)
SELECT cust, run_start, run_end, n FROM r QUALIFY row_number() OVER (PARTITION BY cust ORDER BY run_end - run_start DESC, run_start) = 1""")
def longest_month_run(spark, sf_dir: str) -> DataFrame:
    n = F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) / 30).alias("n")
    return S.longest_run(S.islands(table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").select(F.col("o_custkey").alias("cust"), n), "cust", "n"), "cust")


@query("""SELECT user_id, CAST(sum(d) AS BIGINT) AS n_faults FROM (SELECT user_id, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS d FROM events) GROUP BY 1""")
def monotonic_faults(spark, sf_dir: str) -> DataFrame:
    return S.monotonic_faults(table(spark, sf_dir, "events", "user_id", "event_id", "value"), "user_id", ["event_id"], "value")


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY coalesce(event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) OR row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1, true)""")
def repeats_suppressed(spark, sf_dir: str) -> DataFrame:
    return S.without_repeats(table(spark, sf_dir, "events", "user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")


@query("""WITH r AS (SELECT p_brand AS brand, p_partkey AS part, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT r.brand, r.part FROM r WHERE n <= 7 OR i IN (SELECT CAST(floor(j * r.n / 7) AS BIGINT) FROM range(0, 7) t(j))""")
def systematic_sample(spark, sf_dir: str) -> DataFrame:
    return S.systematic_sample(table(spark, sf_dir, "part", "p_brand", "p_partkey").toDF("brand", "part"), "brand", ["part"], 7)


@query("""SELECT l_partkey AS part, l_orderkey AS order_key, l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_quantity) <= 3""")
def top_per_part(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return S.top_per_group(li, ["l_partkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")], 3).select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"))


@query(f"""WITH {B.ANCHORS} SELECT id, first_value(id) OVER (PARTITION BY discipline, statement ORDER BY id) AS first_id FROM anchor QUALIFY first_id <> id""")
def duplicate_statements(spark, sf_dir: str) -> DataFrame:
    a = B.anchors(spark, sf_dir).select("id", "discipline", "statement")
    return S.first_wins(a, ["discipline", "statement"], ["id"]).filter("first_id <> id").select("id", "first_id")


@query("""SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2""")
def current_assertions(spark, sf_dir: str) -> DataFrame:
    """The last assertion of each (subject, list item); later ones supersede."""
    ev = table(spark, sf_dir, "events", "user_id", "event_id", "value", "props").withColumn("k", F.get_json_object("props", "$.k").cast("long")).drop("props")
    return S.last_wins(ev.withColumn("_o", F.col("event_id")), ["user_id", "k"], "_o").select("user_id", "k", "value", "event_id")


@query("""SELECT doc_id FROM documents WHERE substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '') || '→' || coalesce(lang, '') || '→' || coalesce(text, '')), 1, 16) <> CASE WHEN doc_id % 3 = 0 THEN substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '') || '→' || coalesce(lang, '') || '→' || coalesce(text, '')), 1, 16) ELSE '' END""")
def incremental_rows(spark, sf_dir: str) -> DataFrame:
    """Rows to do again: those without a stored hash or with another one."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    stored = docs.filter("doc_id % 3 = 0").select("doc_id", S.short_hash("doc_id", "lang", "text").alias("hash"))
    return S.incremental(docs, stored, ["doc_id"], ["doc_id", "lang", "text"]).select("doc_id")


@query("""WITH c AS (SELECT text, count(DISTINCT source) AS n_sources, count(*) AS n_rows FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1)
SELECT d.doc_id, d.source, c.n_sources, c.n_rows FROM documents d JOIN c USING (text)""")
def contaminated_sources(spark, sf_dir: str) -> DataFrame:
    """The same source text under more than one source."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").withColumn("h", F.sha2("text", 256)).filter("h is not null").drop("text")
    groups = docs.groupBy("h").agg(F.countDistinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n_rows")).filter("n_sources > 1")
    return docs.join(groups, "h").select("doc_id", "source", "n_sources", "n_rows")


@query(f"""WITH {B.ANCHORS} SELECT 'discipline' AS dimension, discipline AS value, count(*) AS n FROM anchor WHERE NOT deprecated GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM anchor WHERE NOT deprecated GROUP BY 2 UNION ALL SELECT 'strand', strand, count(*) FROM anchor WHERE NOT deprecated GROUP BY 2""")
def manifest_counts(spark, sf_dir: str) -> DataFrame:
    return metrics.counts_by(metrics.live(B.anchors(spark, sf_dir)), "discipline", "status", "strand")


@query(f"""WITH {B.ANCHORS} SELECT count(*) FILTER (NOT deprecated) AS n_live, count(*) FILTER (NOT deprecated AND status IN {B.CITABLE}) AS n_citable, count(*) FILTER (NOT deprecated AND status = 'expert-confirmed') AS n_human,
  count(*) FILTER (deprecated) AS n_deprecated, CAST(count(*) FILTER (NOT deprecated AND status IN {B.CITABLE}) AS DOUBLE) / count(*) FILTER (NOT deprecated) AS citable_share FROM anchor""")
def status_totals(spark, sf_dir: str) -> DataFrame:
    a = B.anchors(spark, sf_dir)
    live, cite = ~F.col("deprecated"), F.col("status").isin(*metrics.CITABLE)
    n = lambda c: F.count(F.when(c, 1))
    return a.agg(n(live).alias("n_live"), n(live & cite).alias("n_citable"), n(live & F.col("status").isin(*metrics.HUMAN_CONFIRMED)).alias("n_human"), n(~live).alias("n_deprecated"), (n(live & cite).cast("double") / n(live)).alias("citable_share"))


@query("""WITH g AS (SELECT l_partkey AS tag, l_suppkey AS grp, count(*) AS c FROM lineitem GROUP BY 1, 2)
SELECT tag, CAST(sum(c) AS BIGINT) AS n, CAST((sum(c) * (sum(c) - 1) - sum(c * (c - 1))) / 2 AS BIGINT) AS cross_pairs FROM g GROUP BY 1""")
def cross_group_pairs(spark, sf_dir: str) -> DataFrame:
    return metrics.cross_group_pairs(table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").toDF("tag", "grp"), "tag", "grp")


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, list_sort(list(n))[least(CAST(floor(count(*) * 0.97) AS BIGINT) + 1, count(*))] AS p97 FROM c GROUP BY 1""")
def nearest_rank_97(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents", "source", "lang").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return metrics.nearest_rank(c, ["lang"], "n", 0.97).withColumnRenamed("n", "p97")


@query("""SELECT p_brand AS brand, count(*) AS n, round(corr(p_size, p_retailprice), 9) AS r FROM part GROUP BY 1""")
def correlation_by_brand(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_brand", "p_size", "p_retailprice").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("p_size", "p_retailprice"), 9).alias("r"))


@query("""SELECT l_partkey AS part, count(DISTINCT l_linenumber) AS n, CAST(count(DISTINCT l_linenumber) AS DOUBLE) / 7 AS coverage FROM lineitem GROUP BY 1""")
def list_coverage(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber").toDF("list", "key")
    c = profile.list_coverage(li, li.select("list").distinct().withColumn("total", F.lit(7)))
    return c.select(F.col("list").alias("part"), "n", "coverage")


@query("""SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 19 <> 0)""")
def dangling_references(spark, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part", "p_partkey").filter("p_partkey % 19 <> 0").select(F.col("p_partkey").alias("id"))
    return rules.dangling(table(spark, sf_dir, "lineitem", "l_partkey").toDF("id"), known, "id")


@query(f"""WITH {B.ANCHORS}, b(name, lo, hi) AS (VALUES ('low', 1, 4), ('middle', 4, 8), ('high', 9, 12))
SELECT b.name, count(*) AS n, count(*) FILTER (b.hi BETWEEN stage AND stage + 2) AS n_end FROM anchor, b WHERE stage <= b.hi AND stage + 2 >= b.lo GROUP BY 1""")
def band_overlap(spark, sf_dir: str) -> DataFrame:
    """Interval overlap with three bands, as a sum of conditions instead of a join."""
    bands = (("low", 1, 4), ("middle", 4, 8), ("high", 9, 12))
    lo, hi = F.col("stage"), F.col("stage") + 2
    hit = [F.when((lo <= h) & (hi >= b), F.struct(F.lit(n).alias("name"), F.lit(h).between(lo, hi).alias("end"))) for n, b, h in bands]
    rows = B.anchors(spark, sf_dir).select(F.explode(F.array_compact(F.array(*hit))).alias("x"))
    return rows.groupBy("x.name").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("x.end"), 1)).alias("n_end"))


@query("""WITH m AS (SELECT source, lang, min(n_chars) AS page FROM documents GROUP BY 1, 2 HAVING count(DISTINCT n_chars) = 1), f AS (SELECT lang, min(n_chars) AS page FROM documents GROUP BY 1)
SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 4 = 0 THEN d.n_chars END, m.page, f.page, -1) AS page, CASE WHEN d.doc_id % 4 = 0 AND d.n_chars IS NOT NULL THEN 'own' WHEN m.page IS NOT NULL THEN 'exact' WHEN f.page IS NOT NULL THEN 'inherited' ELSE 'default' END AS origin
FROM documents d LEFT JOIN m USING (source, lang) LEFT JOIN f USING (lang)""")
def fallback_chain(spark, sf_dir: str) -> DataFrame:
    """Own value, unambiguous map on two keys, inherited from one key, default."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars")
    exact = rules.unambiguous(d, ["source", "lang"], "n_chars").withColumnRenamed("n_chars", "exact")
    inherited = d.groupBy("lang").agg(F.min("n_chars").alias("inherited"))
    own = d.withColumn("own", F.when(F.col("doc_id") % 4 == 0, F.col("n_chars")))
    return rules.fallback(own.join(exact, ["source", "lang"], "left").join(inherited, "lang", "left"), ["own", "exact", "inherited"], F.lit(-1), "page").select("doc_id", "page", "origin")


@query("""SELECT code, severity, count(*) AS n FROM (
  SELECT unnest(list_filter([CASE WHEN o_totalprice > 300000 THEN 'F101' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'F102' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'W201' END, CASE WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'W202' END], lambda x: x IS NOT NULL)) AS code FROM orders) t
JOIN (VALUES ('F101', 'error'), ('F102', 'error'), ('W201', 'warning'), ('W202', 'warning')) s(c, severity) ON s.c = t.code GROUP BY 1, 2""")
def violation_summary(spark, sf_dir: str) -> DataFrame:
    """Several row rules in one scan, a severity for each, and the summary by code."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate")
    r = [
        rules.Rule("F101", "price over the limit", F.col("o_totalprice") > 300000, F.col("o_totalprice").cast("string")),
        rules.Rule("F102", "open and urgent", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")),
        rules.Rule("W201", "status outside its set", ~F.col("o_orderstatus").isin("O", "F"), severity="warning"),
        rules.Rule("W202", "too old", F.col("o_orderdate").cast("timestamp") < F.lit("1993-01-01").cast("timestamp"), severity="warning"),
    ]
    return rules.summary(rules.violations(o, r, key="o_orderkey"))


@query("""SELECT l_returnflag AS reason, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 2""")
def top_reasons(spark, sf_dir: str) -> DataFrame:
    return metrics.top_reasons(table(spark, sf_dir, "lineitem", "l_returnflag").toDF("reason"), "reason", 2)


@query(f"""WITH {B.ANCHORS}, x AS (SELECT p_brand AS discipline, p_type AS tag, p_partkey AS id FROM part), per AS (SELECT tag, discipline, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT tag, sum(n) AS total FROM per GROUP BY 1)
SELECT x.id, CAST(t.total - per.n AS BIGINT) AS n_peers FROM x JOIN per USING (tag, discipline) JOIN t USING (tag)""")
def tag_peers(spark, sf_dir: str) -> DataFrame:
    """Members of the same tag in other disciplines, from two counts instead of a self join."""
    x = table(spark, sf_dir, "part", "p_brand", "p_type", "p_partkey").toDF("discipline", "tag", "id")
    per = x.groupBy("tag", "discipline").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("tag").agg(F.sum("n").alias("total"))
    return x.join(per, ["tag", "discipline"]).join(total, "tag").select("id", (F.col("total") - F.col("n")).alias("n_peers"))


@query("""WITH m AS (SELECT p_type AS tag, p_brand AS discipline, p_partkey AS id, count(*) OVER (PARTITION BY p_type, p_brand) AS size FROM part)
SELECT tag, discipline, id, size, greatest(size - 8, 0) AS remainder FROM m QUALIFY row_number() OVER (PARTITION BY tag, discipline ORDER BY id) <= 8""")
def tag_drill_down(spark, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part", "p_type", "p_brand", "p_partkey").toDF("tag", "discipline", "id")
    x = x.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("tag", "discipline")))
    return S.top_per_group(x, ["tag", "discipline"], ["id"], 8).withColumn("remainder", F.greatest(F.col("size") - 8, F.lit(0)))


@query("""SELECT p_partkey AS id, p_name AS statement FROM part WHERE contains(p_name, 'a') ORDER BY p_partkey LIMIT 1""")
def first_match(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name").toDF("id", "statement")
    return p.filter(F.col("statement").contains("a")).orderBy("id").limit(1)


@query("""SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, max(turn) AS last_turn FROM conversations GROUP BY 1""")
def checklist_tally(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "role", "turn")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("role") == "user", 1)).alias("n_user"), F.count(F.when(F.col("role") == "assistant", 1)).alias("n_assistant"), F.max("turn").alias("last_turn"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unseen' WHEN l.toxic = 1 THEN 'flagged' WHEN l.quality = 1 THEN 'confirmed' ELSE 'aiPassed' END AS tier FROM documents d LEFT JOIN labels l USING (doc_id)""")
def review_tiers(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id")
    lab = table(spark, sf_dir, "labels", "doc_id", "toxic", "quality").withColumn("seen", F.lit(True))
    return d.join(lab, "doc_id", "left").select("doc_id", F.when(F.col("seen").isNull(), "unseen").when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 1, "confirmed").otherwise("aiPassed").alias("tier"))


@query(f"""WITH {B.ANCHORS}, t AS (SELECT id, discipline, list_sort(list_distinct(string_split(lower(statement), ' '))) AS w FROM anchor)
SELECT x.id AS a, y.id AS b FROM (SELECT discipline, w, min(id) AS id FROM t GROUP BY 1, 2) x JOIN (SELECT discipline, w, min(id) AS id FROM t GROUP BY 1, 2) y ON x.discipline = y.discipline AND x.id < y.id
WHERE 100 * len(list_intersect(x.w, y.w)) >= 30 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))""")
def near_duplicate_statements(spark, sf_dir: str) -> DataFrame:
    """Pairs of unlike statements of a discipline with word Jaccard of 0.3 or more, by their smallest ids."""
    a = B.anchors(spark, sf_dir).select("id", "discipline", F.split(F.lower("statement"), " ").alias("tokens"))
    return dedup.near_pairs(a, 30).select("a", "b")


@query("""SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS match_key, substr(sha256(text), 1, 24) AS hash,
  CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS cut, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM documents""")
def text_keys(spark, sf_dir: str) -> DataFrame:
    """Match key, content hash, cut text and escaped text of each document."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    line = F.col("text")
    return d.select("doc_id", F.regexp_replace(F.lower(line), "[^a-z0-9]+", "").alias("match_key"), T.hash_prefix(F.col("text"), 24).alias("hash"), T.cut(F.col("text"), 40).alias("cut"), T.escape_html(line).alias("escaped"))


@query("""WITH w AS (SELECT DISTINCT item_id, unnest(string_split_regex(trim(lower(text)), '[^a-z]+')) AS t FROM benchmark), bw AS (SELECT * FROM w WHERE t <> ''),
d AS (SELECT DISTINCT doc_id, unnest(string_split_regex(trim(lower(text)), '[^a-z]+')) AS t FROM documents), n AS (SELECT item_id, count(*) AS n FROM bw GROUP BY 1),
hit AS (SELECT item_id, doc_id, count(*) AS k FROM bw JOIN d USING (t) GROUP BY 1, 2)
SELECT item_id, doc_id, CAST(k AS DOUBLE) / n AS coverage FROM hit JOIN n USING (item_id) WHERE CAST(k AS DOUBLE) / n >= 0.9""")
def grounded_items(spark, sf_dir: str) -> DataFrame:
    """Benchmark items of which nine tenths of the words stand in a document.

    Such a document has one of any n - ceil(0.9 n) + 1 words of an item, so the items meet documents on their rarest ones.
    """
    words = lambda name, key: table(spark, sf_dir, name, key, "text").select(key, F.array_compact(F.array_remove(F.array_distinct(F.split(F.trim(F.lower("text")), "[^a-z]+")), "")).alias("w"))
    items, docs = settled(words("benchmark", "item_id").filter("size(w) > 0")), words("documents", "doc_id")
    each = items.select("item_id", F.size("w").alias("n"), F.explode("w").alias("t"))
    said = docs.select("doc_id", F.explode("w").alias("t"))
    rare = said.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "t"))
    prefix = settled(each.join(rare, "t", "left").withColumn("k", place).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * 9 / 10) + 1).select("item_id", "t"))
    pairs = said.join(prefix, "t").select("item_id", "doc_id").distinct()
    both = pairs.join(docs, "doc_id").join(items.select("item_id", F.col("w").alias("own")), "item_id")
    k = F.size(F.array_intersect("own", "w"))
    return both.withColumn("coverage", k.cast("double") / F.size("own")).filter("coverage >= 0.9").select("item_id", "doc_id", "coverage")


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<p>')) AS n_paragraphs, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages""")
def page_index(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "url", "html")
    n = F.size(F.regexp_extract_all("html", F.lit("<p>"), 0)).cast("long")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), n.alias("n_paragraphs"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: trim(x) <> '')) AS n_sentences FROM documents""")
def sentence_counts(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.size(F.filter(F.split("text", "[.!?\\n]+", -1), lambda x: F.trim(x) != "")).cast("long").alias("n_sentences"))


@query("""WITH x AS (SELECT l_partkey AS id, min(l_suppkey) AS s, count(*) AS n FROM lineitem GROUP BY 1) SELECT id, CASE WHEN n < 20 THEN 'JUNK' WHEN n > 45 THEN 'SPLIT' WHEN s % 7 = 0 THEN 'NO_STAGE' WHEN s % 2 = 0 THEN 'READY' ELSE 'JUDGE' END AS bucket FROM x""")
def triage_buckets(spark, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_suppkey").alias("s"), F.count(F.lit(1)).alias("n"))
    return x.select("id", rules.first_match([(F.col("n") < 20, "JUNK"), (F.col("n") > 45, "SPLIT"), (F.col("s") % 7 == 0, "NO_STAGE"), (F.col("s") % 2 == 0, "READY")], "JUDGE").alias("bucket"))


@query("""SELECT p_partkey AS id, 'G' || CAST(1 + (p_size - 1) % 12 AS VARCHAR) AS grade, 1 + (p_size - 1) % 12 AS n, row_number() OVER (PARTITION BY p_brand ORDER BY 'G' || CAST(1 + (p_size - 1) % 12 AS VARCHAR), p_partkey) AS text_rank FROM part""")
def text_order_rank(spark, sf_dir: str) -> DataFrame:
    """Stages compared as text (G10 before G2), beside their numbers."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").withColumn("grade", F.concat(F.lit("G"), (1 + (F.col("p_size") - 1) % 12).cast("string")))
    w = Window.partitionBy("p_brand").orderBy("grade", "p_partkey")
    return p.select(F.col("p_partkey").alias("id"), "grade", T.grade_number(F.col("grade")).alias("n"), F.row_number().over(w).cast("long").alias("text_rank"))
