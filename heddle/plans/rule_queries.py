"""Queries that run the library's rules on mappings, funnels, runs, validity, pages, coercions, markers and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import curation, imports, reports, rules
from heddle.operators import sequences as S
from heddle.plans import bindings as B
from heddle.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""WITH m AS (SELECT c_custkey AS i, 'F' || CAST(c_nationkey AS VARCHAR) || CASE WHEN c_custkey % 17 = 0 THEN '-' ELSE ':' END || CAST(c_custkey % 60 AS VARCHAR) AS key,
  'F' || CAST(c_nationkey AS VARCHAR) || ':' || CAST(c_custkey % 60 AS VARCHAR) AS whole, c_custkey % 3 = 0 AS bare, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE '' END AS summary, c_custkey * 2 AS anchor FROM customer)
SELECT key, 'DUPLICATE_KEY' AS code, CAST(count(*) - 1 AS VARCHAR) AS detail FROM m GROUP BY key HAVING count(*) > 1
UNION ALL SELECT key, 'KEY_PARTS', NULL FROM m WHERE key <> whole
UNION ALL SELECT key, 'CODES_ONLY', NULL FROM m WHERE bare AND summary <> ''
UNION ALL SELECT key, 'DANGLING_ANCHOR', CAST(anchor AS VARCHAR) FROM m WHERE anchor NOT IN (SELECT p_partkey FROM part)""")
def mapping_violations(spark, sf_dir: str) -> DataFrame:
    c, i = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_name"), F.col("c_custkey")
    code, framework = (i % 60).cast("string"), F.concat(F.lit("F"), F.col("c_nationkey").cast("string"))
    m = c.select(
        F.concat(framework, F.when(i % 17 == 0, "-").otherwise(":"), code).alias("key"), framework.alias("framework"), code.alias("code"), (i % 3 != 0).alias("textIncluded"),
        F.when(i % 4 == 0, F.col("c_name")).otherwise("").alias("summary"), F.array(i * 2).alias("anchorIds"),
    )
    return rules.mapping_violations(m, B.anchors(spark, sf_dir).select("id")).select("key", "code", "detail")


@query("""WITH d AS (SELECT lang, doc_id, text, doc_id = min(doc_id) OVER (PARTITION BY lang, text) AS own, length(text) >= 200 AS long, contains(text, '.') AS stated, contains(lower(text), 'the') AS grounded FROM documents)
SELECT lang, count(*) AS raw, count(*) FILTER (own) AS dedup, count(*) FILTER (own AND long) AS long, count(*) FILTER (own AND long AND stated) AS stated, count(*) FILTER (own AND long AND stated AND grounded) AS grounded FROM d GROUP BY 1""")
def subject_funnel(spark, sf_dir: str) -> DataFrame:
    d, text = table(spark, sf_dir, "documents", "doc_id", "lang", "text"), F.col("text")
    # Texts are grouped by their digest and ids are met, so that copies of one text are never in one task.
    own = d.groupBy("lang", F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("own"))
    stages = [("dedup", F.col("own")), ("long", F.length(text) >= 200), ("stated", F.contains(text, F.lit("."))), ("grounded", F.contains(F.lower(text), F.lit("the")))]
    return reports.funnel(d.join(own, "doc_id", "left"), ["lang"], stages)


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS supp, l_partkey AS n FROM lineitem), g AS (SELECT supp, n, CASE WHEN n - lag(n) OVER (PARTITION BY supp ORDER BY n) > 4 THEN 1 ELSE 0 END AS new FROM d),
r AS (SELECT supp, n, sum(new) OVER (PARTITION BY supp ORDER BY n) AS run FROM g) SELECT supp, min(n) AS run_start, max(n) AS run_end, count(*) AS n FROM r GROUP BY supp, run""")
def merged_runs(spark, sf_dir: str) -> DataFrame:
    """Runs that bear holes of up to three numbers."""
    return S.islands(table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").toDF("supp", "part"), "supp", "part", 3)


@query("""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1 END AS supersedes, CAST(o_orderdate AS DATE) AS f, CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 400 AS INTEGER) END AS u FROM orders)
SELECT id FROM x WHERE f <= DATE '1996-06-30' AND (u IS NULL OR u >= DATE '1996-06-30') AND id NOT IN (SELECT supersedes FROM x WHERE supersedes IS NOT NULL)""")
def valid_assertions(spark, sf_dir: str) -> DataFrame:
    """Assertions that hold on a day and that none supersedes."""
    o, k = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate"), F.col("o_orderkey")
    since = F.col("o_orderdate").cast("date")
    until = F.when(F.col("o_custkey") % 5 != 0, F.date_add(since, (F.col("o_custkey") % 400).cast("int")))
    x = o.select(k.alias("id"), F.when(k % 7 == 0, k - 1).alias("supersedes"), since.alias("valid_from"), until.alias("valid_until"))
    return S.valid_on(S.current(x), "1996-06-30").select("id")


@query("""WITH x AS (SELECT l_orderkey AS order_key, CASE WHEN l_partkey % 6 <> 0 THEN l_partkey % 90 END AS page FROM lineitem)
SELECT order_key, count(DISTINCT page) AS n_pages, CAST(min(page) AS BIGINT) AS first_page, CAST(max(page) AS BIGINT) AS last_page FROM x GROUP BY 1""")
def page_spans(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    page = F.when(F.col("l_partkey") % 6 != 0, (F.col("l_partkey") % 90).cast("long"))
    items = li.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.collect_list(F.struct(page.alias("page"))).alias("items"))  # the lines of one order
    span = imports.page_span(F.col("items"), "page")
    return items.select("order_key", F.size(span["pages"]).cast("long").alias("n_pages"), span["first"].alias("first_page"), span["last"].alias("last_page"))


@query("""WITH x AS (SELECT unnest(CASE p_partkey % 4 WHEN 0 THEN [p_brand, p_type] WHEN 1 THEN [p_brand] WHEN 2 THEN CAST([] AS VARCHAR[]) ELSE CAST(NULL AS VARCHAR[]) END) AS value FROM part)
SELECT value, count(*) AS n FROM x GROUP BY 1""")
def coerced_values(spark, sf_dir: str) -> DataFrame:
    """Values that are JSON arrays, JSON strings, empty strings or missing."""
    p, q, i = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type"), F.lit('"'), F.col("p_partkey")
    many = F.concat(F.lit('["'), F.col("p_brand"), F.lit('", "'), F.col("p_type"), F.lit('"]'))
    json = F.when(i % 4 == 0, many).when(i % 4 == 1, F.concat(q, F.col("p_brand"), q)).when(i % 4 == 2, '""')
    return p.select(F.explode(T.json_values(json)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT 'parts' AS key, CAST(count(*) AS VARCHAR) AS wanted FROM part UNION ALL SELECT 'brands', CAST(count(DISTINCT p_brand) AS VARCHAR) FROM part),
m AS (SELECT s_suppkey AS id, 1 AS nth, 'brands' AS key, CAST(s_suppkey % 30 AS VARCHAR) AS shown FROM supplier UNION ALL SELECT s_suppkey, 2, CASE WHEN s_suppkey % 2 = 0 THEN 'parts' ELSE 'nothing' END, CAST(s_suppkey * 20 AS VARCHAR) FROM supplier)
SELECT id, CAST(nth AS BIGINT) AS nth, key, shown, wanted, CASE WHEN wanted IS NULL THEN 'unknown' WHEN shown <> wanted THEN 'stale' ELSE 'fresh' END AS state FROM m LEFT JOIN v USING (key)""")
def marker_states(spark, sf_dir: str) -> DataFrame:
    """Numbers shown in texts against the numbers that the tables have."""
    part, s, i = table(spark, sf_dir, "part", "p_brand"), table(spark, sf_dir, "supplier", "s_suppkey"), F.col("s_suppkey")
    values = part.agg(F.count(F.lit(1)).cast("string").alias("parts"), F.countDistinct("p_brand").cast("string").alias("brands")).unpivot([], ["parts", "brands"], "key", "wanted")
    key = F.when(i % 2 == 0, "parts").otherwise("nothing")
    text = F.concat(F.lit("has <!--N:brands--> "), (i % 30).cast("string"), F.lit(" <!--/N--> and\n<!--N:"), key, F.lit("-->"), (i * 20).cast("string"), F.lit("<!--/N-->."))
    return reports.markers(s.select(i.alias("id"), text.alias("text")), values).withColumn("nth", F.col("nth").cast("long"))


_LETTERS = len(curation.ID_LETTERS)
_SQL_DIGITS = " || ".join(f"substr('{curation.ID_LETTERS}', CAST(CAST('0x' || substr(h, {1 + 7 * k}, 7) AS BIGINT) % {_LETTERS} AS INTEGER) + 1, 1)" for k in range(8))


@query(f"""WITH x AS (SELECT p_partkey AS key, sha256(CAST(p_partkey AS VARCHAR) || '#0') AS h FROM part) SELECT key, 'ca_' || {_SQL_DIGITS} AS id FROM x""")
def minted_ids(spark, sf_dir: str) -> DataFrame:
    """New ids of all anchors, none used before or given twice (the SQL has no second try; none is needed on these tables)."""
    a = B.anchors(spark, sf_dir).select("id").withColumnRenamed("id", "key")
    return curation.minted(a, "key", spark.createDataFrame([("ca_AAAAAAAA",)], "id string")).select("key", "id")
