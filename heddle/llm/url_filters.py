"""URL filters (1, native): a temporal list join.

A list is a log of dated entries (key, verdict, category; added or removed). Entries become validity intervals: each
holds from its date to the next entry of the same list and key. A capture is looked up under its host, the parents of
its host, and its host with the first path segment, and an as-of join gives the entries that were active when it was
fetched; the longest key decides, and among equal keys a block.

Intervals are cut at months, so that the join is an equi-join on (key, month) and a host with very many captures is
spread; few intervals are broadcast, more meet captures on (key, month, salt).

Defined cases: a null or unreadable url has no host and is allowed; a null fetch time is before all entries, so nothing
is active; entries of one key and date count in the order of `seq`, and the last holds; repeated captures are rows of
their own; empty captures give an empty result, empty lists allow everything; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

SALTS = 16
OPEN_END = "9999-12-31"


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and a final dot; empty if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"\.$", "")


def keys_of(host: Column, url: Column) -> Column:
    """The host, its parents of two labels or more, and the host with the first path segment."""
    labels = F.split(host, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)", 1)
    own = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, own)))


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, category, verdict, valid_from, valid_to (excluded) of added entries. entries: list, key, category, verdict, action, dated, seq."""
    order = Window.partitionBy("list", "key").orderBy("dated", "seq")
    until = F.coalesce(F.lead("dated").over(order), F.lit(OPEN_END).cast("date"))
    known = entries.filter("key is not null and dated is not null")
    cut = known.withColumn("valid_to", until).withColumnRenamed("dated", "valid_from")
    return cut.filter((F.col("action") == "add") & (F.col("valid_from") < F.col("valid_to"))).select("list", "key", "category", "verdict", "valid_from", "valid_to")


def filtered(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, host, fetched_on, allowed, list_key, category, listed_since of every capture (page_id, url, fetched_on)."""
    named = store.keep(captures.select("page_id", "url", "fetched_on", host_of(F.col("url")).alias("host"), F.monotonically_increasing_id().alias("row")), "captures")
    span = named.agg(F.min("fetched_on").alias("first"), F.max("fetched_on").alias("last")).first()
    listed = store.keep(intervals(entries), "intervals")
    asked = named.select("row", "fetched_on", F.trunc("fetched_on", "MM").alias("month"), F.explode(keys_of(F.col("host"), F.col("url"))).alias("key")).filter("fetched_on is not null")
    lo, hi = F.lit(span["first"]).cast("date"), F.lit(span["last"]).cast("date")
    months = F.sequence(F.trunc(F.greatest("valid_from", lo), "MM"), F.trunc(F.least(F.date_sub("valid_to", 1), hi), "MM"), F.expr("interval 1 month"))
    cut = listed.filter((F.col("valid_from") <= hi) & (F.col("valid_to") > lo)).withColumn("month", F.explode(months)).select("key", "month", "category", "verdict", "valid_from", "valid_to")
    cut = store.keep(cut, "interval-months")
    on = ["key", "month"]
    if cut.count() <= store.BROADCAST_ROWS:
        met = asked.join(F.broadcast(cut), on)
    else:
        salted = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"])
    met = met.filter((F.col("valid_from") <= F.col("fetched_on")) & (F.col("fetched_on") < F.col("valid_to")))
    rank = F.struct(F.length("key").alias("n"), (F.col("verdict") == "block").alias("block"), "key", "category", "valid_from")
    best = met.groupBy("row").agg(F.max(rank).alias("best"))
    out = named.join(best, "row", "left")
    return out.select(
        "page_id", "url", "host", "fetched_on", (~F.coalesce(F.col("best.block"), F.lit(False))).alias("allowed"), F.col("best.key").alias("list_key"), F.col("best.category").alias("category"), F.col("best.valid_from").alias("listed_since")
    )


#: The driver tables have neither fetch times nor lists, so the query derives both from the pages by fixed rules: a page
#: is fetched on a day of 2024 given by its id, and two thirds of all hosts and paths have four dated entries each.
CATEGORIES = ("malware", "adult", "spam", "trusted")


def surrogate_captures(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id").cast("long") * 7919, F.lit(366)).cast("int")).alias("fetched_on"))


def surrogate_entries(captures: DataFrame) -> DataFrame:
    """Four entries of each listed key; digits of the key's md5 say when, what and of which category."""
    keys = captures.select(F.explode(keys_of(host_of(F.col("url")), F.col("url"))).alias("key")).distinct()
    digit = lambda at, n=1: F.conv(F.substring(F.col("h"), at, n), 16, 10).cast("int")
    each = keys.withColumn("h", F.md5("key")).filter(digit(1) < 10).withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3))))
    each = each.withColumn("h", F.md5(F.concat("key", F.lit("#"), F.col("seq").cast("string"))))
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), digit(5) % 4 + 1)
    return each.select(
        F.lit("surrogate").alias("list"), "key", category.alias("category"), F.when(category == "trusted", "allow").otherwise("block").alias("verdict"),
        F.when(digit(6) < 10, "add").otherwise("remove").alias("action"), F.date_add(F.lit("2023-10-01").cast("date"), digit(1, 3) % 450).alias("dated"), "seq",
    )


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    captures = store.keep(surrogate_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")), "pages-slim")
    return filtered(captures, surrogate_entries(captures)).withColumn("fetched_on", F.col("fetched_on").cast("string")).withColumn("listed_since", F.col("listed_since").cast("string"))


SQL = r"""
WITH cap AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(((page_id * 7919) % 366 + 366) % 366 AS INTEGER) AS fetched_on,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', '') AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)', 1) AS segment,
    row_number() OVER () AS row_id
  FROM pages),
asked AS (
  SELECT DISTINCT row_id, fetched_on, key FROM (
    SELECT row_id, fetched_on, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, 1000), '.'))) AS key FROM cap WHERE host <> ''
    UNION ALL SELECT row_id, fetched_on, host || '/' || segment FROM cap WHERE host <> '' AND segment <> '')),
keys AS (SELECT DISTINCT key FROM asked),
entry AS (
  SELECT key, seq, md5(key || '#' || CAST(seq AS VARCHAR)) AS h FROM keys, range(0, 4) t(seq)
  WHERE CAST('0x' || substr(md5(key), 1, 1) AS INTEGER) < 10),
dated AS (
  SELECT key, seq, (['malware', 'adult', 'spam', 'trusted'])[CAST('0x' || substr(h, 5, 1) AS INTEGER) % 4 + 1] AS category,
    CAST('0x' || substr(h, 6, 1) AS INTEGER) < 10 AS added,
    DATE '2023-10-01' + CAST(CAST('0x' || substr(h, 1, 3) AS INTEGER) % 450 AS INTEGER) AS valid_from
  FROM entry),
spans AS (
  SELECT *, coalesce(lead(valid_from) OVER (PARTITION BY key ORDER BY valid_from, seq), DATE '9999-12-31') AS valid_to FROM dated),
met AS (
  SELECT a.row_id, s.*, row_number() OVER (PARTITION BY a.row_id ORDER BY length(s.key) DESC, (s.category <> 'trusted') DESC, s.key DESC, s.category DESC, s.valid_from DESC) AS nth
  FROM asked a JOIN spans s ON a.key = s.key AND s.added AND s.valid_from <= a.fetched_on AND a.fetched_on < s.valid_to)
SELECT c.page_id, c.url, c.host, CAST(c.fetched_on AS VARCHAR) AS fetched_on, NOT coalesce(m.category <> 'trusted', false) AS allowed,
  m.key AS list_key, m.category, CAST(m.valid_from AS VARCHAR) AS listed_since
FROM cap c LEFT JOIN met m ON m.row_id = c.row_id AND m.nth = 1
"""
