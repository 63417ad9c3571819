"""Quality rules (10, native): row rules, and host verdicts from shrunk failure rates.

Rows that a rule fails are counted by host (here: `source`). Each host's failure rate of each rule is shrunk towards
the corpus with an empirical beta prior (fitted by moments over hosts), and a host of which most documents are expected
to fail is rejected as a whole; the verdict is joined back to its documents.

Defined cases: a null or blank text has no words and fails; null sources form one host; repeated rows count each time;
an empty table gives an empty result; other columns are ignored here and kept by `keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
MAX_SYMBOL_PERCENT = 25
MAX_DUP_LINE_PERCENT = 50
#: A host goes when its expected failure rate of one rule is above this.
HOST_LIMIT = 0.6
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)
SALTS = 64
RULES = ("short", "repeats", "symbols", "dup_lines")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(starts: Column) -> Column:
    """Words under windows that occur twice or more; starts: the sorted first words of those windows."""
    steps = F.transform(starts, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - x, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def measured(df: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """df and a struct column `out` with the measures of each text and the rules that it fails.

    Everything is computed inside the row, so no shuffle happens; windows are compared by 64-bit hash, and the pairs
    of equal windows are sorted only for texts that have any.
    """
    w, h, s, n, ls = (store.fresh_name(df, f"_{x}") for x in ("words", "hashes", "starts", "n", "lines"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out_df = df.withColumn(w, store.words_of(F.col(f"`{text}`"))).withColumn(n, F.size(w))
    windows = F.transform(F.slice(F.col(w), F.lit(1), F.greatest(F.col(n) - (WINDOW - 1), F.lit(0))), lambda _, i: F.xxhash64(F.slice(F.col(w), i + 1, F.lit(WINDOW))))
    out_df = out_df.withColumn(h, windows)
    pairs = F.array_sort(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out_df = out_df.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), pairs))
    near = lambda j, p: F.get(F.col(s), j)["h"].eqNullSafe(p["h"])
    same = F.filter(F.transform(F.col(s), lambda p, j: F.when(near(j - 1, p) | near(j + 1, p), p["i"])), lambda x: x.isNotNull())
    out_df = out_df.withColumn(s, F.array_sort(same))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(store.BLANKS)) != "")
    out_df = out_df.withColumn(ls, lines)
    m = {
        "n_words": F.col(n).cast("long"),
        "word_chars": F.length(F.array_join(F.col(w), "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(F.col(ls)))).cast("long"),
        "n_repeat_words": F.coalesce(_repeats(F.col(s)), F.lit(0).cast("long")),
        "n_lines": F.size(ls).cast("long"),
    }
    q = F.struct(*[c.alias(k) for k, c in m.items()])
    out_df = out_df.withColumn(out, q).drop(w, h, s, n, ls)
    return out_df.withColumn(out, F.struct(*[F.col(f"{out}.{k}") for k in m], *[c.alias(k) for k, c in rules(out).items()]))


def rules(q: str) -> dict[str, Column]:
    c = lambda k: F.col(f"{q}.{k}")
    return {
        "short": c("n_words") < MIN_WORDS,
        "repeats": 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"),
        "symbols": 100 * c("n_symbols") > MAX_SYMBOL_PERCENT * c("word_chars"),
        "dup_lines": 100 * c("n_dup_lines") > MAX_DUP_LINE_PERCENT * c("n_lines"),
    }


def host_key(source: str) -> Column:
    """Never null, and unlike for null and for any string."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null"))


def hosts(df: DataFrame, q: str = "quality", source: str = "source") -> DataFrame:
    """Per host: documents, failures by rule, the shrunk rates and the verdict. Map-side sums, so no host is hot."""
    sums = [F.sum(F.col(f"{q}.{r}").cast("long")).alias(r) for r in RULES]
    table = store.keep(df.groupBy(host_key(source).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *sums), "hosts")
    rate = {r: F.col(r) / F.col("n_docs") for r in RULES}
    prior = table.agg(F.sum("n_docs").alias("n"), *[f for r in RULES for f in (F.sum(r).alias(f"sum_{r}"), F.var_samp(rate[r]).alias(f"var_{r}"))]).first()
    out = table
    for r in RULES:
        mean = (prior[f"sum_{r}"] or 0) / prior["n"] if prior["n"] else 0.0
        var = prior[f"var_{r}"] or 0.0
        weight = mean * (1 - mean) / var - 1 if var > 0 else PRIOR_WEIGHT[1]
        weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
        out = out.withColumn(f"rate_{r}", (F.col(r) + mean * weight) / (F.col("n_docs") + weight))
    return out.withColumn("host_kept", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) <= HOST_LIMIT)


def with_verdicts(df: DataFrame, q: str = "quality", source: str = "source", out: str = "kept") -> DataFrame:
    """df (measured, and written) with the boolean `out`.

    Host verdicts are broadcast when there are few hosts, and otherwise met on (host, salt), so that a host with a
    third of all rows is spread over many tasks.
    """
    table = hosts(df, q, source)
    host, salt, ok = (store.fresh_name(df, f"_{x}") for x in ("host", "salt", "ok"))
    verdict = table.select(F.col("host").alias(host), F.col("host_kept").alias(ok))
    keyed = df.withColumn(host, host_key(source))
    if table.count() <= store.BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(verdict), host, "left")
    else:
        spread = verdict.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).join(spread, [host, salt], "left").drop(salt)
    failed = F.col(f"{q}.short") | F.col(f"{q}.repeats")
    return joined.withColumn(out, ~failed & F.coalesce(F.col(ok), F.lit(True))).drop(host, ok)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules and their host's verdict keep, with their columns.

    Measures are written before any verdict is read off them: a condition on them must not be pushed into their own
    making. With unique ids only slim rows are written, and only texts whose id may be a rejected one are shuffled.
    """
    spark = docs.sparkSession
    columns = [F.col(f"`{c}`") for c in docs.columns]
    q, kept, lost = (store.fresh_name(docs, x) for x in ("_quality", "_kept", "_gone"))
    if not store.keyed(docs)[1]:
        table = store.keep(measured(docs, out=q), "quality")
        return with_verdicts(table, q=q, out=kept).filter(F.col(kept)).select(*columns)
    with store.tables(spark) as own:
        slim = store.keep(measured(docs, out=q).select("doc_id", "source", q), "quality")
        gone = store.keep(with_verdicts(slim, q=q, out=kept).filter(~F.col(kept)).select(F.col("doc_id").cast("long").alias(lost)), "rejected")
        own.release(gone)
    doubtful, sure = store.split(docs, "doc_id", gone, lost)
    good = doubtful.join(gone, F.col("doc_id").cast("long") == F.col(lost), "left_anti")
    return sure.select(*columns).union(good.select(*columns))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = store.text_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
    out = store.result(spark, lambda: with_verdicts(store.keep(measured(docs).select("doc_id", "source", "quality"), "quality")), "verdicts")
    return out.select("doc_id", *[F.col(f"quality.{m}").alias(m) for m in MEASURES], (F.col("quality.short") | F.col("quality.repeats")).alias("base_failed"), "kept")
