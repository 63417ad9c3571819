"""Shared-folder tables and small plan helpers used by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"

#: A table of at most so many rows (each of a few hundred bytes at most) may be broadcast.
BROADCAST_ROWS = 20_000

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's checkpoint folder; a temporary one is made only where the session has none and everything runs in
    one process (tests, local runs).
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="heddle-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Tables:
    """The tables that one call has written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def release(self, *needed: DataFrame) -> None:
        """Deletes the tables, but for those needed."""
        stay = {getattr(df, "_heddle_path", None) for df in needed}
        for path in self.paths:
            if path not in stay:
                p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.paths = [p for p in self.paths if p in stay]


#: The tables of the call that runs in this thread; each thread has its own.
_tables: ContextVar[Tables | None] = ContextVar("heddle_tables", default=None)


@contextmanager
def tables(spark: SparkSession):
    """What keep() writes inside can be released; what is left at the end belongs to the call around, if there is one."""
    outer, own = _tables.get(), Tables(spark)
    token = _tables.set(own)
    try:
        yield own
    finally:
        _tables.reset(token)
        if outer is not None:
            outer.paths += own.paths


#: While it is true, Spark deletes a query's shuffle files when the query ends, not when the driver's collector finds them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """The queries inside leave no shuffle files."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage is cut, a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    own = _tables.get()
    if own is not None:
        own.paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._heddle_path = path
    return out


def result(spark: SparkSession, make, name: str) -> DataFrame:
    """The written table of make(), whose own tables are deleted."""
    with tables(spark) as own:
        out = keep(make(), name)
        own.release(out)
    return out


def parts_for(df: DataFrame, bytes_a_part: int = 256 << 20) -> int:
    """Shuffle partitions for rows as wide as the input's: the session's number, or more where the files are larger."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, -(-size // bytes_a_part)))


#: Ids are told apart by so many hash buckets before they are met exactly; the bucket table is broadcast, and this is
#: the most rows that it can have.
BUCKETS = 1 << 20


def split(df: DataFrame, key: str, ids: DataFrame, id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key may be in ids, all other rows). ids: a written table.

    Only the first part has to be shuffled to meet ids; it holds the rows that do meet and few others while there are
    fewer ids than BUCKETS, and is right for any number.
    """
    name = fresh_name(df, "_bucket")
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(BUCKETS)).alias(name)
    table = F.broadcast(ids.select(bucket(id)).distinct())
    with_bucket = df.select("*", bucket(f"`{key}`"))
    return with_bucket.join(table, name, "left_semi").drop(name), with_bucket.join(table, name, "left_anti").drop(name)


def keyed(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str | None]:
    """docs and its key column, if doc_id is never null and never repeated; else None for the key."""
    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    return docs, doc_id if ids.filter("k > 1 or id is null").isEmpty() else None


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        to = os.path.join(tempfile.mkdtemp(prefix="heddle-"), "heddle_code.zip")
        with zipfile.ZipFile(to, "w") as z:
            for at, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(at, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds the rows of an Arrow batch, since one row can hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    name, i = base, 0
    while name.lower() in have:
        i += 1
        name = f"{base}_{i}"
    return name


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))


def text_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else df holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])
