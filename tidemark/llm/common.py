"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows of text that go to a Python worker at once: texts of some KB then cost it and the JVM beside it a
#: few MB at a time.
TEXT_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a local session, as in tests, gets a local folder; on a cluster that is
    an error, for what executors write to their own disks is lost."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Intermediate tables of one operator, as Parquet in the shared folder: they cut the lineage, so that
    a lost executor costs no recomputation, and each goes as soon as no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def store(self, df: DataFrame, packed: bool = False, texts: bool = False) -> DataFrame:
        """df written and read again; the shuffles it took are freed. packed: the rows hold compressed
        blobs already; texts: whole texts go through Python."""
        path = shared_dir(self.spark)
        values = {_CLEANUP: "true"}
        if texts and not 0 < int(self.spark.conf.get(_BATCH)) <= TEXT_ROWS:
            values[_BATCH] = str(TEXT_ROWS)
        with _set(self.spark, values):
            df.write.option("compression", "none" if packed else "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def adopt(self, other: Scratch) -> None:
        """Takes over another one's tables."""
        self.held += other.held

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing will read any more."""
        for table, path in [x for x in self.held if any(x[0] is t for t in tables)]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.held = [x for x in self.held if not any(x[0] is t for t in tables)]

    def keep(self, *tables: DataFrame) -> None:
        """Removes all tables but these."""
        self.drop(*[t for t, _ in self.held if not any(t is k for k in tables)])


def store(df: DataFrame, packed: bool = False, texts: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    return Scratch(df.sparkSession).store(df, packed, texts)


def row_hash() -> Column:
    """Tells apart the texts of rows with one doc_id; null and empty text are the same."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, whatever their columns are called, without the rows of gone (doc_id, row_hash). gone should be
    stored, so that Spark knows its size and need not shuffle the texts if it is small."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), row_hash().alias("own_hash"))
    return rows.join(gone, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("row_hash")), "left_anti").select("row.*")


def words(text: Column | str) -> Column:
    """The words of a text as an array; null text: none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """What step makes of 0 and the first, of that and the second, and so on, over an array of longs. Done in
    blocks, as every append to an array copies it."""
    none = F.array().cast("array<bigint>")
    state = lambda at, out: F.struct(at.cast("bigint").alias("at"), out.alias("out"))

    def append(acc: Column, value: Column) -> Column:
        return let(step(acc["at"], value).cast("bigint"), lambda x: state(x, F.concat(acc["out"], F.array(x))))

    def whole(v: Column) -> Column:
        def add(acc: Column, b: Column) -> Column:
            inner = F.aggregate(F.slice(v, b * block + 1, F.lit(block)), state(acc["at"], none), append)
            return let(inner, lambda x: state(x["at"], F.concat(acc["out"], x["out"])))

        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        return F.when(F.size(v) == 0, none).otherwise(F.aggregate(blocks, state(F.lit(0), none), add, lambda acc: acc["out"]))

    return let(values, whole)
