"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Small sides are broadcast only up to this many rows and bytes of Parquet; beyond it Spark shuffles both sides.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 * 1024 * 1024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Delimiters of the two kinds of words that the operators know; Spark's patterns are Java's, whose \s is \x20\x09-\x0D.
SPACES = r"\s+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='foliospark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Written(threading.local):
    """Paths of the tables that each `settled` in progress has stored, the innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


WRITTEN = Written()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliospark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if WRITTEN.open:
        WRITTEN.open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make() as one stored table; what it stored on the way is deleted once that is written."""
    WRITTEN.open.append([])
    try:
        out = stored(make(), name)
    finally:
        paths = WRITTEN.open.pop()
    *before, last = paths
    hadoop = out.sparkSession._jvm.org.apache.hadoop.fs.Path
    conf = out.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in map(hadoop, before):
        path.getFileSystem(conf).delete(path, True)
    if WRITTEN.open:
        WRITTEN.open[-1].append(last)
    return out


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that a stored table is read from."""
    spark = df.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return sum(at.getFileSystem(conf).getFileStatus(at).getLen() for at in map(path, df.inputFiles()))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast if it has few rows and bytes: its size is read, not guessed."""
    return F.broadcast(df) if file_bytes(df) <= BROADCAST_BYTES and df.count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, delimiter: str) -> Column:
    """array<string> of the non-empty parts between delimiters; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), delimiter), lambda w: w != "")


def text_key(text: Column) -> Column:
    """Equal for equal texts; two 64-bit hashes and the length tell different texts apart."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"), F.octet_length(text).alias("n"))


def free_names(df: DataFrame, wanted: list[str]) -> DataFrame:
    """df without columns whose names the operator gives to its own output."""
    lower = {w.lower() for w in wanted}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


#: The struct that holds what an operator has no part in.
REST = "columns_of_the_caller"


def own_columns(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that an operator works on, and all others by number in one struct: no name of theirs can clash with its own."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(c for c in docs.columns if c not in own)]
    return docs.select(*own, F.struct(*rest, F.lit(True).alias("present")).alias(REST))


def all_columns(columns: list[str], *own: str, **fresh: Column) -> list[Column]:
    """The caller's columns from what own_columns made of them; fresh: those that get new values."""
    place = {c: i for i, c in enumerate(c for c in columns if c not in own)}
    return [(fresh[c] if c in fresh else F.col(REST)[f"c{place[c]}"] if c in place else F.col(c)).alias(c) for c in columns]
