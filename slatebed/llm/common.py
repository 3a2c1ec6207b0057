"""What the operators of this folder share: tables, shared storage, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the bytes 9 to 13.
WORD_GAP = r"[ \x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text in order; none for an empty text."""
    return F.array_remove(F.split(text, WORD_GAP), "")


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, everything else untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session.

    Where the setting is absent, a session of this machine alone (local, as in
    tests) makes a folder once and remembers it; a cluster is refused, as its
    executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("slatebed.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
        found = tempfile.mkdtemp(prefix="slatebed-")
        spark.conf.set("slatebed.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/slatebed/{name}-{uuid.uuid4().hex}"


#: What is stored while a scratch or a stage is open, innermost last.
_OPEN: list[list[str]] = []
#: Shuffle files go when the query that made them has ended.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back.

    It cuts the lineage, so a lost executor costs a reread and no recomputing,
    and nothing needs the shuffle files of the write any more.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    if _OPEN:
        _OPEN[-1].append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by :func:`stored` that nothing reads any more."""
    _delete(spark, [df.stored_at for df in tables])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that are stored inside are deleted at its end, but for those put into the list that it gives."""
    kept: list[DataFrame] = []
    _OPEN.append([])
    try:
        yield kept
    finally:
        made, stay = _OPEN.pop(), {df.stored_at for df in kept}
        _delete(spark, [path for path in made if path not in stay])
        if _OPEN:
            _OPEN[-1].extend(path for path in made if path in stay)


#: Paths of the tables that a stage's result still reads.
_LEFT: list[str] = []


def as_stage(spark: SparkSession, work) -> DataFrame:
    """``work()`` as a stage of a pipeline, whose results are each written before the next stage is called.

    What the stage before has stored for its own use is deleted first.
    """
    _delete(spark, _LEFT)
    _LEFT.clear()
    _OPEN.append([])
    try:
        return work()
    finally:
        _LEFT.extend(_OPEN.pop())


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast if the rows, counted first, are few enough; else joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def numbered(df: DataFrame, carried: list[str], columns: list) -> DataFrame:
    """``row, uid`` and the given expressions of every row, stored.

    row holds the carried columns as they came, so none clashes with another;
    uid tells rows apart that are alike. It is written down, as numbers given
    anew at each reading need not be the same.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row")
    return stored(df.select(whole, F.monotonically_increasing_id().alias("uid"), *columns), "numbered")


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows inside of ``row``, columns as they came."""
    return df.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))
