"""Tables in the folder that all machines share.

Iterative operators cut their lineage by writing a table and reading it back, so a lost executor costs
one read and not a recomputation of every round.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: str | None = None
_open: list[list[Saved]] = []


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and Spark is local."""
    global _own
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="lanternmill-")
    return _own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Spark's setting key is value for what runs within, and then what it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Saved:
    """A table written once, with options of the writer: `df` reads it, `drop()` deletes it when nothing needs it any more.

    The shuffle files behind it go as soon as it is written: whatever reads it later reads its files.
    """

    def __init__(self, df: DataFrame, name: str, **options: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        with setting(self.spark, _CLEANUP, "true"):  # Spark removes the shuffle files of what runs within when it has ended
            df.write.options(**options).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if _open:
            _open[-1].append(self)

    def drop(self) -> None:
        delete(self.spark, self.path)


@contextlib.contextmanager
def passing():
    """Tables saved within are deleted at its end, but for those that keep() was called on."""
    _open.append([])
    try:
        yield
    finally:
        for table in _open.pop():
            table.drop()


def keep(table: Saved) -> Saved:
    """Hands a table to the caller of the innermost passing()."""
    _open[-1].remove(table)
    if len(_open) > 1:
        _open[-2].append(table)
    return table


def saved(df: DataFrame, name: str) -> DataFrame:
    return Saved(df, name).df


def quoted(name: str) -> str:
    """A column's name as Spark takes it, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that none of them can clash with a working column."""
    return F.struct(*map(quoted, df.columns))


def delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def file_system(uri: str):
    """(file system, path in it) for Python code that writes or reads plain files on executors."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri[5:] if uri.startswith("file:") else uri
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
