"""A session with the settings that the queries expect."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; master and other settings as given, else Spark's own."""
    builder = SparkSession.builder.appName("lanternmill").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.master(master) if master else builder
    return builder.config(map=conf).getOrCreate()


def table(spark: SparkSession, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of input, about one task's share of a file, below which rows are dealt over all cores before long work on them.
SMALL = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt evenly over the cores if it reads less than SMALL bytes: one row group of a small file is one
    task's work. Larger inputs are left to their readers, which split them without a shuffle."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if read < SMALL else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which all machines share; below a temporary folder only where it is unset
    and Spark is local."""
    import tempfile
    import uuid

    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lanternmill-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def without_shuffle_files(spark: SparkSession):
    """Spark removes the shuffle files of what is written within as soon as it is written, and not when it collects
    garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what several branches of a plan read."""
    path = shared_path(df.sparkSession, name)
    with without_shuffle_files(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library wrote, where there is one."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
