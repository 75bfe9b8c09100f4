"""The chunk collection as a table, and parsed documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternmill.session import deleted, shared_path


#: What a stored row has besides the collection's own columns.
_OWN = "gone boolean, batch int"


def _batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that were written whole: those whose folder has the mark of Spark's committer."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch=*/_SUCCESS")
    found = there.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(there) or []
    return sorted(int(str(f.getPath().getParent().getName()).split("=")[1]) for f in found)


def create_collection(spark: SparkSession, path: str, schema: str, force: bool = False) -> DataFrame:
    """The collection at a path; made empty where there is none, or anew with force. A collection is a table of batches,
    each in folders by year; see upsert_collection."""
    if force:
        deleted(spark, path)
    return collection(spark, path, schema)


def collection(spark: SparkSession, path: str, schema: str, key: str = "point_id") -> DataFrame:
    """The live rows: of each key the one of the newest whole batch. A filter on year reads the folders of these years
    only, as a key's rows are settled year by year; other keys are pruned by the statistics of Parquet."""
    numbers = _batches(spark, path)
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    if not numbers:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, {_OWN}").parquet(path).where(F.col("batch").isin(numbers))
    if len(numbers) > 1:
        newest = Window.partitionBy("year", key).orderBy(F.desc("batch"))
        rows = rows.withColumn("_place", F.row_number().over(newest)).where("_place = 1")
    return rows.where("gone is null").select(*names)


def upsert_collection(spark: SparkSession, path: str, schema: str, new: DataFrame, key: str = "point_id") -> None:
    """Writes rows over those with the same key; all others stay, whatever is not among the new rows.

    One batch is written beside the earlier ones, whose files are not touched: a run that is lost leaves the collection
    as it was, as readers pass over a batch without Spark's mark, and the next run writes over it. So it costs what is
    new, and a look at keys and years of what is there. A key that moves to another year leaves a row there that says
    so. Of new rows that share a key one stays, by the rows' hash; rows without a key are one. One writer at a time.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    number = max(_batches(spark, path), default=-1) + 1
    one = Window.partitionBy(key).orderBy(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in names]))
    staged = shared_path(spark, "new-points")
    new.select(*names).withColumn("_place", F.row_number().over(one)).where("_place = 1").drop("_place").write.parquet(staged)
    rows = spark.read.schema(schema).parquet(staged)
    there = collection(spark, path, schema, key).select(key, F.col("year").alias("_year"))
    moved = there.join(rows.select(key, "year"), key).where(~F.col("_year").eqNullSafe(F.col("year"))).select(key, F.col("_year").alias("year"), F.lit(True).alias("gone"))
    both = rows.withColumn("gone", F.lit(None).cast("boolean")).unionByName(moved, allowMissingColumns=True)
    both.write.mode("overwrite").partitionBy("year").parquet(f"{path.rstrip('/')}/batch={number}")
    deleted(spark, staged)


def compact_collection(spark: SparkSession, path: str, schema: str, key: str = "point_id") -> None:
    """Puts the live rows into one batch and removes those before it, the oldest first, so that a row that is gone never
    comes back, wherever the run is lost. Readers that began before see missing files; run it between them."""
    before = _batches(spark, path)
    if len(before) > 1:
        live = collection(spark, path, schema, key).withColumn("gone", F.lit(None).cast("boolean"))
        live.write.mode("overwrite").partitionBy("year").parquet(f"{path.rstrip('/')}/batch={before[-1] + 1}")
        for number in before:
            deleted(spark, f"{path.rstrip('/')}/batch={number}")


def check_dimension(collection: DataFrame, dim: int) -> None:
    """An error if the collection holds a vector of another length."""
    if collection.where(f"vector is not null and size(vector) <> {int(dim)}").limit(1).count():
        raise ValueError(f"the collection has vectors of other lengths than {dim}")


def write_documents(documents: DataFrame, path: str, as_json: bool = False) -> None:
    """Parsed documents, atomically: readers see all files or, until the commit, none."""
    writer = documents.write.mode("overwrite")
    writer.json(path) if as_json else writer.parquet(path)
    if as_json:
        count_header(documents).coalesce(1).write.mode("overwrite").json(f"{path}_header")


def count_header(documents: DataFrame) -> DataFrame:
    """total_documents, generated_at: what heads a file of parsed documents."""
    return documents.agg(F.count("*").alias("total_documents")).withColumn("generated_at", F.current_timestamp().cast("string"))
