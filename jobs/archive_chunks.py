"""Keeps a collection of labelled chunks up to date with a folder of documents that grows.

    python -m jobs.archive_chunks DOCUMENTS COLLECTION CHECKPOINT [--config FILE]

A file stream takes the Parquet files (doc_id, text, lang, source) that were not there before, cleans and cuts the texts,
labels each chunk and each document by the lexicon, and appends those in the index scope. A document that comes again
replaces its earlier version.

The collection is one table, COLLECTION/batch=<n>/lang=<language>. A micro-batch writes its own batch folder and no other:
if it comes twice, it finds the same files in the checkpoint and overwrites what it had begun, and a version that is
replaced stays where it is. `current` reads the newest version of every document.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from jobs.settings import main
from lanternmill.functions.text import replace_broken_punctuation
from lanternmill.functions.values import point_id
from lanternmill.operators import chunks, scope

log = logging.getLogger("jobs.archive_chunks")

DOCUMENTS = "doc_id long, text string, lang string, source string"
COLLECTION = (
    "source_id string, section string, article_country_scope string, total_chunks int, chunk_index int, chunk_id string, point_id string, text string, country_scope string, scope_signals array<string>, "
    "batch int, lang string"
)
#: What a document that is not indexed leaves null in its one row.
CHUNK = ("chunk_index", "chunk_id", "point_id", "text", "country_scope", "scope_signals")


def newest_versions(files: DataFrame) -> DataFrame:
    """One row of each document: that of the file written last, of equal ones the last by path, then by the text's hash.
    A row without doc_id is the document of its text; so repeated rows are one document. Each task keeps one row a
    document before the shuffle."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.sha1(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    last = Window.partitionBy("source_id").orderBy(F.desc("written"), F.desc("file"), F.desc(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))))
    rows = files.withColumn("source_id", own).withColumn("place", F.row_number().over(last)).where("place = 1")
    return rows.select("source_id", F.coalesce("text", F.lit("")).alias("text"), F.nullif("lang", F.lit("")).alias("lang"), F.col("source").alias("section"))


def labelled(documents: DataFrame, config: dict) -> DataFrame:
    """A row a chunk of the documents in scope, with all that a search filters by; a document out of scope, or without
    text, is one row without a chunk, so that it hides its earlier version. Documents are already dealt by their id, so
    that an article's scope is a window that shuffles nothing."""
    lexicon = scope.Lexicon(**config["lexicon"])
    pieces = chunks.windows(replace_broken_punctuation(F.col("text")), config["chunk_size"], config["overlap"])
    cut = documents.select("source_id", "lang", "section", pieces.alias("pieces"))
    rows = cut.select("source_id", "lang", "section", F.size("pieces").alias("total_chunks"), F.posexplode_outer("pieces").alias("chunk_index", "text"))
    label = scope.lexical_scope(F.coalesce("text", F.lit("")), F.col("section"), F.array().cast("array<string>"), lexicon)
    rows = rows.withColumn("s", label).select("*", F.col("s.scope").alias("country_scope"), F.col("s.signals").alias("scope_signals")).drop("s")
    rows = scope.with_article_scope(rows).withColumn("chunk_id", F.concat_ws("::", "source_id", F.lit("chunk"), F.col("chunk_index").cast("string")))
    rows = rows.withColumn("point_id", point_id(F.col("chunk_id"), F.col("text")))
    wanted = F.col("text").isNotNull() & scope.in_index_scope(F.col("article_country_scope"), F.col("country_scope"), config["index_scope"])
    rows = rows.withColumn("wanted", wanted).where(F.col("wanted") | (F.coalesce("chunk_index", F.lit(0)) == 0))
    return rows.withColumns({c: F.when(F.col("wanted"), F.col(c)) for c in CHUNK})


def run(spark: SparkSession, documents: str, collection: str, checkpoint: str, config: dict) -> None:
    """Takes the files of `documents` (a folder, or a pattern of files) that the checkpoint does not know, and stops. A
    checkpoint that starts anew over a collection that has later batches is an error: they would hide what it writes."""
    names = [c.strip().split(" ")[0] for c in COLLECTION.split(", ")]
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(documents)
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"))
    spark.createDataFrame([], COLLECTION).write.mode("ignore").partitionBy("batch", "lang").parquet(collection)

    def take(batch: DataFrame, number: int) -> None:
        if number == 0 and not spark.read.schema(COLLECTION).parquet(collection).where("batch > 0").isEmpty():
            raise ValueError(f"{checkpoint} is not the checkpoint that {collection} was written with")
        read, wrote = Observation(), Observation()
        rows = batch.observe(read, F.count(F.lit(1)).alias("rows"))
        rows = labelled(newest_versions(rows), config).observe(wrote, F.count("chunk_index").alias("chunks"), F.count_if(F.coalesce("chunk_index", F.lit(0)) == 0).alias("documents"))
        rows.select(*[c for c in names if c != "batch"]).write.mode("overwrite").partitionBy("lang").parquet(f"{collection.rstrip('/')}/batch={number}")
        log.info("batch %d: read %d rows of %s, wrote %d documents with %d chunks to %s", number, read.get["rows"], documents, wrote.get["documents"], wrote.get["chunks"], collection)

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s is up to date with %s", collection, documents)


def current(spark: SparkSession, collection: str) -> DataFrame:
    """The chunks of the newest version of each document. Only documents with several versions are looked for, by their
    ids; no text is shuffled as long as these are few."""
    rows = spark.read.schema(COLLECTION).parquet(collection)
    again = rows.groupBy("source_id").agg(F.max("batch").alias("newest"), F.min("batch").alias("oldest")).where("newest > oldest")
    replaced = (rows["source_id"] == again["source_id"]) & (rows["batch"] < again["newest"])
    return rows.join(again, replaced, "left_anti").where("chunk_index is not null").drop("batch")


if __name__ == "__main__":
    main("archive_chunks", run, "documents", "collection", "checkpoint")
