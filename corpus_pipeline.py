"""A corpus pipeline from operators of lanternmill.llm: quality rules, line deduplication, near-duplicate removal,
mixing and packing. Each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternmill.llm import line_dedup, mixing, packing, quality_rules, scratch, simhash_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged by itself; texts pass through the judgement, so no join
    follows it. A null, empty or blank text has too few words and goes; so an empty table gives an empty one."""
    whole = docs.select("doc_id", "lang", "text", scratch.whole_row(docs).alias("_row"))
    judged = quality_rules.judge(whole, "_row")
    # not where(): a filter would be pushed below the judgement and work all of it out twice
    return judged.select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("row")).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line resembles; n_chars follows the text. A null text stays null; rows
    that repeat a doc_id keep the same line numbers; a text whose lines all go is empty."""
    out = line_dedup.remove_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*map(scratch.quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are near duplicates, by SimHash of five-word shingles and exact Jaccard of 0.8
    or more: the one with the smallest doc_id, of rows that share it the first; rows without a doc_id come last. Null,
    empty and blank texts are one group. Other columns are passed on."""
    rows = simhash_texts.with_row_keys(docs)
    return rows.join(simhash_texts.repeats(rows), simhash_texts.ROW, "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mix, which the files and their rows keep. A null source is a source of its own; null
    texts and ids and repeated rows are rows like any other."""
    return mixing.in_mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece; sequences take neighbours in the mix, by file and row. A null text has its end id alone; repeated
    rows are packed each."""
    return packing.pack_documents(docs, in_order=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("mixing", mix), ("best_fit_packing", pack)]

#: Packing can't be written in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.saved(stage(spark, docs, sf_dir), name)
    return docs
