"""From pages to the collection, day by day and stage by stage."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from lanternmill.operators import archive, scope, store
from lanternmill.sources import files, tables

#: What a run may stop after; "preview" shows chunks and stores nothing.
STAGES = ("parse", "enrich", "preview", "all")


def days(first: dt.date, last: dt.date) -> Iterator[dt.date]:
    for k in range((last - first).days + 1):
        yield first + dt.timedelta(days=k)


def ingest_day(
    spark: SparkSession, folder: str, day: dt.date, collection: str, lexicon: scope.Lexicon, stage: str = "all", reset: bool = False, sections: list[str] | None = None,
    per_section: int | None = None, most: int | None = None, index_scope: str = "argentina", parsed: str | None = None,
) -> DataFrame:
    """Parses the day's pages below a folder, cuts and labels them, and writes what is in scope to the collection; gives
    the documents (stage parse), the chunks (enrich, all) or their preview. Points that are there already are replaced,
    all others stay, those of the same day too."""
    pages = files.read_pages(spark, folder, day.isoformat())
    return ingest_pages(spark, pages, collection, lexicon, stage, reset, sections, per_section, most, index_scope, parsed and f"{parsed}/{day:%Y/%m}/documents_{day:%d-%m-%Y}")


def ingest_pages(
    spark: SparkSession, pages: DataFrame, collection: str, lexicon: scope.Lexicon, stage: str = "all", reset: bool = False, sections: list[str] | None = None,
    per_section: int | None = None, most: int | None = None, index_scope: str = "argentina", parsed: str | None = None,
) -> DataFrame:
    """ingest_day for pages (as of read_pages) that come from anywhere."""
    if stage not in STAGES:
        raise ValueError(f"stage is one of {STAGES}")
    documents = store.wanted(files.parse_pages(pages), "source_id", sections, per_section, most)
    if parsed:
        tables.write_documents(documents, parsed, as_json=True)
    if stage == "parse":
        return documents
    chunks = archive.enrich(documents, lexicon)
    if stage == "enrich":
        return chunks
    if stage == "preview":
        return store.preview(chunks)
    there = tables.create_collection(spark, collection, archive.INDEX, reset)
    tables.upsert_collection(spark, collection, archive.INDEX, archive.index(chunks, index_scope, there.select("point_id", "vector")))
    return chunks


def ingest_range(spark: SparkSession, folder: str, first: dt.date, last: dt.date, collection: str, lexicon: scope.Lexicon, reset: bool = False, continue_on_error: bool = True, run: Callable = ingest_day, **options) -> DataFrame:
    """day, ok, error of each day of a range, run one after the other; only the first may reset the collection. A day that
    fails leaves the others alone, unless told to stop. The loop is over days, the work of each is Spark's."""
    rows = []
    for k, day in enumerate(days(first, last)):
        try:
            run(spark, folder, day, collection, lexicon, reset=reset and k == 0, **options)
            rows.append((day, True, None))
        except Exception as e:  # any failure of a day is that day's
            if not continue_on_error:
                raise
            rows.append((day, False, str(e).split("\n")[0]))
    return spark.createDataFrame(rows, "day date, ok boolean, error string")
