"""The chunk store as tables: upserts, vector reuse, facets, what is already there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_all(df: DataFrame, filters: dict) -> DataFrame:
    """Equality on every key with a value; array columns match if any element does. Nulls in filters are left out."""
    kinds = dict(df.dtypes)
    tests = [F.array_contains(k, v) if kinds[k].startswith("array") else F.col(k) == v for k, v in filters.items() if v is not None]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def upsert(store: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """The last write of each key: later rows of new (by column seq) win over earlier ones and over the store."""
    both = store.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    return latest(both, key, "seq").drop("seq")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    best = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


def fill_vectors(rows: DataFrame, known: DataFrame, key: str, embed) -> DataFrame:
    """rows with the vector of known by key, or embed(row columns) where there is none: a keyed join, so a short answer
    of an embedder can't shift vectors."""
    joined = rows.join(known.select(key, F.col("vector").alias("_known")), key, "left")
    usable = F.col("_known").isNotNull() & (F.size("_known") > 0) & ~F.exists("_known", lambda x: x.isNull())
    return joined.withColumn("reused", F.coalesce(usable, F.lit(False))).withColumn("vector", F.when(F.col("reused"), F.col("_known")).otherwise(embed)).drop("_known")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n for each column in one pass; missing values count as 'missing'."""
    filled = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in columns])
    wide = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])).alias("f"))
    return wide.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return wanted.join(there, key, "left_anti")


def top_per_group(df: DataFrame, group: str, order: str, n: int | None) -> DataFrame:
    """The first n rows of each group in input order; None takes all, 0 or less none."""
    if n is None:
        return df
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_place") <= n).drop("_place")


def wanted(rows: DataFrame, order: str, sections: list[str] | None = None, per_section: int | None = None, most: int | None = None) -> DataFrame:
    """rows (section and others) of the sections wanted, whatever their case, a null one being "none"; of each section the
    first by `order`, then the first of all these."""
    named = F.lower(F.trim(F.coalesce("section", F.lit("none"))))
    rows = rows.where(named.isin([s.strip().lower() for s in sections if s.strip()])) if sections else rows
    rows = top_per_group(rows.withColumn("_section", named), "_section", order, per_section).drop("_section")
    return rows if most is None else rows.orderBy(order).limit(most)


def inspect(store: DataFrame, filters: dict, order: str, limit: int = 10, chars: int = 200) -> tuple[DataFrame, DataFrame]:
    """(the first rows under the filters with their texts cut short, the facets of these rows)."""
    from lanternmill.functions.text import truncate

    rows = where_all(store, filters).orderBy(order).limit(limit)
    there = [c for c in ("article_country_scope", "country_scope", "section") if c in store.columns]
    return rows.withColumn("text", truncate(F.coalesce("text", F.lit("")), chars)), facets(rows, there)


#: The columns that a preview of chunks shows.
PREVIEW = (
    "source_id", "chunk_id", "newspaper", "section", "article_title", "publication_date", "date_imputed", "year", "decade", "country_scope", "article_country_scope", "scope_signals",
    "primary_location", "location_mentions", "persons", "organizations", "chunk_index", "total_chunks",
)


def preview(chunks: DataFrame, chars: int = 800) -> DataFrame:
    """The columns that a preview shows, and the start of the text."""
    return chunks.select(*[c for c in PREVIEW if c in chunks.columns], F.substring("text", 1, chars).alias("text"))


def payload(documents: DataFrame, columns: list[str]) -> DataFrame:
    """point_id and a JSON payload of the columns, nulls left out."""
    return documents.select("point_id", F.to_json(F.struct(*columns)).alias("payload"))
