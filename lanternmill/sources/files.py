"""Reading archives of files, and writing what was parsed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternmill.functions.html import MIN_TEXT, author, plain_text, published, section, title
from lanternmill.functions.text import repair_mojibake

MANIFEST = "date string, source string, mechanism_used string, total_urls int, scraped_at string, urls array<struct<url:string,title:string,snippet:string,section:string>>"
SIDECAR = "source_url string, publication_date string, newspaper string, article_title string, section string, author string"


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "content")


def _text(content):
    """UTF-8 if it is valid, else Latin-1; a leading byte order mark goes."""
    decoded = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(decoded, "^﻿", "")


def read_markdown(spark: SparkSession, folder: str, min_chars: int = 10) -> DataFrame:
    """path, file_name, source_file (the path below the folder), text of all .md files with that much text. A folder that
    is not there, or has no such file, is an error."""
    rows = _files(spark, folder, "*.md")
    if rows.limit(1).isEmpty():
        raise FileNotFoundError(f"no .md file below {folder}")
    below = F.regexp_replace(F.element_at(F.split("path", f"{re.escape(folder.split('://')[-1].rstrip('/'))}/", 2), -1), "^/", "")
    return rows.select("path", "file_name", below.alias("source_file"), _text(F.col("content")).alias("text")).where(F.length(F.trim("text")) >= min_chars)


def read_pages(spark: SparkSession, folder: str, day: str | None = None) -> DataFrame:
    """The .html files below a folder with the .json of the same stem; where that is missing or malformed, its columns
    are null. Of one day: names ending in -YYYY-MM-DD.html, in the day's folder YYYY/MM if there is one."""
    if day:
        own = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{day[:4]}/{day[5:7]}")
        folder = own.toString() if own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own) else folder
    html = _files(spark, folder, f"*-{day}.html" if day else "*.html").select("path", "file_name", _text(F.col("content")).alias("html"))
    side = _files(spark, folder, "*.json").select(F.regexp_replace("path", r"\.json$", "").alias("stem"), F.from_json(F.col("content").cast("string"), SIDECAR).alias("meta"))
    return html.withColumn("stem", F.regexp_replace("path", r"\.html$", "")).join(side, "stem", "left").select("path", "file_name", "html", "meta.*")


def parse_pages(pages: DataFrame, min_text: int = MIN_TEXT) -> DataFrame:
    """source_id, title, section, author, published, text of read_pages rows with enough text."""
    text = repair_mojibake(plain_text(F.col("html")))
    html = F.col("html")
    rows = pages.select(F.coalesce("source_url", "path").alias("source_id"), title(html, F.col("article_title")).alias("title"), section(html, F.col("section")).alias("section"), author(html, F.col("author")).alias("author"), "newspaper", "source_url", published(html, F.col("publication_date")).alias("published"), text.alias("text"))
    return rows.where(F.length("text") >= min_text)


def read_manifest(spark: SparkSession, path: str, source: str) -> DataFrame:
    """date and the urls of url manifests; another source, or none, is an error."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    checked = F.when((F.col("source") == source) & F.col("urls").isNotNull(), F.col("urls")).otherwise(F.raise_error(F.lit("not a url manifest of this source")).cast("array<struct<url:string,title:string,snippet:string,section:string>>"))
    return rows.select("date", F.posexplode(checked).alias("pos", "u")).select("date", "pos", "u.*")


def write_manifest(urls: DataFrame, path: str, source: str, mechanism: str) -> None:
    """One JSON object for each date of columns date, pos, url, title, snippet, section."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "url", "title", "snippet", "section"))), lambda u: F.struct(u["url"].alias("url"), u["title"].alias("title"), u["snippet"].alias("snippet"), u["section"].alias("section")))
    rows = urls.groupBy("date").agg(listed.alias("urls"))
    rows.select("date", F.lit(source).alias("source"), F.lit(mechanism).alias("mechanism_used"), F.size("urls").alias("total_urls"), F.current_timestamp().cast("string").alias("scraped_at"), "urls").write.mode("overwrite").json(path)


def robots_blocked(lines: DataFrame, agent: str) -> DataFrame:
    """file, value: the prefixes that robots.txt files (columns pos, line and, for many, file) disallow to an agent; a
    group applies if its agent is * or a part of ours."""
    from pyspark.sql import Window

    field = F.lower(F.trim(F.substring_index("line", ":", 1)))
    value = F.trim(F.regexp_extract("line", r":([^#]*)", 1))
    file = F.col("file") if "file" in lines.columns else F.lit("")
    rows = lines.select(file.alias("file"), "pos", field.alias("field"), value.alias("value"))  # files of a few lines
    last = F.last(F.when(F.col("field") == "user-agent", F.lower("value")), ignorenulls=True).over(Window.partitionBy("file").orderBy("pos"))
    rows = rows.withColumn("agent", last).where((F.col("agent") == "*") | F.lit(agent.lower()).contains(F.col("agent")))
    return rows.where("field = 'disallow' and value <> ''").select("file", "value").distinct()
