"""Dates, vectors, ids and urls as columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_DATE = "1900-01-01"


def date_of(value: Column) -> Column:
    """The date in the first ten characters, else a stand-in for unknown."""
    return F.coalesce(F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd"), F.lit(UNKNOWN_DATE).cast("date"))


def decade_of(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def coerce_date(value: Column) -> Column:
    """An ISO prefix as a date's text, anything else as it is, trimmed."""
    return F.coalesce(F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd").cast("string"), F.trim(value))


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 for empty or zero vectors and for lengths that differ."""
    doubles = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    a, b = doubles(a), doubles(b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def name_uuid(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The version-5 UUID of a name: SHA-1 of namespace and name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda start, n: F.substring(digest, start, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def point_id(chunk_id: Column, text: Column) -> Column:
    """A chunk's id as a UUID; without one, that of its text's SHA-1."""
    return name_uuid(F.coalesce(F.nullif(chunk_id, F.lit("")), F.sha1(F.encode(text, "UTF-8"))))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


# Path fragments of pages that are not articles.
BLOCKED_PATHS = ("/buscador", "/secciones", "/tags", "/usuarios", "/edicion-impresa", "/rss")


def is_article_url(url: Column, hosts: list[str] | None = None) -> Column:
    """A path other than the root without a blocked fragment, on one of the hosts (any if none are given) or on none."""
    host, path = url_host(url), url_path(url)
    ok = (path != "") & (path != "/")
    for part in BLOCKED_PATHS:
        ok = ok & ~path.contains(part)
    return ok & ((host == "") | host.isin(hosts)) if hosts else ok


def url_date(url: Column) -> Column:
    """The valid date before .html at the end of a path."""
    return F.try_to_date(F.regexp_extract(url_path(url), r"-(\d{4}-\d{2}-\d{2})\.html$", 1), "yyyy-MM-dd")


def is_archive_url(url: Column, expected: Column | None = None) -> Column:
    path = url_path(url)
    name = F.element_at(F.split(path, "/"), -1)
    ok = path.startswith("/diario/") & ~path.startswith("/diario/secciones/") & ~path.startswith("/diario/principal/") & ~name.startswith("index-") & url_date(url).isNotNull()
    return ok if expected is None else ok & (url_date(url) == expected)


def url_section(url: Column) -> Column:
    parts = F.split(F.ltrim(url_path(url), F.lit("/")), "/")
    second, third = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    extra = (second == "suplementos") & third.isNotNull()
    return F.when((F.get(parts, F.lit(0)) == "diario") & (F.size(parts) >= 3), F.when(extra, F.concat(F.lit("suplementos/"), third)).otherwise(second))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def safe_file_name(name: Column) -> Column:
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"[^a-zA-Z0-9._-]+", "-")
    return F.when(base.endswith(".html"), base).otherwise(F.concat(base, F.lit(".html")))


def date_argument(value: Column) -> Column:
    """A date given as DD-MM-YYYY; anything else is an error."""
    ok = F.when(value.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_date(value, "dd-MM-yyyy"))
    return F.coalesce(ok, F.raise_error(F.concat(F.lit("not a date as DD-MM-YYYY: "), F.coalesce(value, F.lit("null")))).cast("date"))


def edition_urls(day: Column, base: str) -> Column:
    """Where the front page of a day's edition may be."""
    iso, place = F.date_format(day, "yyyy-MM-dd"), lambda *parts: F.concat(F.lit(base), *parts)
    return F.array(
        place(F.lit("/diario/secciones/index-"), iso, F.lit(".html")), place(F.lit("/diario/principal/index-"), iso, F.lit(".html")),
        place(F.date_format(day, "/yyyy/MM-yyyy"), F.lit("/dia/"), F.date_format(day, "dd-MM-yyyy"), F.lit(".html")),
    )


def day_folder(day: Column) -> Column:
    """Year and month of a day as folders."""
    return F.date_format(day, "yyyy/MM")


def article_path(day: Column, url: Column) -> Column:
    """Where the page of a url is kept: in its day's folder under a safe name."""
    return F.concat_ws("/", day_folder(day), safe_file_name(url_path(url)))


def resolved(path: Column) -> Column:
    """A path without . and .. steps."""
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    tail = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
