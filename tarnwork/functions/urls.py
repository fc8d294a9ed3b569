"""URL, MIME and file-name expressions."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_ROOT, IMAGE_MARK = "https://amarket.com.bo", "/cdn/shop/files/"  # fixed values
EXTENSION_OF_FORMAT = {"JPEG": ".jpg", "PNG": ".png", "WEBP": ".webp"}  # fixed values
EXTENSION_OF_MIME = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp"}  # fixed values
HTML_TYPES = ["text/html", "application/xhtml+xml"]  # fixed values


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no query or fragment, no trailing slashes."""
    head = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(without_query(url), r"/+$", "")
    return F.when(F.length(head) == 0, bare).otherwise(F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare))))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def last_segment_sku(url: Column, folder: str = "products") -> Column:
    """The segment after ``/folder/`` if it is the last one and plain; else empty."""
    found = F.regexp_extract(F.regexp_replace(without_query(url), r"/+$", ""), rf"(?i)/{folder}/([^/?#]+)$", 1)
    return F.when(found.rlike(r"^[A-Za-z0-9._-]+$"), found).otherwise("")


def page_number(url: Column) -> Column:
    """The value of ``page=`` in the query, or null."""
    return F.nullif(F.regexp_extract(url, r"[?&]page=([0-9]+)", 1), F.lit("")).cast("int")


def mime(content_type: Column) -> Column:
    """Type without parameters, trimmed, in lower case; null if empty."""
    return F.nullif(F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))), F.lit(""))


def is_html(content_type: Column) -> Column:
    return F.coalesce(mime(content_type).isin(HTML_TYPES), F.lit(False))


def is_image(content_type: Column) -> Column:
    return F.coalesce(mime(content_type).startswith("image/"), F.lit(False))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def extension(image_format: Column, content_type: Column) -> Column:
    """By image format, else by MIME type, else null (to be rejected)."""
    return F.coalesce(_lookup(EXTENSION_OF_FORMAT, F.upper(image_format)), _lookup(EXTENSION_OF_MIME, mime(content_type)))


def file_name(sku: Column, sha256: Column, ext: Column) -> Column:
    return F.concat(sku, F.lit("_"), F.substring(sha256, 1, 12), ext)


def resolve(reference: str | None, base: str | None) -> str | None:
    """RFC 3986 resolution; None where either cannot be parsed."""
    try:
        return urljoin(base or "", reference or "")
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def absolute(reference: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve(r, b) for r, b in zip(reference, base)], dtype=object)


def image_of(url: str | None, page: str | None) -> str | None:
    """The shop's own form of an image address, or None."""
    full = resolve((url or "").replace("&amp;", "&"), page)
    try:
        parts = urlsplit(full or "")
    except ValueError:
        return None
    if IMAGE_MARK not in parts.path:
        return None
    return IMAGE_ROOT + parts.path[parts.path.index(IMAGE_MARK) :] + (f"?{parts.query}" if parts.query else "")


@F.pandas_udf(T.StringType())
def image_url(url: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([image_of(u, p) for u, p in zip(url, page)], dtype=object)


def labels_folder(path: Column) -> Column:
    """The last ``images`` segment of a path turned into ``labels``; null if there is none."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.rlike(r"(^|/)images(/|$)"), F.regexp_replace(p, r"^(.*/)?images((?:/(?!images(?:/|$))[^/]*)*)$", "$1labels$2"))


def has_extension(path: Column, *extensions: str) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(e.lstrip(".") for e in extensions) + r")$")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(.)\.[^.]*$", "$1")
