"""Content hashes and stable identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwork.functions.urls import canonical, without_query


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


duplicate_group_id = content_sha256


def joined(*parts: Column) -> Column:
    """Parts with bars between them; null parts are empty."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def asset_key(source: Column, product_url: Column, image: Column, sha256: Column) -> Column:
    """The identity that survives a new image version: no query or fragment in the image address."""
    head = F.regexp_extract(image, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    bare = without_query(image)
    return joined(source, canonical(product_url), F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare))), sha256)


def asset_id(key: Column) -> Column:
    return F.sha2(key, 256)


def rejection_key(product_url: Column, image: Column, reason: Column) -> Column:
    return joined(product_url, image, reason)
