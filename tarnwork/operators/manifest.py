"""Manifest maintenance: ordered rejection reasons, keep-first merges, reconciliation, crawl summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[Column, str | Column]]) -> Column:
    """The reason of the first rule that fails (a rule holds for rows to reject), or null."""
    out = None
    for failed, reason in rules:
        out = F.when(failed, reason) if out is None else out.when(failed, reason)
    return out if out is not None else F.lit(None).cast("string")


def crawl_rules(max_bytes: int) -> list[tuple[Column, str | Column]]:
    """The checks of one fetched product and its image, in the order in which they are made (``plans.crawl`` has the columns)."""
    from tarnwork.functions.urls import extension, is_html, is_image

    c = F.col
    return [
        (~c("robots_product"), "PermissionError: ROBOTS_PRODUCT_BLOCKED"),
        (c("product_error").isNotNull(), c("product_error")),
        (F.coalesce(c("product_status"), F.lit(0)) != 200, "RuntimeError: PRODUCT_HTTP_NOT_200"),
        (~is_html(c("product_type")), "ValueError: PRODUCT_NOT_HTML"),
        (c("metadata_reason").isNotNull(), F.concat(F.lit("ValueError: "), "metadata_reason")),
        (~c("robots_image"), "PermissionError: ROBOTS_IMAGE_BLOCKED"),
        (c("image_error").isNotNull(), c("image_error")),
        (F.coalesce(c("image_status"), F.lit(0)) != 200, "RuntimeError: IMAGE_HTTP_NOT_200"),
        (F.length("image_body") > max_bytes, "RuntimeError: REJECTED_MAX_BYTES"),
        (~is_image(c("image_type")), "ValueError: IMAGE_NOT_IMAGE"),
        (~c("decoded"), "ValueError: IMAGE_UNDECODABLE"),
        (~F.coalesce(c("background_mode"), F.lit("COMPLEX")).isin("TRANSPARENT_ALPHA", "UNIFORM_RGB"), "ValueError: BACKGROUND_COMPLEX"),
        (extension(c("image_format"), c("image_type")).isNull(), "ValueError: IMAGE_FORMAT_NOT_ALLOWED"),
    ]


def _first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def merge_keep_first(prior: DataFrame, new: DataFrame, id_col: str, identity_col: str, order: list[str]) -> DataFrame:
    """``prior`` and the rows of ``new`` that it holds neither by id nor by identity key.

    Both keys count: older rows carry ids that were made by another formula. Within ``new`` the first row by
    ``order`` stays. Running it again over its own result changes nothing.
    """
    fresh = new.join(prior.select(id_col).distinct(), id_col, "left_anti")
    fresh = fresh.join(prior.select(identity_col).distinct(), identity_col, "left_anti").select(*new.columns)
    fresh = _first_of(_first_of(fresh, [id_col], order), [identity_col], order)
    return prior.unionByName(fresh.select(*prior.columns))


def merge_rejections(prior: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``prior`` and the new rejections whose key (null parts are empty) it lacks, each once."""
    filled = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    tag = lambda df: df.withColumn("_key", F.concat_ws("|", *filled))
    fresh = tag(new).join(tag(prior).select("_key").distinct(), "_key", "left_anti")
    return prior.unionByName(_first_of(fresh, ["_key"], order).drop("_key").select(*prior.columns))


def reconcile(manifest: DataFrame, rejections: DataFrame, files: DataFrame) -> DataFrame:
    """One row: accepted, rejected, attempted, files, missing, extra. ``manifest.local_path`` against ``files.path``."""
    listed = manifest.select(F.col("local_path").alias("path"))
    count = lambda df, n: df.agg(F.count("*").alias(n))
    out = count(manifest, "accepted")
    for df, n in ((rejections, "rejected"), (files, "files"), (listed.join(files, "path", "left_anti"), "missing"), (files.join(listed, "path", "left_anti"), "extra")):
        out = out.join(count(df, n))
    return out.withColumn("attempted", F.col("accepted") + F.col("rejected"))


def check_reconciled(counts: DataFrame) -> dict[str, int]:
    """The counts, or an error where files and manifest differ."""
    row = counts.first().asDict()
    if row["files"] != row["accepted"] or row["missing"] or row["extra"]:
        raise ValueError(f"Reconciliación inválida: {row}")
    return row


def summary(manifest: DataFrame, rejections: DataFrame) -> DataFrame:
    """One row: accepted, rejected, attempted."""
    tagged = manifest.select(F.lit(1).alias("ok")).unionByName(rejections.select(F.lit(0).alias("ok")))
    return tagged.agg(F.count_if(F.col("ok") == 1).alias("accepted"), F.count_if(F.col("ok") == 0).alias("rejected"), F.count("*").alias("attempted"))
