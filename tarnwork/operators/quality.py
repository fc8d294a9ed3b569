"""Dataset gates: label invariants, orphans, cross-split groups, reasons, background modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_box() -> Column:
    """Class 0, centre within the image, positive size of at most the image."""
    inside = [F.col(c).between(0, 1) for c in ("cx", "cy")] + [(F.col(c) > 0) & (F.col(c) <= 1) for c in ("w", "h")]
    out = F.coalesce(F.col("class") == 0, F.lit(False))
    for rule in inside:
        out = out & F.coalesce(rule, F.lit(False))
    return out


def label_invariants(labels: DataFrame) -> DataFrame:
    """One row: labels, invalid_boxes, assets with other than one label."""
    counts = labels.groupBy("source_asset_id").count().agg(F.count_if(F.col("count") != 1).alias("not_exactly_one"))
    return labels.agg(F.count("*").alias("labels"), F.count_if(~valid_box()).alias("invalid_boxes")).join(counts)


def orphans(images: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    """side (image or label) and key of every image without label and label without image."""
    left = images.select(key).distinct().join(labels.select(key), key, "left_anti").select(F.lit("image").alias("side"), key)
    right = labels.select(key).distinct().join(images.select(key), key, "left_anti").select(F.lit("label").alias("side"), key)
    return left.unionByName(right)


def check_no_orphans(images: DataFrame, labels: DataFrame, key: str = "stem", shown: int = 20) -> None:
    found = orphans(images, labels, key).orderBy("side", key).limit(shown).collect()
    if found:
        raise ValueError("huérfanos: " + ", ".join(f"{r['side']} {r[key]}" for r in found))


def gate(audit: DataFrame, labels: DataFrame, orphan_rows: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: a count for each rule, and ``passed`` if all are 0."""
    rejected = F.col("status") == "rejected"
    empty = F.length(F.coalesce("rejection_reason", F.lit(""))) == 0
    out = audit.agg(F.count_if(rejected & empty).alias("rejected_without_reason"), F.count_if(~rejected & F.col("background_mode").isin("COMPLEX", "NOT_ACCEPTABLE")).alias("bad_background"))
    out = out.join(labels.agg(F.count_if(~valid_box()).alias("invalid_boxes"))).join(orphan_rows.agg(F.count("*").alias("orphans"))).join(violations.agg(F.count("*").alias("cross_split")))
    total = F.col("rejected_without_reason") + F.col("bad_background") + F.col("invalid_boxes") + F.col("orphans") + F.col("cross_split")
    return out.withColumn("passed", total == 0)
