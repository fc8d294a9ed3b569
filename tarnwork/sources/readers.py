"""Table and file sources."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tarnwork.functions.boxes import parsed_label
from tarnwork.functions.urls import has_extension, stem
from tarnwork.schemas import REJECTIONS, SOURCE_ASSETS, strings

CRAWLED, EVALUATED, ANY_IMAGE = (".jpg", ".png", ".webp"), (".jpg", ".jpeg", ".png"), (".jpg", ".jpeg", ".png", ".bmp", ".webp")  # fixed values


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with header, all columns as text; a missing file is an empty table."""
    try:
        return spark.read.csv(path, header=True, schema=schema, multiLine=True, quote='"', escape='"')
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def source_assets(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, strings(SOURCE_ASSETS))


def rejections(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, strings(REJECTIONS))


def typed_assets(assets: DataFrame) -> DataFrame:
    out = assets.withColumns({c: F.col(c).try_cast("int") for c in ("http_status", "width_px", "height_px")})
    return out.withColumn("retrieved_at", F.try_to_timestamp("retrieved_at"))


def files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ANY_IMAGE) -> DataFrame:
    """path, stem, length, content of the folder's files of these kinds (content is read only where used; Spark leaves out empty files)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(has_extension(F.col("path"), *extensions)).select("path", stem(F.col("path")).alias("stem"), "length", "content")


def images(spark: SparkSession, folder: str, keep_undecodable: bool = True) -> DataFrame:
    """image (Spark's struct; height -1 where undecodable), path and stem."""
    found = spark.read.format("image").option("dropInvalid", str(not keep_undecodable).lower()).load(folder)
    return found.select("image", F.col("image.origin").alias("path"), stem(F.col("image.origin")).alias("stem"))


def file_hashes(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ANY_IMAGE) -> DataFrame:
    """path, stem and sha256 of the folder's files, read block by block by the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sha256=[_streamed_hash(p) for p in batch.path])

    return files(spark, folder, extensions).select("path", "stem").mapInPandas(run, "path string, stem string, sha256 string")


def _streamed_hash(address: str, block: int = 1 << 20) -> str:
    store, path = FileSystem.from_uri(quote(re.sub(r"^file:/+", "file:///", address), safe=":/?&=@"))
    digest = hashlib.sha256()
    with store.open_input_stream(path) as f:
        while part := f.read(block):
            digest.update(part)
    return digest.hexdigest()


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """stem, gt_idx, class, cx, cy, w, h of every label line with five tokens."""
    lines = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(stem(F.col("_metadata.file_path")).alias("stem"), F.posexplode(F.split("value", r"\r?\n")).alias("gt_idx", "line"))
    return lines.select("stem", "gt_idx", parsed_label(F.col("line")).alias("b")).where("b IS NOT NULL").select("stem", "gt_idx", "b.*")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and path of a checksum manifest's lines."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^([0-9a-f]{64})\s+(.+)$", 1).alias("sha256"), F.regexp_extract("value", r"^([0-9a-f]{64})\s+(.+)$", 2).alias("path")).where("sha256 <> ''")


def synthetic_manifest(spark: SparkSession, n_skus: int = 30) -> DataFrame:
    """A manifest in which every 5th product has two images and every 7th shares the duplicate group before it."""
    i = F.col("i")
    products = spark.range(1, n_skus + 1).withColumnRenamed("id", "i")
    rows = products.select("i", F.explode(F.when(i % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("j"))
    number = F.lpad(i.cast("string"), 3, "0")
    return rows.select((i * 10 + F.col("j")).alias("row_idx"), F.concat(F.lit("SKU"), number).alias("sku_id"), F.concat(F.lit("A"), number, F.lit("_"), "j").alias("source_asset_id"), F.concat(F.lit("DUP_"), F.when(i % 7 == 0, i - 1).otherwise(i)).alias("duplicate_group_id"))
