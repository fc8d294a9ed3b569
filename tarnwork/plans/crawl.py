"""The whole crawl as tables: product pages, their metadata, images, keep-first manifest, rejections, reconciliation.

Every product goes through the same ordered checks; the first that fails is its rejection reason. Pages and
images are fetched by one task, so that a polite client's pauses hold; each answer is staged, so a later stage that
is run again does not fetch again. Running a crawl again over its own outputs adds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import html, identity, images, urls
from tarnwork.operators import manifest as merging
from tarnwork.schemas import REJECTIONS, SOURCE_ASSETS
from tarnwork.scratch import staged
from tarnwork.sources import readers, sinks
from tarnwork.sources.web import Response

VERSION = "tarnwork-crawl-1"
#: (address, bytes at most or null) -> answer; it may raise.
Get = Callable[[str, int | None], Response]


def rejection(page: Column, image: Column, at: str, run_id: str, reason: Column) -> list[Column]:
    """The five fields of a rejection record."""
    parts = (page, F.coalesce(image, F.lit("")), F.lit(at), F.lit(run_id), reason)
    return [c.cast("string").alias(n) for c, n in zip(parts, REJECTIONS)]


def fetched(rows: DataFrame, get: Get, allowed: Callable[[str], bool], url_col: str, prefix: str, max_bytes: int | None = None) -> DataFrame:
    """``rows`` with robots_, status, type, body and error of their address, prefixed; null addresses are not asked for."""
    kept = rows.columns
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + f", robots_{prefix} boolean, {prefix}_status int, {prefix}_type string, {prefix}_body binary, {prefix}_error string"

    def ask(url: str | None) -> tuple:
        if url is None:
            return None, None, None, None, None
        if not allowed(url):
            return False, None, None, None, None
        try:
            a = get(url, max_bytes)
            return True, a.status, a.content_type, a.body, None
        except Exception as e:  # noqa: BLE001  (whatever goes wrong is this product's reason)
            return True, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = pd.DataFrame([ask(u) for u in batch[url_col]], columns=schema_names, dtype=object)
            yield pd.concat([batch[kept].reset_index(drop=True), answers], axis=1)

    schema_names = [f"robots_{prefix}", *(f"{prefix}_{n}" for n in ("status", "type", "body", "error"))]
    return rows.coalesce(1).mapInPandas(run, schema)


def attempts(spark: SparkSession, products: list[str], get: Get, allowed: Callable[[str], bool], max_bytes: int) -> DataFrame:
    """One row per product: its page, metadata, image, what the image shows, and the reason of the first check that failed (or null)."""
    c = F.col
    asked = spark.createDataFrame([(u,) for u in products], "product_page_url string")
    pages = staged(fetched(asked, get, allowed, "product_page_url", "product"), "product-pages")
    good = c("product_status").eqNullSafe(200) & urls.is_html(c("product_type"))
    page = pages.withColumn("html", F.when(good, F.decode("product_body", "UTF-8")))
    parsed = html.parse(page.select("product_page_url", "html")).join(page.drop("product_body"), "product_page_url")
    known = html.product_metadata(parsed, "product_page_url").select(*[x for x in page.columns if x not in ("product_body", "html")], "product_name", "description", "sku_id", "image_url", "metadata_reason")
    known = known.withColumn("wanted", F.when(good & c("metadata_reason").isNull(), c("image_url")))
    pictures = staged(fetched(known, get, allowed, "wanted", "image", max_bytes), "product-images")
    shown = images.inspect(pictures, "image_body")
    reason = merging.first_reason(merging.crawl_rules(max_bytes))
    return shown.withColumn("reason", reason).withColumn("sha256", identity.content_sha256(c("image_body")))


def assets(found: DataFrame, source: str, images_dir: str, run_id: str, at: str, rights: str = "REDISTRIBUTION_PROHIBITED") -> DataFrame:
    """Manifest rows (and name and bytes of the file) of the attempts without a reason."""
    c = F.col
    good = found.where("reason IS NULL").withColumn("file_name", urls.file_name(c("sku_id"), c("sha256"), urls.extension(c("image_format"), c("image_type"))))
    key = identity.asset_key(F.lit(source), c("product_page_url"), c("image_url"), c("sha256"))
    made = {
        "source_asset_id": identity.asset_id(key), "source_name": F.lit(source), "product_page_url": urls.canonical(c("product_page_url")), "retrieved_at": F.lit(at), "retrieval_run_id": F.lit(run_id),
        "http_status": c("image_status"), "content_type": urls.mime(c("image_type")), "scraper_version": F.lit(VERSION), "duplicate_group_id": identity.duplicate_group_id(c("image_body")),
        "rights_status": F.lit(rights), "acceptance_status": F.lit("ACCEPTED"), "rejection_reason": F.lit(""), "local_path": F.concat(F.lit(images_dir.rstrip("/") + "/"), "file_name"),
    }
    return good.select(*[made.get(n, c(n)).cast("string").alias(n) for n in SOURCE_ASSETS], "file_name", "image_body")


def _identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_identity", identity.asset_key(*[F.col(n) for n in ("source_name", "product_page_url", "image_url", "sha256")]))


def run(spark: SparkSession, products: list[str], get: Get, allowed: Callable[[str], bool], config: dict, full: bool = True, collection_pages: int | None = None) -> dict:
    """Crawl ``products`` and bring manifest, rejections, image files and summary up to date; the summary.

    A full crawl adds each rejection once (by page, image and reason), a smoke test every time.
    """
    outputs, run_id, at = config["outputs"], uuid.uuid4().hex, datetime.now(UTC).isoformat()
    found = staged(attempts(spark, products, get, allowed, int(config["limits"]["max_image_bytes"])), "attempts")
    new = assets(found, config["source"]["name"], outputs["images_dir"], run_id, at)
    prior = staged(readers.source_assets(spark, outputs["manifest"]), "prior-assets")  # their files are replaced below
    past = staged(readers.rejections(spark, outputs["rejects"]), "prior-rejections")
    fresh = _identified(new.select(*SOURCE_ASSETS))
    kept = staged(merging.merge_keep_first(_identified(prior), fresh, "source_asset_id", "_identity", ["product_page_url", "image_url"]).select(*SOURCE_ASSETS), "assets")
    failed = found.where("reason IS NOT NULL").select(*rejection(F.col("product_page_url"), F.col("image_url"), at, run_id, F.col("reason")))
    rejected = merging.merge_rejections(past, failed, ["product_page_url", "image_url", "rejection_reason"], ["product_page_url"]) if full else past.unionByName(failed)
    rejected = staged(rejected, "rejections")
    sinks.blobs(new.join(kept.select("source_asset_id"), "source_asset_id", "left_semi"), outputs["images_dir"], "file_name", "image_body")
    sinks.csv(kept.orderBy("source_asset_id"), outputs["manifest"], SOURCE_ASSETS)
    sinks.csv(rejected, outputs["rejects"], REJECTIONS)
    there = readers.files(spark, outputs["images_dir"]).select(F.concat(F.lit(outputs["images_dir"].rstrip("/") + "/"), F.element_at(F.split("path", "/"), -1)).alias("path")) if kept.count() else spark.createDataFrame([], "path string")
    summary = merging.check_reconciled(merging.reconcile(kept, rejected, there))
    summary |= {"retrieval_run_id": run_id, "selected_products": len(products), "accepted_this_run": kept.count() - prior.count(), "rejected_this_run": rejected.count() - past.count()}
    if full and collection_pages is not None:
        summary["collection_pages"] = collection_pages
    sinks.json_document(summary, outputs["summary"])
    return summary

