"""Column lists and Spark schemas of the tables that the engine exchanges.

Fixed values: names and order are part of the file formats.
"""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE_ASSETS = "source_asset_id sku_id product_name description source_name product_page_url image_url retrieved_at retrieval_run_id http_status content_type scraper_version sha256 duplicate_group_id width_px height_px image_mode background_mode rights_status acceptance_status rejection_reason local_path".split()
REJECTIONS = "product_page_url image_url retrieved_at retrieval_run_id rejection_reason".split()
BOX_AUDIT = {
    "source_asset_id": "string", "sku_id": "string", "class_id": "int", "image_path": "string", "label_path": "string",
    "image_width_px": "int", "image_height_px": "int", "mask_method": "string", "algorithm_version": "string",
    "parameters_hash": "string", "foreground_pixel_count": "int", "x_min": "int", "y_min": "int", "x_max": "int",
    "y_max": "int", "x0": "int", "y0": "int", "x1": "int", "y1": "int", "x_center_px": "double", "y_center_px": "double",
    "box_width_px": "int", "box_height_px": "int", "x_center": "double", "y_center": "double", "width": "double",
    "height": "double", "source_sha256": "string", "status": "string", "rejection_reason": "string",
}
EXAMPLES = "source_asset_id string, categoria string, confianza double, iou double, hipotesis string"
HTTP_RESPONSES = "url string, status int, content_type string, body binary"
SPLITS = ("train", "val", "test")


def strings(names: list[str]) -> T.StructType:
    """A schema of text columns: identifiers keep their leading zeros."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
