"""Foreground masks, boxes and audit rows of images, from long pixel tables or from Spark's image source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.boxes import label_line, normalised
from tarnwork.functions.images import measure
from tarnwork.functions.reproducibility import parameters_hash
from tarnwork.schemas import BOX_AUDIT
from tarnwork.scratch import staged


def raster(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """Long form (key, y, x, value) of a flat array of pixels."""
    return df.select(key, F.posexplode(values).alias("pos", "value")).select(key, F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).alias("x"), "value")


def extremes(foreground: DataFrame, key: str) -> DataFrame:
    """Bounding box and size of each key's foreground rows (y, x)."""
    return foreground.groupBy(key).agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"), F.count("*").alias("foreground_pixel_count"))


def border(pixels: DataFrame, height: int | Column, width: int | Column) -> DataFrame:
    """Top and bottom rows, left and right columns: corners come twice."""
    h, w = (F.lit(v) if isinstance(v, int) else v for v in (height, width))
    sides = F.filter(F.array(*[F.when(c, 1) for c in (F.col("y") == 0, F.col("y") == h - 1, F.col("x") == 0, F.col("x") == w - 1)]), lambda s: s.isNotNull())
    return pixels.withColumn("_side", F.explode(sides)).drop("_side")


def background(edge: DataFrame, key: str, channels: list[str]) -> DataFrame:
    """Median of each channel over the border."""
    return edge.groupBy(key).agg(*[F.median(c).alias(f"bg_{c}") for c in channels])


def distance(channels: list[str]) -> Column:
    total = sum((F.pow(F.col(c) - F.col(f"bg_{c}"), 2) for c in channels[1:]), F.pow(F.col(channels[0]) - F.col(f"bg_{channels[0]}"), 2))
    return F.sqrt(total)


def rgb_mask(pixels: DataFrame, key: str, channels: list[str], height, width, tolerance: float, delta: float, min_pixels: int) -> tuple[DataFrame, DataFrame]:
    """(foreground rows, verdict by key: background, border spread, count, reason).

    The background is the border's median; a border that spreads (population deviation) beyond ``tolerance``
    or fewer than ``min_pixels`` pixels farther than ``delta`` reject the key.
    """
    edge = border(pixels, height, width)
    bg = background(edge, key, channels)
    spread = edge.join(bg, key).groupBy(key).agg(F.stddev_pop(distance(channels)).alias("border_std"))
    marked = pixels.join(bg, key).where(distance(channels) > delta)
    counts = marked.groupBy(key).agg(F.count("*").alias("foreground_pixel_count"))
    verdict = bg.join(spread, key).join(counts, key, "left").fillna(0, ["foreground_pixel_count"])
    # the reasons are fixed values
    reason = F.when(F.col("border_std") > tolerance, "fondo no uniforme").when(F.col("foreground_pixel_count") < min_pixels, "foreground insuficiente")
    verdict = verdict.withColumn("rejection_reason", reason)
    good = verdict.where("rejection_reason IS NULL").select(key)
    return marked.join(good, key, "left_semi").select(key, "y", "x"), verdict


def alpha_mask(pixels: DataFrame, key: str, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(rows with alpha above ``threshold``, keys that are opaque throughout and so have no alpha mask)."""
    opaque = pixels.groupBy(key).agg(F.min("a").alias("low")).where("low = 255").select(key)
    return pixels.where(F.col("a") > threshold).join(opaque, key, "left_anti").select(key, "y", "x"), opaque


def background_mode(corners: DataFrame, key: str, channels: list[str], tolerance: int = 12) -> DataFrame:
    """TRANSPARENT_ALPHA if ``low_alpha`` < 255, UNIFORM_RGB if all corners are near the top-left one, else COMPLEX.

    ``corners``: key, corner (0 is top-left), channels, low_alpha (null without alpha).
    """
    lead = corners.where("corner = 0").select(key, *[F.col(c).alias(f"_{c}") for c in channels])
    far = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in channels]) if len(channels) > 1 else F.abs(F.col(channels[0]) - F.col(f"_{channels[0]}"))
    by = corners.join(lead, key).groupBy(key).agg(F.max(far).alias("far"), F.min("low_alpha").alias("low"))
    mode = F.when(F.col("low") < 255, "TRANSPARENT_ALPHA").when(F.col("far") <= tolerance, "UNIFORM_RGB").otherwise("COMPLEX")
    return by.select(key, mode.alias("background_mode"))


def boxed(df: DataFrame, class_id: int = 0) -> DataFrame:
    """Extremes with half-open ends, pixel centre and size, normalised label and its numbers."""
    c = F.col
    box = normalised(c("x_min"), c("y_min"), c("x_max"), c("y_max"), c("image_width_px"), c("image_height_px"))
    out = df.withColumns({"x0": c("x_min"), "y0": c("y_min"), "x1": c("x_max") + 1, "y1": c("y_max") + 1})
    out = out.withColumns({"box_width_px": c("x1") - c("x0"), "box_height_px": c("y1") - c("y0")})
    out = out.withColumns({"x_center_px": c("x0") + c("box_width_px") / 2, "y_center_px": c("y0") + c("box_height_px") / 2, "label_line": label_line(box, class_id)})
    numbers = F.split("label_line", " ")
    return out.withColumns({n: F.get(numbers, F.lit(k)).cast("double") for k, n in enumerate(("x_center", "y_center", "width", "height"), 1)})


def audit(assets: DataFrame, found: DataFrame, labels_dir: str, alpha_threshold: int, algorithm_version: str, class_id: int = 0, rgb: dict | None = None, compatible_hash: bool = False) -> DataFrame:
    """The 30-column audit row of every asset.

    ``assets``: source_asset_id, sku_id, image_path, image_width_px, image_height_px, source_sha256, reason (null
    unless rejected before a mask was made). ``found``: source_asset_id, mask_method, x_min ... foreground_pixel_count.
    A rejected asset keeps its row, with a reason, zeros and no label path. ``rgb``: parameters of the RGB mask, which
    enter the parameters hash unless ``compatible_hash``.
    """
    kept = assets.join(found, "source_asset_id", "left")
    empty = "Máscara vacía: no hay píxeles de foreground (rechazo, sin label)."  # fixed value
    reason = F.coalesce("reason", F.when(F.lit(class_id != 0), f"class_id debe ser 0; recibido: {class_id}"), F.when(F.col("x_min").isNull(), empty))
    kept = boxed(kept.withColumn("rejection_reason", reason), 0)
    good = F.col("rejection_reason").isNull()
    fixed = {
        "class_id": F.lit(class_id), "algorithm_version": F.lit(algorithm_version),
        "parameters_hash": F.lit(parameters_hash(alpha_threshold, algorithm_version, None if compatible_hash else rgb)),
        "mask_method": F.when(good, F.col("mask_method")).otherwise("alpha"),
        "label_path": F.when(good, F.concat(F.lit(labels_dir.rstrip("/") + "/"), "source_asset_id", F.lit(".txt"))).otherwise(""),
        "status": F.when(good, "accepted").otherwise("rejected"), "rejection_reason": F.coalesce("rejection_reason", F.lit("")),
    }
    zeroed = {"foreground_pixel_count", "x_min", "y_min", "x_max", "y_max", "x0", "y0", "x1", "y1", "x_center_px", "y_center_px", "box_width_px", "box_height_px", "x_center", "y_center", "width", "height"}
    pick = lambda n: fixed.get(n, F.when(good, F.col(n)).otherwise(0) if n in zeroed else F.coalesce(n, F.lit(0)) if n in ("image_width_px", "image_height_px") else F.col(n))
    return kept.select(*[pick(n).cast(t).alias(n) for n, t in BOX_AUDIT.items()], F.when(good, F.col("label_line")).alias("label_line"))


def audit_images(images: DataFrame, labels_dir: str, alpha_threshold: int = 127, algorithm_version: str = "pixel-extremes-v1", class_id: int = 0, rgb: dict | None = None, compatible_hash: bool = False) -> DataFrame:
    """Audit rows of an image table: source_asset_id, sku_id, image_path, source_sha256, image (Spark's struct, may be undecodable).

    The alpha mask comes first; images that are opaque throughout take the RGB mask if ``rgb`` gives tolerance, delta and min_pixels.
    """
    key = "source_asset_id"
    found = staged(measure(images, key, alpha_threshold, rgb), "measured")  # a row an image; decoding is not repeated
    size = lambda c: F.greatest(F.coalesce(f"image.{c}", F.lit(0)), F.lit(0)).alias(f"image_{c}_px")
    assets = images.select(key, "sku_id", "image_path", size("width"), size("height"), "source_sha256").join(found.select(key, "reason"), key, "left")
    return audit(assets, found.where("x_min IS NOT NULL").drop("reason"), labels_dir, alpha_threshold, algorithm_version, class_id, rgb, compatible_hash)
