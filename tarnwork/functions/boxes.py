"""Box geometry: extremes, normalised label text, corners, overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def six(value: Column) -> Column:
    """Six decimals, ties to even on the exact binary value, without grouping."""
    return F.replace(F.format_number(value, 6), F.lit(","), F.lit(""))


def normalised(x_min: Column, y_min: Column, x_max: Column, y_max: Column, width: Column, height: Column) -> dict[str, Column]:
    """Centre and size of a pixel box (its far ends included) as shares of the image."""
    x1, y1 = x_max + 1, y_max + 1
    return {
        "x_center": (x_min + x1) / F.lit(2.0) / width,
        "y_center": (y_min + y1) / F.lit(2.0) / height,
        "width": (x1 - x_min) / width.cast("double"),
        "height": (y1 - y_min) / height.cast("double"),
    }


def label_line(box: dict[str, Column], class_id: int = 0) -> Column:
    """``class xc yc w h``."""
    if class_id != 0:
        raise ValueError(f"class_id debe ser 0; recibido: {class_id}")
    return F.concat_ws(" ", F.lit(str(class_id)), *[six(box[k]) for k in ("x_center", "y_center", "width", "height")])


def parsed_label(line: Column) -> Column:
    """class, cx, cy, w, h of a label line of five tokens, else null."""
    tokens = F.split(F.trim(line), r"\s+")
    numbers = [F.get(tokens, F.lit(k)).try_cast("double").alias(n) for k, n in ((1, "cx"), (2, "cy"), (3, "w"), (4, "h"))]
    return F.when(F.size(tokens) == 5, F.struct(F.get(tokens, F.lit(0)).try_cast("int").alias("class"), *numbers))


def corners(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """x0, y0, x1, y1 in pixels, not clipped."""
    return [(cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union; 0 where the union is empty."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    tall = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])
    union = area(a) + area(b) - wide * tall
    return F.when(union > 0, wide * tall / union).otherwise(0.0)


def four(value: Column) -> Column:
    return F.bround(value, 4)


def class_name(names: dict[int, str] | list[str], class_id: Column) -> Column:
    """The class's name, or its number as text."""
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    flat = [F.lit(x) for kv in pairs for x in (int(kv[0]), kv[1])]
    known = F.try_element_at(F.create_map(*flat), class_id) if flat else F.lit(None)
    return F.coalesce(known, class_id.cast("string"))
