"""Synthetic samples: a split manifest, images of one rectangle each, a small detection set with labels."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.images import png

SIDE = 64


def rectangles(spark: SparkSession, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """split, name, label_line, content: PNGs of a dark rectangle on a light ground; every image has a generator of its own."""
    rows = spark.createDataFrame([(split, n) for split, n in counts.items()], "split string, n int")
    rows = rows.select("split", F.explode(F.sequence(F.lit(1), "n")).alias("nth")).withColumn("name", F.format_string("fixture_%s_%04d", "split", "nth"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                rng = np.random.default_rng([seed, *r.name.encode()])
                wide, high = (int(v) for v in rng.integers(SIDE // 4, SIDE // 2, 2))
                left, top = int(rng.integers(2, SIDE - wide - 2)), int(rng.integers(2, SIDE - high - 2))
                pixels = np.full((SIDE, SIDE, 3), rng.integers(180, 255, 3), np.uint8)
                pixels[top : top + high, left : left + wide] = rng.integers(0, 80, 3)
                box = ((left + wide / 2) / SIDE, (top + high / 2) / SIDE, wide / SIDE, high / SIDE)
                out.append((r.split, r.name, "0 " + " ".join(f"{v:.6f}" for v in box), png(pixels)))
            yield pd.DataFrame(out, columns=["split", "name", "label_line", "content"])

    return rows.mapInPandas(draw, "split string, name string, label_line string, content binary")


def detection_set(spark: SparkSession, folder: str, counts: dict[str, int], seed: int = 42) -> None:
    """``images/<split>``, ``labels/<split>`` and ``dataset.yaml`` under ``folder``."""

    def write(rows) -> None:
        for r in rows:
            for kind, name, body in (("images", f"{r['name']}.png", bytes(r["content"])), ("labels", f"{r['name']}.txt", (r["label_line"] + "\n").encode())):
                place = Path(folder) / kind / r["split"]
                place.mkdir(parents=True, exist_ok=True)
                (place / name).write_bytes(body)

    rectangles(spark, counts, seed).foreachPartition(write)
    splits = "".join(f"{s}: images/{s}\n" for s in counts)
    (Path(folder) / "dataset.yaml").write_text(f"path: {Path(folder).absolute()}\n{splits}names:\n  0: product\n")


def audit_sample(folder: str) -> None:
    """Five images: four with a shape on a clear ground, one with nothing on it, which an audit rejects."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for k, (top, left, high, wide) in enumerate([(1, 2, 5, 5), (0, 0, 10, 9), (3, 3, 4, 2), (5, 1, 5, 9), (0, 0, 0, 0)], 1):
        pixels = np.zeros((10, 10, 4), np.uint8)
        pixels[top : top + high, left : left + wide] = (30, 60, 90, 255)
        (out / f"SKU{k:03d}_sample.png").write_bytes(png(pixels))
