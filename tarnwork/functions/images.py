"""Image bytes and decoded images, read in Arrow batches: format, size, mode, background, mask measures."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

try:  # other formats than PNG need it
    from PIL import Image
except ImportError:
    Image = None

CORNER_TOLERANCE = 12  # fixed value
MODES = {0: ("L", 1), 2: ("RGB", 3), 3: ("P", 1), 4: ("LA", 2), 6: ("RGBA", 4)}
INSPECTED = "decoded boolean, image_format string, image_mode string, width_px int, height_px int, background_mode string"
MEASURED = "mask_method string, x_min int, y_min int, x_max int, y_max int, foreground_pixel_count bigint, reason string"


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """The rows of a PNG without their filters; ``step``: bytes of a pixel."""
    kinds, rows = raw[:, 0], raw[:, 1:].astype(np.int32)
    above = np.zeros(rows.shape[1], np.int32)
    for y, kind in enumerate(kinds.tolist()):
        row = rows[y]
        if kind == 2:
            row += above
        elif kind == 1:
            row[:] = np.cumsum(row.reshape(-1, step), axis=0).ravel()
        elif kind in (3, 4):  # each byte needs the one before
            for i in range(len(row)):
                left, up = int(row[i - step]) if i >= step else 0, int(above[i])
                if kind == 3:
                    row[i] = (row[i] + (left + up) // 2) & 255
                else:
                    corner = int(above[i - step]) if i >= step else 0
                    far = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
                    row[i] = (row[i] + (left, up, corner)[far.index(min(far))]) & 255
        elif kind:
            raise ValueError("unknown filter")
        row &= 255
        above = row
    return rows.astype(np.uint8)


def _png(content: bytes) -> tuple[str, np.ndarray]:
    """(mode, pixels) of a PNG of 8 bits a channel that is not interlaced."""
    at, data, head, palette, clear = 8, [], None, None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in MODES or not head[0] or not head[1]:
        raise ValueError("unsupported kind of PNG")
    mode, channels = MODES[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head[1], 1 + head[0] * channels)
    pixels = _unfiltered(raw, channels).reshape(head[1], head[0], channels)
    if mode == "P":
        pixels = palette[pixels[:, :, 0]]
        mode = "RGB" if clear is None else mode
    return mode, pixels


def decode(content: bytes | None) -> tuple[str, str, np.ndarray]:
    """(format, mode, pixels by row, column and channel) of an image; whatever is wrong with it is a ValueError."""
    if not content:
        raise ValueError("empty image")
    try:
        if Image is not None:
            with Image.open(io.BytesIO(content)) as image:
                image.load()
                wanted = image if image.mode in ("L", "LA", "RGB", "RGBA") else image.convert("RGB")
                pixels = np.asarray(wanted)
                return image.format, image.mode, pixels.reshape(*pixels.shape[:2], -1)
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return "PNG", *_png(content)
    except (ValueError, OSError, zlib.error, struct.error, TypeError, IndexError) as e:
        raise ValueError(f"not a valid image: {e}") from e
    raise ValueError("not a known image")


def png(pixels: np.ndarray) -> bytes:
    """A PNG of pixels by row, column and channel (1, 3 or 4 of 8 bits)."""
    height, width, channels = pixels.shape
    colour = {1: 0, 3: 2, 4: 6}[channels]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1).astype(np.uint8)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def background_of(pixels: np.ndarray) -> str:
    """TRANSPARENT_ALPHA, UNIFORM_RGB (all corners near the first one) or COMPLEX."""
    if pixels.shape[2] in (2, 4) and pixels[:, :, -1].min() < 255:
        return "TRANSPARENT_ALPHA"
    corners = pixels[[0, 0, -1, -1], [0, -1, 0, -1]][:, : 3 if pixels.shape[2] > 2 else 1].astype(int)
    return "UNIFORM_RGB" if np.abs(corners - corners[0]).max() <= CORNER_TOLERANCE else "COMPLEX"


def inspect(df: DataFrame, content_col: str) -> DataFrame:
    """``df`` with what its images show (``INSPECTED``); undecodable ones have decoded false and nulls."""
    kept = df.dtypes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INSPECTED.split(", ")]
        kinds = [pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            rows = []
            for content in batch.column(content_col):
                try:
                    form, mode, pixels = decode(content.as_py())
                    rows.append((True, form, mode, pixels.shape[1], pixels.shape[0], background_of(pixels)))
                except ValueError:
                    rows.append((False, None, None, None, None, None))
            found = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*(n for n, _ in kept), *names])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kept) + ", " + INSPECTED)


def foreground(pixels: np.ndarray, alpha_threshold: int, rgb: dict | None) -> tuple[str, np.ndarray | None, str | None]:
    """(method, mask, reason without a mask) of blue, green, red and maybe alpha values."""
    alpha = pixels[:, :, 3] if pixels.shape[2] == 4 else None
    if alpha is not None and alpha.min() < 255:
        return "alpha", alpha > alpha_threshold, None
    if not rgb:
        return "alpha", None, "imagen sin transparencia: alpha es 255 en todos los píxeles"  # fixed value
    colours = np.repeat(pixels, 3, axis=2) if pixels.shape[2] == 1 else pixels[:, :, :3]
    edge = np.concatenate([colours[0], colours[-1], colours[:, 0], colours[:, -1]]).astype(float)
    back = np.median(edge, axis=0)
    if np.sqrt(((edge - back) ** 2).sum(axis=1)).std() > rgb["tolerance"]:
        return "rgb", None, "fondo no uniforme"  # fixed value
    mask = np.sqrt(((colours - back) ** 2).sum(axis=2)) > rgb["delta"]
    return ("rgb", None, "foreground insuficiente") if mask.sum() < rgb["min_pixels"] else ("rgb", mask, None)  # fixed value


def measure(images: DataFrame, key: str, alpha_threshold: int, rgb: dict | None = None) -> DataFrame:
    """One row per image of Spark's image struct: key, method, extremes and size of its mask, or the reason why there is none."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), *[pa.int32()] * 4, pa.int64(), pa.string()]
        for batch in batches:
            rows = []
            for i in batch.column("image").to_pylist():
                if not i or i["height"] <= 0:
                    rows.append(("alpha", None, None, None, None, None, "imagen no decodificable"))  # fixed value
                    continue
                pixels = np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"], i["nChannels"])
                method, mask, reason = foreground(pixels, alpha_threshold, rgb)
                ys, xs = np.nonzero(mask) if mask is not None else ((), ())
                rows.append((method, *((int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max()), len(xs)) if len(xs) else (None,) * 5), reason))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, *(x.split()[0] for x in MEASURED.split(", "))])

    return images.select(key, "image").mapInArrow(run, f"{key} {kind}, {MEASURED}")
