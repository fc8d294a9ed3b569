"""Helpers that the training-data operators share: table access, staging, ragged Arrow/numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.scratch import staged, unstage  # noqa: F401  (for the operators)


#: Bytes of text that one numpy step works on; bounds a Python worker's memory whatever the Arrow batch holds.
CHUNK_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (any path that Spark's readers can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that long texts don't pile up in one batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def crc_mod(column: str, modulus: int):
    """crc32 of the column's text form, modulo ``modulus`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the rows' offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def release() -> None:
    """Memory that this process has freed goes back to the system, so that an idle Python worker is small."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


_TRIM = _trim()


def tidy(run):
    """``run`` (batches -> batches), after which its memory is handed back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut (between rows only) to about ``limit`` bytes of text each."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.diff(ragged(batch.column(text))[1])
        part = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    release()


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of ragged UTF-8 bytes, and the rows' offsets counted in code points."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[at]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, length), end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def literal(values, kind: str = "int"):
    """A constant array (folded by Catalyst while planning)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as one number (zeros past the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))


def _mask(lengths: np.ndarray) -> np.ndarray:
    """Ones for the first ``lengths`` (1 to 8) bytes of a word."""
    return ~np.uint64(0) >> (64 - 8 * np.minimum(lengths, 8)).astype(np.uint64)


def piece_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each piece, eight bytes at a time; of pieces up to 8 bytes it tells all."""
    h = (words[starts] & _mask(lengths)) * _ODD
    h ^= h >> np.uint64(32)
    left, done = np.flatnonzero(lengths > 8), 8
    while len(left):
        x = (h[left] ^ (words[starts[left] + done] & _mask(lengths[left] - done))) * _ODD + np.uint64(done)
        h[left] = x ^ (x >> np.uint64(29))
        done += 8
        left = left[lengths[left] > done]
    return h


def unique_pieces(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an index of one piece for each distinct content (no piece is empty), each piece's place among these).

    Hashes find equal pieces; the bytes are then compared, and a piece that differs from its
    representative (a hash collision) becomes its own representative, so the result is exact.
    """
    words, n = _words(data), len(starts)
    h = piece_hashes(words, starts, lengths)
    bits = max(12, int(2 * n).bit_length())
    rep, seen = np.empty(n, np.int64), np.empty(1 << bits, np.int64)
    left, key = np.arange(n), h
    while len(left):  # the first piece that lands in a slot stands for all with its hash
        slot = (key >> np.uint64(64 - bits)).astype(np.int64)
        seen[slot[::-1]] = left[::-1]
        found = seen[slot]
        same = h[found] == h[left]
        rep[left[same]] = found[same]
        left, key = left[~same], key[~same] * _ODD + np.uint64(1)
    differs = lengths != lengths[rep]
    left, done = np.flatnonzero(~differs & (rep != np.arange(n))), 0
    while len(left):
        x = (words[starts[left] + done] ^ words[starts[rep[left]] + done]) & _mask(lengths[left] - done)
        differs[left[x != 0]] = True
        done += 8
        left = left[(lengths[left] > done) & (x == 0)]
    rep[differs] = np.flatnonzero(differs)
    used = np.zeros(n, bool)
    used[rep] = True
    return np.flatnonzero(used), (np.cumsum(used) - 1)[rep]


def filtered(docs: DataFrame, text_col: str, verdict, limit: int = CHUNK_BYTES) -> DataFrame:
    """The rows for which ``verdict`` (a string column -> booleans) holds; columns may share a name."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index(text_col)]
    plain = docs.toDF(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, limit):
            yield batch.filter(pa.array(verdict(batch.column(text))))

    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    return plain.mapInArrow(tidy(run), schema).toDF(*docs.columns)
