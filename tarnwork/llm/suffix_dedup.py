"""Exact substring deduplication over UTF-8 bytes with suffix arrays of closed shards.

A byte goes if a string of ``width`` bytes that covers it also starts earlier (smaller id, or earlier in
the same text). The work is dealt so that equal strings always meet, and only where they may repeat:

1. Every ``width``-byte window has an anchor: of its ``GRAM``-byte grams the one of the least hash
   (leftmost). Equal windows have equal anchors at equal places. Neighbouring windows with one anchor form
   a segment (about 35 windows). Each task finds equal segments among its own rows; of those only the
   first goes on, the others are covered for certain. So no segment sends more than one row a task.
2. Segments meet by anchor. Equal segments: all but the first are covered. Anchors with one
   segment are done. Where an anchor has different segments, windows may repeat within them: the first
   occurrence of each goes on, with its bytes.
3. Those bytes, dealt to shards by anchor, are put into suffix order with common-prefix values by external
   induced sorting (``induced_sort``: recursive, its text, names, queues and results on disk beyond
   ``SORT_MEMORY``, so a shard may be far larger than memory). Neighbours in suffix order that share
   ``width`` bytes are equal windows: all but the first are covered.
4. Covered stretches meet their text once more, are joined up and cut out.

A phrase shorter than a window with different text around it gives one anchor a different segment in every
document. A sample of the rows finds such hot anchors; their segments are split into single windows, each
dealt by a hash of its own. Equal windows still meet, and as they are whole windows they need no sort. The
sample only says which anchors are split; what is covered is the same whichever they are.

Segments that meet in steps 1 and 2 are equal by two hashes of 64 bits (of the anchor and of the whole
segment, which both must agree at the same place); no byte is compared there. For n segments that leaves
a chance of about n * n / 2^129 that one pair is taken for equal by mistake: 10^-15 for 10^12 segments, if
nobody chose the texts to that end.

Ids must be numbers. Null texts count as empty; texts under ``width`` bytes lose nothing. Rows that
repeat an id and text get the same result each (they are one text); different texts of one id are
documents of their own, in order of their texts' hashes; a null id takes no part and loses
nothing. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import _words, piece_hashes, ragged, slices, small_batches, spread, staged, tidy
from tarnwork.llm.induced_sort import Disk, Text, picked, sorted_suffixes

#: Bytes of an anchor, a multiple of 8; short ones repeat by chance and so send unlike segments to be sorted.
GRAM = 32
#: Bytes of segments that a shard holds on average.
SHARD_BYTES = 3 << 20
#: Bytes that the sort of a shard keeps in memory.
SORT_MEMORY = 256 << 20
#: Different segments from which on an anchor is split (about an eighth of a shard), and one row in how many is looked at for it.
HOT_SEGMENTS = 4096
SAMPLE = 64
#: Bytes of text that are cut into segments at a time (about 80 bytes of memory for each).
STEP_BYTES = 2 << 20
_LOW = np.uint64((1 << 31) - 1)


def segments(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, anchor hash, segment hash) of every segment of ragged bytes."""
    if width < GRAM:
        raise ValueError(f"strings of {width} bytes are shorter than an anchor of {GRAM}")
    size = np.diff(at)
    long = np.flatnonzero(size >= width)
    if not len(long):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    words = _words(data)
    n = len(data)
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h[: max(n - k, 0)] ^= words[k:n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    least = (h & ~_LOW) | np.arange(n, dtype=np.uint64)  # a tie goes to the leftmost
    grams, reach = width - GRAM + 1, 1
    while 2 * reach <= grams:
        least[: n - reach] = np.minimum(least[: n - reach], least[reach:])
        reach *= 2
    if grams > reach:
        least[: n - grams + reach] = np.minimum(least[: n - grams + reach], least[grams - reach :])
    count = size[long] - width + 1
    window = spread(at[:-1][long], count)
    row = np.repeat(long, count)
    anchor = (least[window] & _LOW).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    many = np.diff(first, append=len(window))
    start = window[first]
    return row[first], start - at[row[first]], many, h[anchor[first]].astype(np.int64), piece_hashes(words, start, many + width - 1).astype(np.int64)


def split(data: np.ndarray, at: np.ndarray, width: int, hot: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """``segments`` with those of ``hot`` anchors as single windows, whose anchor is a hash of the window."""
    row, start, many, anchor, segment = found
    pick = np.isin(anchor, hot)
    if not pick.any():
        return found
    windows = spread(start[pick], many[pick])
    rows = np.repeat(row[pick], many[pick])
    words, place = _words(data), at[rows] + windows
    size = np.full(len(place), width)
    own = piece_hashes(words, place + 3, size - 3).astype(np.int64)  # from another byte on, so both hashes differ
    single = (rows, windows, np.ones(len(rows), many.dtype), own, piece_hashes(words, place, size).astype(np.int64))
    return tuple(np.concatenate([a[~pick], b]) for a, b in zip(found, single))


def _runs(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches of each id joined up."""
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order], (start + length)[order]
    if not len(ids):
        return ids, start, end
    # ends so far, kept apart by id through an offset
    _, group = np.unique(ids, return_inverse=True)
    gap = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * gap)
    new = np.ones(len(ids), bool)
    new[1:] = (start + group * gap)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    return ids[first], start[first], reach[last] - group[last] * gap - start[first]


def _table(kind, anchor, segment, ids, start, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int8)), pa.array(anchor), pa.array(segment), pa.array(ids), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int32))], ["kind", "anchor", "segment", "id", "start", "n"])


ROW = "kind tinyint, anchor bigint, segment bigint, id bigint, start bigint, n int"
COVERED, CANDIDATE, WANTED = 0, 1, 2


def find(docs: DataFrame, width: int = 100) -> DataFrame:
    """Covered stretches (id, start, n): every byte of ``docs`` (id, text) that goes, possibly more than once."""
    spark = docs.sparkSession
    total = docs.where("id IS NOT NULL")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP_BYTES):
            _, _, _, anchor, segment = segments(*ragged(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(segment)], ["anchor", "segment"])

    small_batches(spark)
    some = total.where(F.pmod(F.xxhash64("id", "text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(tidy(sampled), "anchor bigint, segment bigint")
    often = some.distinct().groupBy("anchor").count().where(F.col("count") >= max(2, HOT_SEGMENTS // SAMPLE))
    hot = np.array([r["anchor"] for r in often.collect()], np.int64)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in slices(batches, "text", STEP_BYTES):
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            data, at = ragged(batch.column("text"))
            row, start, many, anchor, segment = split(data, at, width, hot, segments(data, at, width))
            parts.append((ids[row], start.astype(np.int32), many.astype(np.int16), anchor, segment))
        if not parts:
            return
        ids, start, many, anchor, segment = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.lexsort((start, ids, segment, anchor))
        ids, start, many, anchor, segment = (x[order] for x in (ids, start, many, anchor, segment))
        new = np.ones(len(ids), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])
        origin = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        later = (ids != ids[origin]) | (start != start[origin])
        for a in range(0, len(ids), 100_000):
            pick = np.flatnonzero(new[a : a + 100_000]) + a
            yield _table(CANDIDATE, anchor[pick], segment[pick], ids[pick], start[pick], many[pick])
        i, s, n = _runs(ids[later], start[later].astype(np.int64), many[later].astype(np.int64) + width - 1)
        yield _table(COVERED, i * 0x9E3779B97F4A7 % (1 << 61), s, i, s, n)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor, segment, id, start; of an anchor that goes on in a next batch one row is held."""
        names = ["anchor", "segment", "id", "start", "n"]
        held: list[np.ndarray] | None = None  # the first row of the segment met last
        several = False  # whether its anchor has had other segments, so that the row has gone on
        for batch in batches:
            done = batch.column("kind").to_numpy() == COVERED
            rows = [batch.column(c).to_numpy().astype(np.int64) for c in names]
            if done.any():
                yield _table(COVERED, *(r[done] for r in rows))
            rows = [r[~done] for r in rows]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            anchor, segment, ids, start, n = rows
            group = np.ones(len(ids), bool)
            group[1:] = anchor[1:] != anchor[:-1]
            new = group.copy()
            new[1:] |= segment[1:] != segment[:-1]
            number = np.cumsum(group) - 1
            different = np.bincount(number[new])
            different[0] += several
            origin = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
            later = (ids != ids[origin]) | (start != start[origin])
            yield _table(COVERED, anchor[later], segment[later], ids[later], start[later], n[later] + width - 1)
            wanted = new & (different[number] > 1)
            wanted[0] &= not several
            yield _table(WANTED, anchor[wanted], segment[wanted], ids[wanted], start[wanted], n[wanted] + width - 1)
            held, several = [r[origin[-1] :][:1] for r in rows], bool(different[-1] > 1)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = (batch.column("text")[i].as_py() or "").encode("utf-8", "surrogatepass")
                wanted = batch.column("wanted")[i].values
                anchor, start, n = (wanted.field(k).to_numpy() for k in range(3))
                _, keep = np.unique(start, return_index=True)
                anchor, start, n = anchor[keep], start[keep], n[keep]
                pieces = [raw[a : a + k] for a, k in zip(start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.repeat(batch.column("id")[i].as_py(), len(n))), pa.array(start), pa.array(pieces, pa.binary())], ["anchor", "id", "start", "bytes"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, kept, parts, many = Text(SORT_MEMORY // 4), Disk(SORT_MEMORY // 8), [], 0
        for batch in batches:
            column = batch.column("bytes").cast(pa.large_binary())
            at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
            size = np.diff(at)
            part = np.ones(int(size.sum()) + len(size), np.int16)  # 1 parts segments, the end is 0
            part[spread(np.cumsum(size + 1) - size - 1, size)] = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].astype(np.int16) + np.int16(2)
            text.add(part)
            parts.append(kept.put((batch.column("id").to_numpy().copy(), batch.column("start").to_numpy().copy(), size)))
            many += len(size)
        if not many:
            return
        text.add(np.zeros(1, np.int16))
        ids, starts, sizes, ends = (kept.array(many, np.int64) for _ in range(4))
        at, end = 0, 0
        for part in parts:
            own = kept.take(part)
            for whole, values in zip((ids, starts, sizes, ends), (*own, end + np.cumsum(own[2] + 1))):
                whole[at : at + len(values)] = values
            at += len(own[0])
            end = int(ends[at - 1]) if at else 0
        whole = text.whole()

        def windows(positions: np.ndarray) -> np.ndarray:
            owner = np.minimum(np.searchsorted(ends, positions, "right"), len(ends) - 1)
            return positions + width < ends[owner]

        for doc, place in covered_windows(picked(sorted_suffixes(whole, SORT_MEMORY), windows), ends, sizes, ids, starts, width):
            i, s, n = _runs(doc, place, np.full(len(doc), width))
            yield _table(COVERED, np.zeros(len(i), np.int64), s, i, s, n)

    candidates = total.select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(tidy(local), ROW)
    sorted_ = candidates.repartition("anchor").sortWithinPartitions("anchor", "segment", "id", "start")
    met = staged(sorted_.mapInArrow(tidy(grouped), ROW), "met")
    wanted = met.where(F.col("kind") == WANTED)
    size = wanted.agg(F.sum("n")).first()[0] or 0
    covered = met.where(F.col("kind") == COVERED).select("id", "start", "n")
    if not size:
        return covered
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("wanted"))
    texts = total.select(F.col("id").cast("bigint").alias("id"), "text").join(lists, "id")
    bytes_ = texts.mapInArrow(tidy(fetch), "anchor bigint, id bigint, start bigint, bytes binary")
    dealt = bytes_.repartition(max(2, -(-size // SHARD_BYTES)), "anchor")
    found = staged(dealt.mapInArrow(tidy(shard), ROW), "found")
    return covered.unionByName(found.select("id", "start", "n"))


def covered_windows(ordered: Iterator, ends: np.ndarray, sizes: np.ndarray, ids: np.ndarray, starts: np.ndarray, width: int, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(id, place) of every window but the earliest of its equals, about ``most`` at a time.

    ``ordered``: window positions in suffix order with their common prefixes; windows that share ``width`` bytes are equal.
    """
    held, n, lead = [], 0, None
    for positions, shared in ordered:
        owner = np.searchsorted(ends, positions, "right")
        doc, place, new = ids[owner], starts[owner] + positions - (ends[owner] - 1 - sizes[owner]), shared < width
        if lead is not None and not new[0]:  # the group goes on: its earliest so far stands for it
            doc, place, new = np.append(lead[0], doc), np.append(lead[1], place), np.append(True, new)
        new[0] = True
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        best = np.lexsort((place, doc, group))[first]  # of each group the earliest, as groups are in order
        later = (doc != doc[best][group]) | (place != place[best][group])
        held.append((doc[later], place[later]))
        n += len(held[-1][0])
        lead = doc[best[-1]], place[best[-1]]
        if n >= most:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _kept(raw: bytes, spans, whole: bool = False) -> tuple[bytes, int, int]:
    """(what is left, bytes covered, stretches covered); ``whole``: without the rest of code points that a cut has split."""
    if spans is None or not len(spans):
        return raw, 0, 0
    start, n = spans.field(0).to_numpy().astype(np.int64), spans.field(1).to_numpy().astype(np.int64)
    _, start, n = _runs(np.zeros(len(start), np.int64), start, n)
    gone = np.zeros(len(raw), bool)
    gone[spread(start, n)] = True
    data = np.frombuffer(raw, np.uint8)
    if whole:
        point = np.cumsum((data & 0xC0) != 0x80)
        cut = np.zeros(len(raw) + 1, bool)
        cut[point[gone]] = True
        gone = cut[point]
    return data[~gone].tobytes(), int(n.sum()), len(n)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "_row") -> DataFrame:
    """``docs`` with a key of each row, in order of ids (null ids last), then of texts' hashes."""
    ordered = docs.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(text_col))
    return staged(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed")


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``docs`` with columns kept (binary: the bytes left; ``whole``: the whole code points), n_bytes, n_removed and n_spans."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*own)
    text = own[docs.columns.index(text_col)]
    plain = plain.withColumn("_key", F.col(own[docs.columns.index(id_col)]).cast("bigint"))
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    apart = plain.where("_key IS NOT NULL").select("_key", mark.alias("_mark"))
    if not apart.groupBy("_key").agg(F.min("_mark").alias("a"), F.max("_mark").alias("b")).where("a <> b").isEmpty():
        # texts that share an id get keys of their own
        numbers = staged(apart.distinct().orderBy("_key", "_mark").withColumn("_number", F.monotonically_increasing_id()), "keys")
        plain = plain.withColumn("_mark", mark).join(numbers, ["_key", "_mark"], "left").drop("_key", "_mark").withColumnRenamed("_number", "_key")
    spans = find(plain.select(F.col("_key").alias("id"), F.col(text).alias("text")), width).groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = plain.join(spans.select(F.col("id").alias("_key"), "spans"), "_key", "left").drop("_key")
    schema = ", ".join(f"{n} {t}" for n, t in joined.drop("spans").dtypes) + ", kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = []
            for t, s in zip(batch.column(text), batch.column("spans")):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                out.append((len(raw), *_kept(raw, s.values if s.is_valid else None, whole)))
            columns = [batch.column(c) for c in own] + [pa.array([o[1] for o in out], pa.binary()), *(pa.array([o[k] for o in out], pa.int64()) for k in (0, 2, 3))]
            yield pa.RecordBatch.from_arrays(columns, [*own, "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(tidy(cut), schema).toDF(*docs.columns, "kept", "n_bytes", "n_removed", "n_spans")


def digest(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    done = remove_repeats(docs.select(F.col(id_col), F.col(text_col)), width, id_col, text_col)
    return done.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
