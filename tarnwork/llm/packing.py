"""Best-fit packing of tokenised documents into fixed-length sequences, by large-item matching.

1. ``tokenize_pieces``: each text's ids plus an end id, cut only where longer than the capacity.
2. ``plan``: works on the histogram of piece lengths alone (at most ``capacity`` numbers, whatever the
   corpus holds). Pieces above a third of the capacity can share a sequence with at most one other such
   piece; a greedy matching pairs each, longest first, with the longest that still fits. Smaller pieces
   then go, longest first, to the tightest gap left. All sequences with the same content are one pattern
   with a multiplicity, so the plan stays small.
3. ``pack``: the r-th piece of a length takes the r-th slot that the plan has for that length. Ranks come
   from salted buckets (counts per bucket and length, running totals), so a length that a third of
   the pieces share is still ranked by many tasks.

Null and empty texts are one piece holding only the end id. Repeated rows are packed as often as they
occur; equal lengths are ranked by a hash of id and piece number, then by these; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.common import code_points, ragged, slices, small_batches, spread, staged, unique_pieces, tidy
from tarnwork.llm.ragged_bpe import NUMBER, SPACE, classes, load, split_contractions

#: Rows that a bucket of the ranking holds on average.
BUCKET_ROWS = 50_000
#: A column of small numbers by which ``pack`` also deals rows, so that rows of one id go to many buckets.
SALT = "_salt"


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(lower case of every code point, whether it is plain: lowered alone and untouched by NFC whatever is next to it)."""
    lower, plain = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    plain[0x4E00:0xA000] = plain[0x1F000:0x1FB00] = True  # ideographs, emoji: no case, nothing to compose
    for i in range(0x2E80):
        c = chr(i)
        small = c.lower()
        lower[i] = ord(small[0])
        plain[i] = len(small) == 1 and unicodedata.category(c)[0] != "M" and unicodedata.normalize("NFC", c) == c
    plain[0x3A3] = False  # its lower case depends on its place
    plain[0x1100:0x1200] = False  # these compose with each other
    return lower, plain


def word_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Starts of contractions, words, digits and signs (all in lower case), and of white space."""
    n = len(points)
    fresh = np.zeros(n + 1, bool)
    fresh[begins] = True
    fresh[n] = True
    kind = classes()[points]
    start = fresh.copy()
    start[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    return split_contractions(points, start, fresh)


def encode_ragged(data: np.ndarray, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, ids of each row), as the tokenizers library gives them for word_bpe_49k.

    Rows of plain characters (no combining marks, no special strings) are cut with array operations and
    each distinct word is merged once for all; other rows are encoded by the library itself.
    """
    rows = len(at) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(rows, np.int64)
    merges, specials, last_ids = load(path)
    lower, plain = _letters()
    points, begins = code_points(data, at)
    odd = np.zeros(rows, bool)
    odd[np.searchsorted(begins, np.flatnonzero(~plain[points]), "right") - 1] = True
    whole = data.tobytes()
    for s in specials:
        i = whole.find(s)
        while i >= 0:
            odd[np.searchsorted(at, i, "right") - 1] = True
            i = whole.find(s, i + 1)
    points = lower[points]
    small = np.frombuffer(points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    lead = np.append(np.flatnonzero((small & 0xC0) != 0x80), len(small))
    first = word_starts(points, np.unique(begins[begins < len(points)]))
    size = np.diff(first, append=len(points))
    row = np.searchsorted(begins, first, "right") - 1
    take = (classes()[points[first]] != SPACE) & ~odd[row]
    first, size, row = first[take], size[take], row[take]
    starts = lead[first]
    lengths = lead[first + size] - starts
    rep, inverse = unique_pieces(small, starts, lengths)
    n = lengths[rep]
    letters = small[spread(starts[rep], n)]
    symbols = merges.byte_ids[letters]
    ends = np.cumsum(n) - 1
    symbols[ends] = last_ids[letters[ends]]
    pool, kept = merges.merge(symbols, n)
    where = np.cumsum(kept) - kept
    ids, counts = pool[spread(where[inverse], kept[inverse])], np.bincount(row, kept[inverse], rows).astype(np.int64)
    strange = np.flatnonzero(odd)
    if len(strange):
        own = [e.ids for e in _tokenizer(path).encode_batch_fast([whole[at[i] : at[i + 1]].decode() for i in strange], add_special_tokens=False)]
        ends = np.cumsum(counts)
        parts = np.split(ids, ends[strange])
        ids = np.concatenate([x for pair in zip(parts, [np.array(o, np.int64) for o in own] + [ids[:0]]) for x in pair])
        counts[strange] = [len(o) for o in own]
    return ids, counts


def tokenize_pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and the ids themselves if ``with_ids``)."""
    small_batches(docs.sparkSession)
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = ragged(batch.column("text"))
            ids, n = encode_ragged(data, at, path)
            ends = np.cumsum(n + 1)
            tokens = np.full(int(ends[-1]), end_id, "<u4")
            tokens[spread(ends - n - 1, n)] = ids
            pieces = -(-(n + 1) // capacity)
            who = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(who)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum((n + 1)[who] - start, capacity)
            begin = (ends - n - 1)[who] + start
            raw = memoryview(tokens.tobytes())
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(begin.tolist(), length.tolist())), np.int64, len(who))
            columns = [batch.column("id").take(pa.array(who)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(tokens.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots as (length, first rank, how many, first sequence, offset) for ``counts`` pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    groups: list[list] = []  # [how many sequences, lengths in them, room]
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if left[m] and m <= capacity - n and (m != n or left[n] > 1)), 0)
            if not mate:
                groups.append([left[n], [n], capacity - n])
                left[n] = 0
            elif mate == n:
                pairs = left[n] // 2
                groups.append([pairs, [n, n], capacity - 2 * n])
                left[n] -= 2 * pairs
            else:
                pairs = min(left[n], left[mate])
                groups.append([pairs, [n, mate], capacity - n - mate])
                left[n] -= pairs
                left[mate] -= pairs
    by_room: dict[int, list[list]] = {}
    for g in groups:
        by_room.setdefault(g[2], []).append(g)

    def put(g: list) -> None:
        groups.append(g)
        by_room.setdefault(g[2], []).append(g)

    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            room = min((r for r in by_room if r >= n and by_room[r]), default=0)
            if room:
                g = by_room[room].pop()
            else:
                room = capacity
                g = [-(-left[n] // (capacity // n)), [], capacity]
                groups.append(g)
            fit = room // n
            full, rest = divmod(left[n], fit)
            full = min(full, g[0])
            parts = [[full, fit], [1, rest]] if full < g[0] and rest else [[full, fit]]
            used = sum(k for k, _ in parts)
            kept = list(g[1])
            if used < g[0]:
                put([g[0] - used, kept, room])
            g[0] = 0
            for k, m in parts:
                if k:
                    put([k, kept + [n] * m, room - n * m])
                    left[n] -= k * m
    slots, ranks, sequence = [], dict.fromkeys(counts, 0), 0
    for k, lengths, _ in groups:
        at = 0
        for n in lengths if k else ():
            slots.append((n, ranks[n], k, sequence, at))
            ranks[n] += k
            at += n
        sequence += k
    return slots


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (id, piece, length, ...) with sequence_id and offset; ``pieces`` is read twice, so stage it."""
    counted = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    total = sum(r["count"] for r in counted)
    slots = plan({r["length"]: r["count"] for r in counted}, capacity)
    buckets = max(8, total // BUCKET_ROWS)
    salt = [SALT] if SALT in pieces.columns else []
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", *salt), F.lit(buckets)).cast("int"))
    before = dealt.groupBy("length", "bucket").count().withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).drop("count")
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("nth"))
    order = np.array(sorted(slots), np.int64).reshape(-1, 5)
    names = [c for c in pieces.columns if c not in salt]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in names) + ", sequence_id bigint, offset bigint"
    scale = np.int64(1) << 40  # ranks stay below it

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = order[:, 0] * scale + order[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            slot = np.searchsorted(keys, length * scale + rank, "right") - 1
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(order[slot, 3] + rank - order[slot, 1]), pa.array(order[slot, 4])], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack ``docs``: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenize_pieces(docs, vocabulary, capacity, end_id, id_col, text_col)
    pieces = staged(pieces.withColumn(SALT, F.pmod(F.monotonically_increasing_id(), F.lit(997)).cast("int")), "pieces")  # parts rows that repeat an id
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
