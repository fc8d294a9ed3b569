"""Near-duplicate classes by improved consistent weighted sampling of TF-IDF shingles.

1. Weight of a shingle: its count in the text x (1 + ln(N / max(df, N / ``RAREST``))), N texts of which df hold
   it: what under one text in ``RAREST`` holds weighs the same, at every corpus size. The df are exact: counters by
   hash (as many as texts have different shingles on average, times 2 ``RAREST``; no more with more texts) never
   read too low, so they rule out nearly all shingles, and those that are left are counted one by one. At most
   ``RAREST`` times the average number of different shingles of a text can reach N / ``RAREST``, so the table
   of their weights, which is broadcast, does not grow with the number of texts.
2. Each text gets bands x rows consistent weighted samples (element and level of the least exponential-like
   key); equal bands make texts candidates. Two texts of similarity 0.8 agree in some of 10 bands
   of 3 with probability 0.9992, of similarity 0.9 with 0.999998.
3. Texts with equal words are one class from the start and go on as one. Within a bucket, texts are
   compared by weighted Jaccard similarity in blocks of ``BLOCK`` texts; a search from text to
   text emits only the edges that connect them, never all pairs. Of a larger bucket one block meets all the rest; what
   that leaves unconnected in more than two blocks is dealt anew by ten further bands within the bucket
   (like texts still meet with probability 0.9992, unlike ones seldom do), up to ``DEEPEST`` times, and
   then block by block. Shingles are told apart by 32 bits of hash, so two texts of n shingles share one by
   chance with probability n * n / 2^32, which moves their similarity by 1 / n.
4. Components of all edges are the classes.

Null counts as empty; texts without a word form one class (they are equal). A text of fewer than
``words`` words is one shingle of its own. Repeated rows share a class, whatever their ids; a text whose ids are all
null is in a class with its copies only, whose id is null; long texts are read whole; extra columns are
ignored; an empty table gives no rows. Ties of samples go to the smaller shingle hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import _mix, _words, code_points, piece_hashes, ragged, slices, small_batches, spread, staged, tidy, unstage
from tarnwork.llm.ragged_bpe import LETTER, NUMBER, classes
from tarnwork.operators.graph import components

#: Shingles that fewer than one text in so many holds weigh the same.
RAREST = 1000
SKETCH_PARTS = 64
BANDS, ROWS = 10, 3
#: Bands that are compared together; what one round connects, the next need not compare.
ROUNDS = ((0,), (1, 2), (3, 4, 5), (6, 7, 8, 9))
BLOCK = 1500
DEEPEST = 4
#: Different shingles that a task counts before it hands them over.
HELD = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _folded() -> np.ndarray:
    """16-bit code of letters (lower case) and digits, 32 for all else."""
    out = np.full(0x110000, 32, np.uint16)
    kept = np.flatnonzero((classes() == LETTER) | (classes() == NUMBER))
    out[kept] = kept & 0xFFFF
    for c in kept[kept < 0x3000].tolist():
        out[c] = ord(chr(c).lower()[0]) & 0xFFFF
    return out


def shingles(data: np.ndarray, at: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, their counts, how many each row has, 128-bit key of each row's words as two columns).

    A row's shingles are distinct and sorted; hashes are 32-bit numbers.
    """
    rows = len(at) - 1
    points, begins = code_points(data, at)
    codes = _folded()[points]
    edge = np.zeros(len(codes) + 1, bool)
    edge[begins] = True
    letter = codes != 32
    start = np.flatnonzero(letter & (edge[:-1] | np.concatenate([[True], ~letter[:-1]]))) if len(codes) else np.zeros(0, np.int64)
    stop = np.flatnonzero(letter & (edge[1:] | np.append(~letter[1:], True))) + 1 if len(codes) else start
    row = np.searchsorted(begins, start, "right") - 1
    raw = codes.view(np.uint8)
    h = piece_hashes(_words(raw), 2 * start, 2 * (stop - start)) if len(start) else np.zeros(0, np.uint64)
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    place = np.arange(len(h)) - first[row]
    key = np.zeros((2, rows), np.uint64)
    for k, odd in enumerate((np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95))):
        mixed = _mix(_mix(h * odd) + place.astype(np.uint64) * _ODD)
        key[k] = _mix(_sums(mixed, first, n) + n.astype(np.uint64))
    many = np.maximum(n - words + 1, np.minimum(n, 1))
    begin = spread(first, many)
    owner = np.repeat(np.arange(rows), many)
    total = np.zeros(len(begin), np.uint64)
    size = np.minimum(n, words)[owner]
    for k in range(words):
        inside = size > k
        total[inside] = _mix(total[inside] + h[begin[inside] + k])
    full = (owner.astype(np.uint64) << np.uint64(32)) | (total >> np.uint64(32))
    full, counts = np.unique(full, return_counts=True)
    return (full & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts.astype(np.int32), np.bincount((full >> np.uint64(32)).astype(np.int64), minlength=rows), key.astype(np.int64)


def _sums(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[first + n] - total[first]


class Weights:
    """Inverse document frequencies: of frequent shingles (sorted hashes) their own, of all others one value."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, documents: int):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], 1 + np.log(documents / counts[order])
        self.rare = 1 + np.log(max(1, min(documents, RAREST)))
        self.some = np.zeros(1 << 20, bool)
        self.some[hashes >> np.uint32(12)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.rare)
        if len(self.hashes):
            look = np.flatnonzero(self.some[hashes >> np.uint32(12)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[look]), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes[look]
            out[look[hit]] = self.values[at[hit]]
        return out


@lru_cache(1)
def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at 4,096 levels, and its logarithm at 65,536."""

    def gamma(levels: int) -> np.ndarray:
        p, x = (np.arange(levels) + 0.5) / levels, np.full(levels, 2.0)
        for _ in range(60):
            x = np.clip(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 3, x * 3)
        return x

    return gamma(4096).astype(np.float32), np.log(gamma(65536)).astype(np.float32)


def samples(hashes: np.ndarray, weight: np.ndarray, n: np.ndarray, many: int, first: int = 0) -> np.ndarray:
    """(many, rows) consistent weighted samples from the ``first`` on: a hash of the chosen element and its level."""
    gamma, log_gamma = _quantiles()
    log_weight = np.log(weight).astype(np.float32)
    full = n > 0
    starts = (np.cumsum(n) - n)[full]
    out = np.zeros((many, len(n)), np.uint64)
    if not full.any():
        return out
    wide = hashes.astype(np.uint64)
    row = np.repeat(np.arange(int(full.sum())), n[full])
    for k in range(many):
        x = (wide + np.uint64((first + k + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) * _ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        r = gamma[(x & np.uint64(0xFFF)).astype(np.int32)]
        beta = ((x >> np.uint64(28)) & np.uint64(0xFFF)).astype(np.float32) / np.float32(4096)
        level = np.floor(log_weight / r + beta)
        a = log_gamma[((x >> np.uint64(12)) & np.uint64(0xFFFF)).astype(np.int32)] - r * (level - beta + 1)
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == least[row])
        at = at[np.diff(row[at], prepend=-1) > 0]
        out[k, full] = _mix(wide[at] * _ODD + level[at].astype(np.int64).astype(np.uint64))
    return out


def bands_of(hashes: np.ndarray, weight: np.ndarray, n: np.ndarray, depth: int = 0) -> np.ndarray:
    """(rows, BANDS) hashes of ``ROWS`` samples each; every ``depth`` has samples of its own."""
    s = samples(hashes, weight, n, BANDS * ROWS, depth * BANDS * ROWS)
    out = np.zeros((BANDS, len(n)), np.uint64)
    for k in range(BANDS * ROWS):
        out[k // ROWS] = _mix(out[k // ROWS] + s[k] + np.uint64(k))
    return out.T.astype(np.int64)


def counters(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """Texts (column text) that hold a shingle whose hash begins with these ``bits``, summed over its shingles."""
    each = (1 << bits) // SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in slices(batches):
            h = shingles(*ragged(batch.column("text")), words)[0]
            total += np.bincount(h >> np.uint32(32 - bits), minlength=len(total))
        parts = [total[i : i + each].tobytes() for i in range(0, len(total), each)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(each, np.int64)
        for value in group.column("counts"):
            total += np.frombuffer(value.as_buffer(), np.int64)
        return pa.table({"part": group.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    partial = docs.select("text").mapInArrow(tidy(count), "part int, counts binary")
    spread_over = max(1, int(docs.rdd.getNumPartitions() ** 0.5))
    partial = partial.withColumn("salt", F.spark_partition_id() % spread_over)
    partial = partial.groupBy("part", "salt").applyInArrow(lambda g: add(g.select(["part", "counts"])), "part int, counts binary")
    rows = partial.groupBy("part").applyInArrow(add, "part int, counts binary").collect()  # of a fixed size
    total = np.zeros(1 << bits, np.int64)
    for r in rows:
        total[r["part"] * each : (r["part"] + 1) * each] = np.frombuffer(r["counts"], np.int64)
    return total


def weights(docs: DataFrame, words: int = 5) -> Weights:
    """Weights from the exact document frequencies of all texts (column text)."""
    whole = docs.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).first()
    total, different = whole["n"], max(1.0, (whole["size"] or 0) / 5)
    if not total:
        return Weights(np.zeros(0, np.uint32), np.zeros(0, np.int64), 1)
    bits = int(np.clip(np.ceil(np.log2(2 * RAREST * different)), 16, 22))
    least = total / RAREST
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(counters(docs, words, bits) >= least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(shared.value).astype(bool)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            hashes, number = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return hashes, np.bincount(number, np.concatenate([c for _, c in held]), len(hashes)).astype(np.int64)

        for batch in slices(batches):
            h = shingles(*ragged(batch.column("text")), words)[0]
            held.append(np.unique(h[often[h >> np.uint32(32 - bits)]], return_counts=True))
            if sum(len(h) for h, _ in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].astype(np.int64)), pa.array(held[0][1])], ["hash", "n"])
                    held = []
        if held:
            hashes, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(n)], ["hash", "n"])

    counted = docs.select("text").mapInArrow(tidy(count), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= least).collect()  # RAREST times the average number of a text's shingles at most
    return Weights(np.array([r["hash"] for r in rows], np.uint32), np.array([r["n"] for r in rows], np.int64), total)


def links_in_block(ids: list, roots: np.ndarray, sets: list[bytes], idf: Weights, threshold: float) -> list[tuple[int, int]]:
    """Pairs (place, place) that connect texts of at least ``threshold``; texts with equal roots count as connected."""
    n = np.array([len(s) // 8 for s in sets])
    flat = np.frombuffer(b"".join(sets), np.uint32).reshape(-1, 2)
    vocabulary, column = np.unique(flat[:, 0], return_inverse=True)
    value = idf(flat[:, 0]) * flat[:, 1]
    begin = np.cumsum(n) - n
    total = np.add.reduceat(value, begin) if len(value) else np.zeros(len(n))
    dense = np.zeros(len(vocabulary))
    rest = np.arange(len(ids))
    entries, owner = np.arange(len(column)), np.repeat(np.arange(len(ids)), n)
    out = []
    by_root: dict = {}
    for i, r in enumerate(roots.tolist()):
        by_root.setdefault(r, []).append(i)
    waiting = np.ones(len(ids), bool)
    stale = 0
    for seed in range(len(ids)):
        if not waiting[seed]:
            continue
        queue = list(by_root[roots[seed]])
        waiting[queue] = False
        while queue:
            i = queue.pop()
            stale += 1
            if stale >= 16:  # forget the entries of connected texts now and then
                keep = waiting[owner]
                entries, owner, stale = entries[keep], owner[keep], 0
            if not len(entries):
                continue
            own = slice(begin[i], begin[i] + n[i])
            dense[column[own]] = value[own]
            common = np.bincount(owner, np.minimum(dense[column[entries]], value[entries]), len(ids))
            dense[column[own]] = 0
            near = np.flatnonzero(waiting & (common >= threshold * (total + total[i] - common) - 1e-9))
            for j in near.tolist():
                if waiting[j]:
                    out.append((i, j))
                    more = by_root[roots[j]]
                    waiting[more] = False
                    queue += more
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (the least id of its class)."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(weights(source, words))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in slices(batches):
            h, c, n, key = shingles(*ragged(batch.column("text")), words)
            bands = bands_of(h, idf(h) * c, n)
            ends = pa.array(np.arange(0, (len(n) + 1) * BANDS, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(key[0]), pa.array(key[1]), pa.array(n > 0), pa.ListArray.from_arrays(ends, pa.array(bands.ravel()))], ["id", "k0", "k1", "full", "bands"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, c, n, _ = shingles(*ragged(batch.column("text")), words)
            raw = np.stack([h, c.astype(np.uint32)], axis=1).tobytes()
            ends = 8 * np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([raw[e - 8 * k : e] for e, k in zip(ends.tolist(), n.tolist())], pa.binary())], ["id", "shingles"])

    signed = staged(source.mapInArrow(tidy(sign), f"id {kind}, k0 bigint, k1 bigint, full boolean, bands array<bigint>"), "signed")
    classes_ = signed.groupBy("k0", "k1").agg(F.min("id").alias("rep"), F.first("full").alias("full"), F.first("bands").alias("bands"))
    reps = staged(classes_, "classes")
    banded = reps.where("full").select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "sample"))
    shared_buckets = banded.groupBy("band", "sample").agg(F.count("*").alias("n")).where("n > 1")
    work = staged(banded.join(shared_buckets.drop("n"), ["band", "sample"]), "buckets")
    wanted = work.select("id").distinct()
    sets = staged(source.join(wanted, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(tidy(shingled), f"id {kind}, shingles binary"), "sets")
    edges = spark.createDataFrame([], f"a {kind}, b {kind}")
    roots = spark.createDataFrame([], f"id {kind}, component {kind}")

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_pylist()
        found = links_in_block(ids, np.array(group.column("root").to_pylist()), [x.as_py() for x in group.column("shingles")], shared.value, threshold)
        kind_ = group.schema.field("id").type
        return pa.table({"a": pa.array([ids[i] for i, _ in found], kind_), "b": pa.array([ids[j] for _, j in found], kind_)})

    def deal(depth: int):
        """The rows' buckets, each dealt to ten by samples of this depth."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = batch.column("shingles")
                n = np.array([len(x.as_py()) // 8 for x in raw])
                flat = np.frombuffer(b"".join(x.as_py() for x in raw), np.uint32).reshape(-1, 2)
                bands = bands_of(flat[:, 0], shared.value(flat[:, 0]) * flat[:, 1], n, depth)
                outer = (batch.column("sample").to_numpy().astype(np.uint64) * _ODD + batch.column("band").to_numpy().astype(np.uint64))[:, None]
                inner = _mix(outer + bands.astype(np.uint64) * _ODD).astype(np.int64)
                who = pa.array(np.repeat(np.arange(len(n)), BANDS))
                band = np.tile(np.arange(BANDS, dtype=np.int32) + depth * BANDS, len(n))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(who), pa.array(band), pa.array(inner.ravel())], ["id", "band", "sample"])

        return run

    scraps: list[DataFrame] = []
    for bands in ROUNDS:
        left, depth = work.where(F.col("band").isin(*bands)), 0
        while True:
            rooted = left.join(roots.withColumnRenamed("component", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
            mixed = rooted.groupBy("band", "sample").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
            parts = F.when(F.col("n") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int")
            dealt = rooted.join(mixed.select("band", "sample", parts.alias("parts")), ["band", "sample"])
            dealt = staged(dealt.withColumn("part", F.pmod(F.xxhash64("id", "band"), F.col("parts")).cast("int")), "dealt")
            scraps.append(dealt)
            if dealt.isEmpty():
                break
            first = F.when(F.col("parts") == 1, F.array(F.lit(0))).when(F.col("part") == 0, F.sequence(F.lit(1), F.col("parts") - 1)).otherwise(F.array("part"))
            blocks = dealt.withColumn("block", F.explode(first)).join(sets, "id").select("band", "sample", "block", "id", "root", "shingles")
            new = staged(blocks.groupBy("band", "sample", "block").applyInArrow(compare, f"a {kind}, b {kind}"), "links")
            scraps.append(new)
            if not new.isEmpty():
                edges, found = edges.unionByName(new), roots
                stars = components(edges)
                roots = staged(stars, "roots")
                scraps += [found, *stars.scraps]
            if dealt.where("parts > 1").isEmpty():
                break
            left = dealt.where("parts > 1 AND part > 0").select("id", "band", "sample")
            if depth < DEEPEST:
                depth += 1
                left = left.join(roots.withColumnRenamed("component", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
                still = left.groupBy("band", "sample").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
                left = left.drop("root").join(still.withColumn("large", F.col("n") > 2 * BLOCK).select("band", "sample", "large"), ["band", "sample"])
                again = left.where("large").select("id", "band", "sample").join(sets, "id").mapInArrow(tidy(deal(depth)), f"id {kind}, band int, sample bigint")
                left = staged(left.where("NOT large").select("id", "band", "sample").unionByName(again), "left")
                scraps.append(left)
    unstage(work, sets, *scraps)  # the result reads none of these
    joined = signed.select("id", "k0", "k1").join(reps.select("k0", "k1", "rep"), ["k0", "k1"])
    final = joined.join(roots.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return final.select(F.col("id").alias(id_col), F.coalesce("component", "rep").alias("class_id"))
