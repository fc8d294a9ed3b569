"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is the signs of a vector, cut evenly into segments of at most about log2(rows / ``MET``) bits (at most ``segment_bits``, if
given), so that a lookup meets about ``MET`` codes or more however many rows there are. A lookup is a row that is shuffled and
sorted, while a code that it meets is only compared within the join, so a few wide lookups cost less than many narrow ones:
independent codes lie far apart, and the values of a segment at distance s grow with the s-th power of its bits. Radius s looks
up, for every still open query code, all values of a segment that differ from its own in exactly s bits. With all
segments searched to s - 1 and j of them to s, every code at a distance below segments * s + j has been
met, so a query is finished when its k-th best distance is below that; the rest go on with the next
segment or radius. A pair is kept only at the first segment with its least segment distance, so it
appears once in all rounds, and only if it is no farther than the k-th best so far.

Rows with equal codes are met as one: of each code the k + m smallest ids are kept, m being the most rows
that one query's id has, which is exact since ties go to the smaller id and a query leaves out only its own rows. Query rows with equal codes are searched
once. Each radius below ``WHOLE_ROUNDS`` is one round for all segments, as its lookups are few. The k-th best distance so far
(at first, to about ``SAMPLE`` codes) bounds what a join lets through, also where many codes share a value. Rounds hand over staged tables; nothing
but that sample is gathered on the driver. Where many codes share the value of a segment, that join's large partitions are split by Spark.

Null vectors and null ids take no part; null, NaN and missing components are 0 bits. With fewer than k other rows all
are returned. Repeated rows count as rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import combinations
from math import ceil, log2
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.common import literal, staged


#: Radii below this are searched in one round each for all segments.
WHOLE_ROUNDS = 3
#: Codes that a lookup of independent codes should at least meet.
MET = 64
#: Codes whose distances bound those of the first round; they decide what is compared in full, never what is found.
SAMPLE = 512


def codes(vectors: DataFrame, bits: int, segment_bits: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and code (one number for each segment) of every row with a vector."""
    v = F.col(vector_col)
    padded = F.concat(v, F.array_repeat(F.lit(0), F.lit(bits) - F.size(v)))
    zero = F.lit(0).cast(_kind(segment_bits))

    def segment(start: int, width: int):
        part = F.slice(padded, start + 1, width)
        return F.aggregate(part, zero, lambda a, x: a * 2 + F.when((x > 0) & ~F.isnan(x), 1).otherwise(0))

    widths = _widths(bits, segment_bits)
    return vectors.where(v.isNotNull()).select(F.col(id_col).alias("id"), F.array(*[segment(sum(widths[:j]), w) for j, w in enumerate(widths)]).alias("code"))


def _widths(bits: int, segment_bits: int) -> list[int]:
    """Bits of each segment: as few segments as hold ``segment_bits`` at most, of widths that differ by one at most."""
    segments = -(-bits // segment_bits)
    return [bits * (j + 1) // segments - bits * j // segments for j in range(segments)]


def _kind(segment_bits: int) -> str:
    return "int" if segment_bits <= 30 else "bigint"


def _segment_distances(a: str, b: str):
    return F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))


def _words(code: str, widths: list[int]) -> list:
    """The code in as few 64-bit numbers as hold whole segments: few enough operations for the join to compile."""
    words, used = [], 64
    for j, w in enumerate(widths):
        if used + w > 64:
            words, used = [*words, F.lit(0).cast("bigint")], 0
        words[-1] = words[-1].bitwiseOR(F.shiftleft(F.col(code)[j].cast("bigint"), used))
        used += w
    return words


def _distance(a: Iterable[Column], b: Iterable[Column]) -> Column:
    return reduce(add, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)], F.lit(0))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, segment_bits: int = 16, bits: int | None = None) -> DataFrame:
    """query_id, rank, id, distance: the k rows (id, code) nearest to each query (id, code), not itself; ties to the smaller id.

    ``bits``: those of a whole code, if its segments are cut as ``codes`` does; all are looked up as ``segment_bits`` wide without it.
    """
    rows, queries = rows.where(F.col("id").isNotNull()), staged(queries.where(F.col("id").isNotNull()), "queries")
    own = rows.join(queries.select("id").distinct(), "id", "left_semi").groupBy("id").count()
    enough = k + (own.agg(F.max("count")).first()[0] or 0)
    by_code = Window.partitionBy("code").orderBy("id")
    kept = rows.withColumn("nth", F.row_number().over(by_code)).where(F.col("nth") <= enough)
    distinct = staged(kept.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    widths = _widths(bits, segment_bits) if bits else [segment_bits] * len((distinct.select("code").first() or [[]])[0])
    segments, words = len(widths), _words("code", widths)
    own, near = ([f"{side}{j}" for j in range(len(words))] for side in ("own", "near"))
    index = distinct.select(F.posexplode("code").alias("segment", "value"), F.col("code").alias("near"), *map(Column.alias, words, near), "ids")
    some = distinct.where(F.xxhash64("code") % max(1, distinct.count() // SAMPLE) == 0).agg(F.collect_list(F.array(*words)).alias("some"))
    still = queries.select("code").distinct().select("code", *map(Column.alias, words, own)).crossJoin(F.broadcast(some))
    nth = F.get(F.array_sort(F.transform("some", lambda x: _distance(map(F.col, own), [x[j] for j in range(len(words))]))), F.lit(enough - 1))
    still = staged(still.select("code", F.coalesce(nth, F.lit(sum(widths))).alias("far")), "still")
    kind = rows.schema["id"].dataType.simpleString()
    best = rows.sparkSession.createDataFrame([], f"code array<{_kind(segment_bits)}>, id {kind}, distance int")
    order = Window.partitionBy("code").orderBy("distance", "id")
    distance, apart = _distance(map(F.col, own), map(F.col, near)), _segment_distances("code", "near")
    steps = [(s, only) for s in range(max(widths, default=-1) + 1) for only in ([None] if s < WHOLE_ROUNDS else range(segments))]
    for s, only in steps:
        probes = still.select("code", *map(Column.alias, words, own), "far", F.posexplode("code").alias("segment", "value"))
        probes = probes if only is None else probes.where(F.col("segment") == only)
        masks, beyond = literal(_masks(max(widths), s), _kind(segment_bits)), literal([1 << w for w in widths], "bigint")
        probes = probes.withColumn("mask", F.explode(masks)).where(F.col("mask") < beyond[F.col("segment")])
        probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
        # merged: the probes are many more than the size of their source tells the planner
        met = probes.join(index.hint("merge"), ["segment", "value"]).withColumn("distance", distance).where(F.col("distance") <= F.col("far"))
        met = met.where((F.array_min(apart) == s) & (F.array_position(apart, F.lit(s)) == F.col("segment") + 1))
        found = met.select("code", F.explode("ids").alias("id"), "distance")
        best = staged(best.unionByName(found).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= enough).drop("nth"), "best")
        last = best.groupBy("code").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        # nothing nearer than this is unseen: each segment passed at s adds one, each at s - 1 had added its own
        covered = segments * (s + 1) if only is None else segments * s + only + 1
        still = still.join(last, "code", "left").withColumn("far", F.when(F.col("n") == enough, F.col("last")).otherwise(F.col("far")))
        still = staged(still.where(F.col("far") >= covered).select("code", "far"), "still")
        if still.isEmpty():
            break
    pairs = queries.select(F.col("id").alias("query_id"), "code").join(best, "code").where(F.col("id") != F.col("query_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance")


def _masks(bits: int, ones: int) -> list[int]:
    return [sum(1 << i for i in chosen) for chosen in combinations(range(bits), ones)]


def search(vectors: DataFrame, every: int = 100, k: int = 10, segment_bits: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows by Hamming distance of sign codes, for each row whose id is divisible by ``every``."""
    whole = vectors.agg(F.max(F.size(vector_col)).alias("bits"), F.count("*").alias("n")).first()
    bits = max(whole["bits"] or 0, 0)
    if segment_bits is None:
        segments = max(1, ceil(bits / max(8.0, log2(max(whole["n"] / MET, 2)))), -(-bits // 32))
        segment_bits = max(1, -(-bits // segments))
    rows = staged(codes(vectors, bits, segment_bits, id_col, vector_col), "rows")
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    return top_k(rows, queries, k, segment_bits, bits).withColumnRenamed("id", id_col)
