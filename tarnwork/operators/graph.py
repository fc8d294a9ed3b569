"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.scratch import staged, unstage

#: Edge tables up to this many rows (counted first) are solved by one task in memory.
LOCAL_EDGES = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the least id reachable) of every end of ``edges`` (columns a, b of one type).

    Each step hands every node's neighbours the least of them, so the edges turn into stars around the
    least ids in a logarithmic number of steps. No neighbourhood is gathered: hubs cost a partial
    minimum and a join whose large side can be split. ``scraps`` of the result are the staged tables that it reads;
    once it is written, ``unstage`` may drop them.
    """
    a, b = F.col("a"), F.col("b")
    edges = edges.where(a.isNotNull() & b.isNotNull())
    edges = staged(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")), "edges")
    if edges.count() <= LOCAL_EDGES:
        kind = edges.schema["a"].dataType.simpleString()
        found = edges.coalesce(1).mapInArrow(_local, f"id {kind}, component {kind}")
        found.scraps = [edges]
        return found
    now = staged(edges.where(a != b).distinct(), "distinct")
    while not _stars(now):
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        large = staged(large.where(a != b).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        done, now = now, staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        unstage(done, large)
    ends = edges.select(a.alias("id")).unionByName(edges.select(b.alias("id"))).distinct()
    found = ends.join(now.select(a.alias("id"), b.alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))
    found.scraps = [edges, now]
    return found


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of one task's edges, all in memory: every node takes its neighbours' least root until none changes."""
    parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.concat_tables(parts)
    ids = pa.concat_arrays([*table.column("a").chunks, *table.column("b").chunks])
    names, place = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
    a, b = place[: table.num_rows], place[table.num_rows :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (root[a], root[b], a, b):
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(names, ids.type), pa.array(names[root], ids.type)], ["id", "component"])


def _stars(edges: DataFrame) -> bool:
    """Whether every left end has one edge, and no right end is a left end."""
    chained = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
    return chained.isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty()
