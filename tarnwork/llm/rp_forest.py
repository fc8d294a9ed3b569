"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on ``sample_rows`` vectors (those with the smallest hash; a documented bound); a
node splits at the median of the projection on the difference of two of its vectors. Every distinct
vector is put into its leaf of every tree. A query walks all trees through one shared priority queue,
always going on at the smallest margin yet passed over, until the leaves it has opened hold ``share``
of the sample. The members of opened leaves are reranked by exact cosine in double precision, leaf by
leaf, and the best of all leaves are merged. Leaves too large for one task are salted.

``share`` sets recall. Where it is not given, it is measured: some vectors of the sample search the others of it, and the
least share at which they find ``recall`` of their true k nearest is taken. Vectors without structure (such as
independent directions in 64 dimensions) need near half of all rows for 0.9, clustered ones far less.

Equal vectors are met as one with their k + 1 smallest ids, which is exact since ties go to the smaller
id. Vectors that are null, zero, of another dimension than the largest, or hold null or non-finite
components take no part. With fewer than k candidates all found are returned; repeated rows count as
rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.common import staged

#: Vectors that one rerank block holds on average at most.
BLOCK_ROWS = 8192
#: Rows that a leaf holds at least on average, whatever the sample allows.
LEAF_ROWS = 64


@dataclass
class Forest:
    """Complete binary trees: node directions (trees, nodes, dims), thresholds, and the sample's rows by leaf."""

    directions: np.ndarray
    thresholds: np.ndarray
    leaves: list[list[np.ndarray]]
    depth: int
    sample: int

    @staticmethod
    def fit(x: np.ndarray, trees: int, depth: int, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        nodes = (1 << depth) - 1
        directions, thresholds = np.zeros((trees, nodes, x.shape[1])), np.zeros((trees, nodes))
        leaves = []
        for t in range(trees):
            members = [np.arange(len(x))]
            for node in range(nodes):
                m = members[node]
                w = rng.standard_normal(x.shape[1])
                if len(m) > 1:
                    a, b = x[rng.choice(m, 2, replace=False)]
                    if (a != b).any():
                        w = a - b
                w /= np.linalg.norm(w)
                p = x[m] @ w
                cut = np.median(p) if len(m) else 0.0
                directions[t, node], thresholds[t, node] = w, cut
                members += [m[p <= cut], m[p > cut]]
            leaves.append(members[nodes:])
        return Forest(directions, thresholds, leaves, depth, len(x))

    def leaf_of(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Leaf number of each (unit) vector in one tree."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", x, self.directions[tree, node]) > self.thresholds[tree, node]
            node = 2 * node + 1 + side
        return node - ((1 << self.depth) - 1)

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(tree, leaf, share of the sample in the leaves before it) in the order in which one query opens leaves."""
        margins = self.directions @ x - self.thresholds
        inner = margins.shape[1]
        queue = [(0.0, t, 0) for t in range(len(margins))]
        seen, covered = np.zeros(self.sample, bool), 0
        while queue:
            passed, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t, node]
                near = 2 * node + 1 + int(m > 0)
                heapq.heappush(queue, (max(passed, abs(m)), t, 4 * node + 3 - near))
                node = near
            yield t, node - inner, covered / max(self.sample, 1)
            rows = self.leaves[t][node - inner]
            covered += len(rows) - int(np.count_nonzero(seen[rows]))
            seen[rows] = True

    def visit(self, x: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves that one query opens: until those before hold ``share`` of the sample."""
        return [(t, leaf) for t, leaf, _ in takewhile(lambda v: v[2] < share, self.walk(x))]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v (array<double>) of the rows that take part."""
    v = F.col("v")
    plain = dict(vectors.dtypes)[vector_col] == "array<float>"  # such vectors travel as they are; all sums are of doubles
    rows = vectors.select(F.col(id_col).alias("id"), (F.col(vector_col) if plain else F.col(vector_col).cast("array<double>")).alias("v")).where(v.isNotNull() & F.col("id").isNotNull())
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists(v, lambda x: x != 0))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.where(F.size("v") == dims)


def measured_share(x: np.ndarray, trees: int, depth: int, k: int, recall: float, tries: int = 80) -> float:
    """The least share at which the first ``tries`` (unit) vectors find ``recall`` of their k nearest among the others."""
    tries = min(tries, len(x) // 4)
    asked, rest = x[:tries], x[tries:]
    if not tries or len(rest) <= k:
        return 1.0
    forest = Forest.fit(rest, trees, depth)
    home = [forest.leaf_of(rest, t) for t in range(trees)]
    needed = []
    for q in asked:
        waiting = set(np.argpartition(-(rest @ q), k)[:k].tolist())
        where: dict[tuple[int, int], list[int]] = {}
        for i in waiting:
            for t in range(trees):
                where.setdefault((t, int(home[t][i])), []).append(i)
        for t, leaf, before in forest.walk(q):  # a leaf is opened if those before hold less than the share
            found = waiting.intersection(where.get((t, leaf), ()))
            needed += [before] * len(found)
            waiting -= found
            if not waiting:
                break
    return float(np.quantile(needed, recall)) + 1e-9


def search(vectors: DataFrame, every: int = 50, k: int = 5, trees: int = 16, sample_rows: int = 8192, share: float | None = None, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k nearest rows found for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = staged(valid(vectors, id_col, vector_col), "vectors")
    total = rows.count()
    kind, form = (rows.schema[c].dataType.simpleString() for c in ("id", "v"))
    if not total:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    ranked = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    distinct = staged(ranked.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "distinct")
    sample = np.array([r["v"] for r in distinct.orderBy(F.xxhash64("v")).select("v").limit(sample_rows).collect()])
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    depth = max(0, min(int(np.log2(len(unit) / 64)) if len(unit) > 64 else 0, int(np.log2(max(1, total / LEAF_ROWS)))))
    if share is None:
        share = measured_share(unit, trees, depth, k, recall)
    forest = spark.sparkContext.broadcast(Forest.fit(unit, trees, depth))
    salts = max(1, -(-total // (BLOCK_ROWS << depth)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            if not len(x):
                continue
            x /= np.linalg.norm(x, axis=1)[:, None]
            for t in range(trees):
                leaf = forest.value.leaf_of(x, t)
                salt = np.arange(len(x)) % salts
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(salt.astype(np.int32)), batch.column("ids"), batch.column("v")], ["tree", "leaf", "salt", "ids", "v"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(_matrix(batch.column("v"))):
                at = np.repeat(np.array(forest.value.visit(x / np.linalg.norm(x), share), np.int32), salts, axis=0)
                salt = np.arange(len(at), dtype=np.int32) % salts
                who = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(salt), batch.column("query").take(who), batch.column("v").take(who)], ["tree", "leaf", "salt", "query", "v"])

    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    queries = staged(asked.groupBy("v").agg(F.min("id").alias("query")), "queries")  # equal vectors ask once
    members = distinct.mapInArrow(assign, f"tree int, leaf int, salt int, ids array<{kind}>, v {form}")
    visits = queries.select("query", "v").mapInArrow(walk, f"tree int, leaf int, salt int, query {kind}, v {form}")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        who, found, scores = [], [], []
        if left.num_rows and right.num_rows:
            x, q = _matrix(left.column("v")), _matrix(right.column("v"))
            nx, nq = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            ids, asked = left.column("ids").to_pylist(), right.column("query").to_pylist()
            keep = min(k + 1, len(x))
            for a in range(0, len(q), 256):
                rough = (q[a : a + 256] @ x.T) / nx / nq[a : a + 256, None]
                bar = -np.partition(-rough, keep - 1, axis=1)[:, keep - 1] - 1e-9  # ties at the bar stay
                i, j = np.nonzero(rough >= bar[:, None])
                exact = (q[a + i] * x[j]).sum(axis=1) / (nq[a + i] * nx[j])
                for r, c, s in zip(i.tolist(), j.tolist(), exact.tolist()):
                    who += [asked[a + r]] * len(ids[c])
                    found += ids[c]
                    scores += [s] * len(ids[c])
        return pa.table({"query": pa.array(who, right.schema.field("query").type), "id": pa.array(found, right.schema.field("query").type), "score": pa.array(scores, pa.float64())})

    keys = ["tree", "leaf", "salt"]
    near = members.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(rerank, f"query {kind}, id {kind}, score double")
    near = near.groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    pairs = asked.select(F.col("id").alias("query_id"), "v").join(queries, "v").select("query_id", "query").join(best, "query").where(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    final = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return final.select("query_id", "rank", F.col("id").alias(id_col), "score")
