"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features (shares of character classes, word lengths,
repeated words, repeated lines, end marks) are cut into bins; the field has a weight for each bin of
the line itself, of the line before and of the line after, and for each pair of neighbouring labels.
Forward-backward gives each line's marginal probability of being good; a document's quality is their
mean weighted by line length, calibrated by a logistic curve.

The field is fitted on at most ``train_docs`` labelled documents of each class (those with the smallest
hash of their id) and ``train_bytes`` of text (in that order, none longer than a 64th of it): documented
bounds. The document's label is given to its lines; calibration weighs the two classes as often as the
labels have them. Scoring is a map over whole texts.

Lines are parted by newlines; empty lines are skipped; null, empty and all-blank texts count as one
empty line. Without labels of both classes every text scores the share of good labels (0.5 if there
are none). Repeated rows each give a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import _words, code_points, crc_mod, filtered, piece_hashes, ragged, slices, small_batches, tidy
from tarnwork.llm.ragged_bpe import LETTER, NUMBER, SPACE, classes

BLANK, LOWER, UPPER, DIGIT, STOP, COMMA, SHOUT, BAR, SIGN, MARK, REST = range(11)
KINDS = 11
BINS = 8
#: Bytes of text whose lines are described at a time (about 100 bytes of memory for each).
STEP_BYTES = 1 << 20


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Kind of every code point."""
    base = classes()
    out = np.full(0x110000, REST, np.uint8)
    out[base == SPACE], out[base == LETTER], out[base == NUMBER] = BLANK, LOWER, DIGIT
    for c in range(0x3000):
        if unicodedata.category(chr(c)) in ("Lu", "Lt"):
            out[c] = UPPER
        elif unicodedata.category(chr(c))[0] == "P":
            out[c] = MARK
        elif unicodedata.category(chr(c))[0] == "S":
            out[c] = SIGN
    for kind, letters in ((STOP, ".…"), (COMMA, ",;"), (SHOUT, "!?"), (BAR, "|¦"), (SIGN, "#%&*@\\_~")):
        out[[ord(c) for c in letters]] = kind
    return out


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, row of each line, characters of each line)."""
    rows = len(at) - 1
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    newline = data == 10
    inside = ~newline
    begin = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], newline[:-1]]))) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (edge[1:] | np.append(newline[1:], True))) + 1 if len(data) else begin
    row = np.searchsorted(at, begin, "right") - 1
    none = np.setdiff1d(np.arange(rows), row)  # rows without a line get an empty one
    order = np.argsort(np.concatenate([row, none]), kind="stable")
    row = np.concatenate([row, none])[order]
    begin, end = (np.concatenate([x, at[none]])[order] for x in (begin, end))
    lines = len(row)
    points, _ = code_points(data, at)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    first, last = before[begin], before[end]
    chars = last - first
    step = np.zeros(len(points) + 1, np.int32)
    np.add.at(step, first[chars > 0], 1)
    line = np.flatnonzero(chars > 0)[np.maximum(np.cumsum(step[:-1]) - 1, 0)] if (chars > 0).any() else np.zeros(0, np.int64)
    kind = _kinds()[points]
    count = np.bincount(line * KINDS + kind, minlength=lines * KINDS).reshape(lines, KINDS).astype(float)
    count[:, BLANK] -= np.bincount(line[points == 10], minlength=lines)
    # words: runs without blanks, compared with the one before
    solid = (data != 32) & ~newline
    start = np.flatnonzero(solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]]))) if len(data) else begin[:0]
    stop = np.flatnonzero(solid & (edge[1:] | np.append(~solid[1:], True))) + 1 if len(data) else start
    n = stop - start
    owner = np.searchsorted(begin, start, "right") - 1
    owner = np.minimum(owner, lines - 1)
    h = piece_hashes(_words(data), start, n) if len(start) else np.zeros(0, np.uint64)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    words = np.bincount(owner, minlength=lines)
    repeats = np.bincount(owner, again, lines)
    long = np.bincount(owner, n > 16, lines)
    lone = np.bincount(owner, n == 1, lines)
    whole = np.zeros(lines, np.uint64)
    some = np.flatnonzero(end > begin)
    if len(some):
        whole[some] = piece_hashes(_words(data), begin[some], (end - begin)[some])
    _, where, times = np.unique(np.stack([row.astype(np.uint64), whole]), axis=1, return_inverse=True, return_counts=True)
    total = np.maximum(chars, 1)
    letters = np.maximum(count[:, LOWER] + count[:, UPPER], 1)
    tail = np.where(chars > 0, kind[np.maximum(last - 1, 0)] if len(kind) else 0, 0)
    head = np.where(chars > 0, kind[np.minimum(first, max(len(kind) - 1, 0))] if len(kind) else 0, 0)
    w = np.maximum(words, 1)
    features = [
        np.log1p(chars), np.log1p(words), chars / w, repeats / w, long / w, lone / w, np.minimum(times[where.ravel()], 5),
        *(count[:, k] / total for k in (BLANK, LOWER, DIGIT, STOP, COMMA, SHOUT, BAR, SIGN, MARK, REST)),
        count[:, UPPER] / letters, tail == STOP, head == UPPER,
    ]
    return np.stack([np.asarray(f, float) for f in features], axis=1), row, chars


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of any number of texts, a few at a time."""
    parts, rows = [], 0
    for batch in slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])], limit=STEP_BYTES):
        features, row, chars = line_features(*ragged(batch.column("text")))
        parts.append((features, row + rows, chars))
        rows += batch.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts))


def chain(u: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log-odds of label 1, and the order that was used; ``u``: log-odds of each line alone.

    ``sizes``: lines of each document (1 at least), end to end; ``t[a, b]``: weight of label a before b.
    """
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = begin[order], sizes[order]
    forward, backward = u.copy(), np.zeros(len(u))
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # documents with more than i lines
    for i in range(1, longest):
        at = begin[: active[i]] + i
        x = forward[at - 1]
        forward[at] += np.logaddexp(x + t[1, 1], t[0, 1]) - np.logaddexp(x + t[1, 0], t[0, 0])
    for i in range(longest - 2, -1, -1):
        at = begin[: active[i + 1]] + i
        x = u[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(x + t[1, 1], t[1, 0]) - np.logaddexp(x + t[0, 1], t[0, 0])
    return forward, backward, order


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Field:
    """Bin edges, weights of a line's own bins, of its neighbours' bins, transitions and calibration."""

    edges: list[np.ndarray]
    weights: np.ndarray  # (3, features, BINS): itself, the line before, the line after
    bias: np.ndarray  # (3,): always, without a line before, without a line after
    moves: np.ndarray  # (2, 2)
    slope: float = 1.0
    shift: float = 0.0
    prior: float | None = None  # the score of everything, where there was nothing to learn

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, features[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def alone(self, bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log-odds of each line without the chain."""
        own, as_before, as_after = (np.take_along_axis(w.T, bins, axis=0).sum(axis=1) for w in self.weights)
        begin = np.cumsum(sizes) - sizes
        first, last = np.zeros(len(bins), bool), np.zeros(len(bins), bool)
        first[begin], last[begin + sizes - 1] = True, True
        out = own + self.bias[0]
        out += np.where(first, self.bias[1], np.roll(as_before, 1))
        return out + np.where(last, self.bias[2], np.roll(as_after, -1))

    def quality(self, features: np.ndarray, sizes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, as log-odds, by document."""
        u = self.alone(self.bins(features), sizes)
        forward, backward, _ = chain(u, sizes, self.moves)
        good = _sigmoid(forward + backward)
        weight = np.maximum(chars, 1)
        begin = np.cumsum(sizes) - sizes
        mean = np.clip(np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin), 1e-9, 1 - 1e-9)
        return np.log(mean / (1 - mean))

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows = len(at) - 1
        if self.prior is not None or not rows:
            return np.full(rows, self.prior or 0.0)
        features, row, chars = line_features(data, at)
        return _sigmoid(self.slope * self.quality(features, np.bincount(row, minlength=rows), chars) + self.shift)


def train(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), rounds: int = 160, ridge: float = 1e-3) -> Field:
    """Fit by gradient steps (Adam) on the labels' likelihood; ``weights`` of the classes 0 and 1 in calibration."""
    features, row, chars = features_of(texts)
    y_doc = np.array(labels, float)
    sizes = np.bincount(row, minlength=len(texts))
    y = y_doc[row]
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = []
    for k in range(features.shape[1]):
        varied = features[:, k][features[:, k] > features[:, k].min()]
        cut = np.quantile(varied, quantiles) if len(varied) else np.zeros(0)
        edges.append(np.unique(np.append(cut, varied.min() if len(varied) else []))[: BINS - 1])
    field = Field(edges, np.zeros((3, len(edges), BINS)), np.zeros(3), np.zeros((2, 2)))
    bins = field.bins(features)
    begin = np.cumsum(sizes) - sizes
    first, last = np.zeros(len(y), bool), np.zeros(len(y), bool)
    first[begin], last[begin + sizes - 1] = True, True
    flat = bins + np.arange(len(edges)) * BINS
    line_weight = 1 / sizes[row]  # long documents count no more than short ones
    scale = 1 / len(texts)
    edge = np.flatnonzero(~last)
    state = [field.weights, field.bias, field.moves]
    mean, square = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    for step in range(1, rounds + 1):
        u = field.alone(bins, sizes)
        forward, backward, _ = chain(u, sizes, field.moves)
        wrong = (y - _sigmoid(forward + backward)) * line_weight * scale
        gradient = [np.zeros_like(s) for s in state]
        for k, miss in enumerate((wrong, np.roll(np.where(first, 0, wrong), -1), np.roll(np.where(last, 0, wrong), 1))):
            gradient[0][k] = np.bincount(flat.ravel(), np.repeat(miss, len(edges)), len(edges) * BINS).reshape(-1, BINS)
        gradient[1][:] = wrong.sum(), wrong[first].sum(), wrong[last].sum()
        joint = np.stack([np.full(len(edge), field.moves[a, b]) + a * forward[edge] + b * (u[edge + 1] + backward[edge + 1]) for a in (0, 1) for b in (0, 1)])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        pair = line_weight[edge] * scale
        for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            gradient[2][a, b] = (((y[edge] == a) & (y[edge + 1] == b)) * pair - joint[k] * pair).sum()
        for s, g, m, q in zip(state, gradient, mean, square):
            g -= ridge * s
            m += 0.1 * (g - m)
            q += 0.02 * (g * g - q)
            s += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.98**step)) + 1e-9)
    x = np.clip(field.quality(features, sizes, chars), -12, 12)
    w = np.where(y_doc == 1, weights[1], weights[0])
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton steps of a logistic curve, held near a slope of 1
        p = _sigmoid(a * x + b)
        r, h = w * (y_doc - p), w * p * (1 - p) + 1e-6
        g = np.array([(r * x).sum() - (a - 1), r.sum()])
        hess = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hess, g)
        a, b = a + np.clip(move[0], -1, 1), b + np.clip(move[1], -1, 1)
    field.slope, field.shift = float(max(a, 0.05)), float(b)
    return field


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 1500, train_bytes: int = 32 << 20, modulus: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """The field of at most ``train_docs`` documents of each class, none with crc32(id) % modulus = held_out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (crc_mod(id_col, modulus) != held_out))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    # the first by hash of each class: every task sends its own first ones, no class is gathered
    firsts = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(train_docs).collect() for y in sorted(counts)] if len(counts) == 2 else []
    label, order = {}, []
    for pair in zip_longest(*firsts):
        for r in filter(None, pair):
            label.setdefault(r["id"], r["y"])
            order.append(r["id"])
    source = docs.where(F.col(id_col).isin(list(label))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = {r["id"]: r["n"] for r in source.groupBy("id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).collect()}
    chosen, left = [], train_bytes
    for i in dict.fromkeys(order):
        if i in size and size[i] <= min(left, train_bytes // 64):
            chosen.append(i)
            left -= size[i]
    rows = sorted((r["id"], r["text"] or "") for r in source.where(F.col("id").isin(chosen)).collect()) if chosen else []
    ys = [label[i] for i, _ in rows]
    if len(set(ys)) < 2:
        return Field([], np.zeros((3, 0, BINS)), np.zeros(3), np.zeros((2, 2)), prior=prior)
    have = {y: ys.count(y) for y in (0, 1)}
    return train([t for _, t in rows], ys, tuple(counts[y] / have[y] * len(ys) / sum(counts.values()) for y in (0, 1)))


def score(docs: DataFrame, field: Field, threshold: float = 0.3, modulus: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 from ``threshold`` on)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(field)
    source = docs.select(F.col(id_col).alias("id"), (crc_mod(id_col, modulus) == held_out).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=STEP_BYTES):
            s = shared.value.scores(*ragged(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, field: Field, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns; a map without a join."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return filtered(docs, text_col, lambda text: shared.value.scores(*ragged(text)) >= threshold, STEP_BYTES)
