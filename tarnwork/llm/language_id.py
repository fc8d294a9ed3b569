"""Language identification with interpolated Kneser-Ney character models.

One model per language is learned from at most ``train_docs`` labelled documents of that language
(those with the smallest hash of their id) and ``train_bytes`` of text of all languages (the first of each
language, then the second, ...; none longer than a 64th of it): documented bounds. Texts are lower-cased; every run of
characters other than letters is one blank; characters are 16-bit codes, so an n-gram of four is one
64-bit key. Each order's continuation counts are interpolated with absolute discounts. The finished
log-probabilities lie in sorted hash arrays (mixed keys, one row of values for all languages, an index
of the leading bits), which are broadcast: their size is bounded by the training bound, not by the data.
A text's language has the lowest cross-entropy per character. ``score`` is the calibrated probability
of that choice: a softmax over the per-character differences times a temperature fitted on labelled
texts kept back from learning, halved or worse where the text's cross-entropy lies far above what such
texts of the language show. A text is rejected if its score is below ``reject_below`` or it has no letter.

Null, empty and letterless texts are ``und`` with score 0. Ties go to the language that sorts first.
Whole texts are scored; repeated rows each give a row; extra columns are ignored; an empty table, or
one without labels, gives ``und`` for every row there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.common import code_points, crc_mod, filtered, ragged, slices, small_batches, tidy
from tarnwork.llm.ragged_bpe import LETTER, classes

ORDER = 4
BLANK = 32
#: Bytes of text that are scored at a time (about 100 bytes of memory for each).
STEP_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _folded() -> np.ndarray:
    """16-bit code of every code point: lower case letters as they are, all else a blank."""
    out = np.full(0x110000, BLANK, np.uint16)
    letters = np.flatnonzero(classes() == LETTER)
    out[letters] = [ord(chr(c).lower()[0]) & 0xFFFF for c in letters.tolist()]
    return out


def letters_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes end to end, offsets, whether a row has a letter); each row is led by three blanks and ends with one."""
    points, begins = code_points(data, at)
    codes = _folded()[points]
    size = np.diff(begins)
    begins = begins[:-1] + 4 * np.arange(len(size))
    out = np.full(len(codes) + 4 * len(size), BLANK, np.uint16)
    row = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(codes)) + 4 * row + 3] = codes
    blank = out == BLANK
    keep = np.ones(len(out), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    lead = (begins[:, None] + np.arange(3)).ravel()
    keep[lead] = True
    keep[begins + 3] &= ~blank[begins + 3]  # no fourth leading blank
    ends = np.append(begins[1:], len(out))
    tail = ends - 1  # a row's own last blank
    keep[tail] = ~blank[tail - 1] | (tail - begins == 3)
    kept = np.concatenate([[0], np.cumsum(keep)])
    offsets = np.append(kept[begins], kept[-1])
    return out[keep], offsets, np.diff(np.concatenate([[0], np.cumsum(~blank)])[np.append(begins, len(out))]) > 0


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Key of the n codes that end at each place (places before the n-th hold nonsense)."""
    key = codes.astype(np.uint64)
    for k in range(1, n):
        key[k:] |= codes[:-k].astype(np.uint64) << np.uint64(16 * k)
    return key


class HashArrays:
    """Sorted mixed keys with a row of float32 values each, and an index of the leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        mixed = keys * _ODD
        order = np.argsort(mixed)
        self.mixed, self.values = mixed[order], values[order].astype(np.float32)
        self.bits = max(8, int(4 * len(keys)).bit_length())
        head = (self.mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(head, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deep = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        mixed = keys * _ODD
        head = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        out = np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(at < end)
        at, end, mixed = at[left], end[left], mixed[left]
        for _ in range(self.deep):
            hit = self.mixed[at] == mixed
            out[left[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end, mixed = left[more], at[more], end[more], mixed[more]
            if not len(left):
                break
        return out


@dataclass
class Model:
    """Languages, and for each order the n-grams' log-probabilities and the contexts' log back-off weights."""

    languages: list[str]
    orders: list[HashArrays]
    contexts: list[HashArrays]
    floor: float
    temperature: float = 1.0
    usual: np.ndarray | None = None  # median cross-entropy of each language's own texts
    far: np.ndarray | None = None  # and its spread

    def losses(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in nats per character by row and language, characters scored)."""
        rows, many = len(offsets) - 1, len(self.languages)
        scored = np.ones(len(codes), bool)
        scored[(offsets[:-1, None] + np.arange(3)).ravel()] = False
        places = np.flatnonzero(scored)
        row = np.repeat(np.arange(rows), np.diff(offsets) - 3)
        n = np.bincount(row, minlength=rows)
        keys = grams(codes, ORDER)[places]
        top = self.orders[-1]
        at = top.find(keys)
        total = np.zeros((rows, many))
        hit = at >= 0
        known = top.values[at[hit]]
        for k in range(many):
            total[:, k] = np.bincount(row[hit], known[:, k], rows)
        left, keys = np.flatnonzero(~hit), keys[~hit]
        weight = np.zeros((len(left), many))
        for order in range(ORDER - 1, 0, -1):  # back off where the longer n-gram is new to all languages
            context = keys >> np.uint64(16) if order == ORDER - 1 else (keys & np.uint64((1 << 16 * (order + 1)) - 1)) >> np.uint64(16)
            back = self.contexts[order].find(context)
            weight += np.where((back >= 0)[:, None], self.contexts[order].values[back], 0.0)
            short = keys & np.uint64((1 << 16 * order) - 1)
            at = self.orders[order - 1].find(short)
            hit = at >= 0
            found = weight[hit] + self.orders[order - 1].values[at[hit]]
            for k in range(many):
                total[:, k] += np.bincount(row[left[hit]], found[:, k], rows)
            left, keys, weight = left[~hit], keys[~hit], weight[~hit]
        for k in range(many):
            total[:, k] += np.bincount(row[left], weight[:, k] + self.floor, rows)
        return -total / np.maximum(n, 1)[:, None], n

    def judge(self, loss: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the chosen language, calibrated score)."""
        best = np.argmin(loss, axis=1)
        gap = (loss - loss.min(axis=1)[:, None]) * self.temperature * np.sqrt(np.maximum(n, 1))[:, None]
        odds = 1 / np.exp(-gap).sum(axis=1)
        excess = (loss[np.arange(len(best)), best] - self.usual[best]) / np.maximum(self.far[best], 3 / np.sqrt(np.maximum(n, 1)))
        return best, odds / (1 + np.exp(np.clip(excess - 12.0, -30, 30)))


def _kneser_ney(codes: np.ndarray, offsets: np.ndarray, alphabet: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By order: (n-gram keys, interpolated log-probabilities, context keys, log back-off weights)."""
    scored = np.ones(len(codes), bool)
    scored[(offsets[:-1, None] + np.arange(3)).ravel()] = False
    keys, counts = np.unique(grams(codes, ORDER)[scored], return_counts=True)
    tables = {ORDER: (keys, counts)}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: how many characters stand before an n-gram
        tables[n] = np.unique(tables[n + 1][0] & np.uint64((1 << 16 * n) - 1), return_counts=True)
    out, lower = [], None
    for n in range(1, ORDER + 1):
        keys, counts = tables[n]
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context, inverse, types = np.unique(keys >> np.uint64(16), return_inverse=True, return_counts=True)
        total = np.bincount(inverse, counts)
        back = discount * types / total
        if lower is None:
            below = np.full(len(keys), 1.0 / alphabet)
        else:
            below = np.exp(lower[1][np.searchsorted(lower[0], keys & np.uint64((1 << 16 * (n - 1)) - 1))])
        lower = (keys, np.log(np.maximum(counts - discount, 0) / total[inverse] + back[inverse] * below))
        out.append((*lower, context, np.log(back)))
    return out


def train(texts: list[str], languages: list[str]) -> Model | None:
    """Models of all languages from labelled texts; every fifth text of a language with ten or more is kept back for calibration."""
    names = sorted(set(languages))
    if not names:
        return None
    data, at = ragged(pa.array(texts, pa.large_string()))
    codes, offsets, _ = letters_of(data, at)
    alphabet = len(np.unique(codes)) + 1
    label = np.array([names.index(x) for x in languages])
    nth = np.zeros(len(label), np.int64)
    for k in range(len(names)):
        nth[label == k] = np.arange((label == k).sum())
    back = (np.bincount(label)[label] >= 10) & (nth % 5 == 4)
    own = []
    for k in range(len(names)):
        rows = np.flatnonzero((label == k) & ~back)
        parts = [codes[offsets[r] : offsets[r + 1]] for r in rows]
        own.append(_kneser_ney(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), alphabet))
    floor = -np.log(alphabet)
    orders, contexts = [], [HashArrays(np.zeros(0, np.uint64), np.zeros((0, len(names))))]
    dense = [[dict(zip(t[0].tolist(), t[1].tolist())) for t in m] for m in own]
    backs = [[dict(zip(t[2].tolist(), t[3].tolist())) for t in m] for m in own]

    def score(k: int, key: int, n: int) -> float:
        weight = 0.0
        for order in range(n, 0, -1):
            short = key & ((1 << 16 * order) - 1)
            found = dense[k][order - 1].get(short)
            if found is not None:
                return weight + found
            weight += backs[k][order - 1].get(short >> 16, 0.0)
        return weight + floor

    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([m[n - 1][0] for m in own]))
        orders.append(HashArrays(keys, np.array([[score(k, key, n) for k in range(len(names))] for key in keys.tolist()]).reshape(-1, len(names))))
        if n > 1:
            keys = np.unique(np.concatenate([m[n - 1][2] for m in own]))
            contexts.append(HashArrays(keys, np.array([[backs[k][n - 1].get(key, 0.0) for k in range(len(names))] for key in keys.tolist()]).reshape(-1, len(names))))
    model = Model(names, orders, contexts, float(floor))
    judged = np.array([back[label == k].any() for k in range(len(names))])[label] <= back  # others are judged on what they were learned from
    loss, n = (x[judged] for x in model.losses(codes, offsets))
    label = label[judged]
    mine = loss[np.arange(len(label)), label]
    model.usual = np.array([np.median(mine[label == k]) for k in range(len(names))])
    model.far = np.array([max(0.05, 1.4826 * np.median(np.abs(mine[label == k] - model.usual[k]))) for k in range(len(names))])
    best = (np.inf, 1.0)
    for temperature in np.geomspace(0.05, 50, 31):  # least log loss on these texts
        gap = (loss - loss.min(axis=1)[:, None]) * temperature * np.sqrt(np.maximum(n, 1))[:, None]
        logp = -gap[np.arange(len(label)), label] - np.log(np.exp(-gap).sum(axis=1))
        best = min(best, (-np.mean(np.maximum(logp, -20)), temperature))
    model.temperature = float(best[1])
    return model


def fit(docs: DataFrame, train_docs: int = 300, train_bytes: int = 16 << 20, languages: int = 1000, modulus: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model of at most ``train_docs`` documents of each of the ``languages`` most frequent languages, none with crc32(id) % modulus = held_out."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) > 0) & (crc_mod(id_col, modulus) != held_out))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.octet_length(text_col).alias("n")).where(F.col("n") <= train_bytes // 64)
    # hashes up to a bar hold about four times as many as are wanted, so no language is gathered
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    bars = counts.select("lang", F.greatest(F.lit(1), F.ceil(F.lit(4.0 * train_docs * (1 << 20)) / F.col("count"))).alias("bar"))
    order = Window.partitionBy("lang").orderBy("h", "id")
    some = known.join(F.broadcast(bars), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("bar"))
    chosen = some.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= train_docs).select("id", "lang", "n", "nth").collect()
    ids, left = [], train_bytes
    for r in sorted(chosen, key=lambda r: (r["nth"], r["lang"])):
        if r["n"] <= left:
            ids.append(r["id"])
            left -= r["n"]
    if not ids:
        return None
    own = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isin(ids))
    rows = own.select(F.coalesce(text_col, F.lit("")).alias("text"), F.col(lang_col).alias("lang")).collect()
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None, modulus: int = 3, held_out: int = 1, reject_below: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, accepted."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), (crc_mod(id_col, modulus) == held_out).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, limit=STEP_BYTES):
            codes, offsets, lettered = letters_of(*ragged(batch.column("text")))
            names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if model is not None:
                best, odds = model.judge(*model.losses(codes, offsets))
                names[lettered] = np.array(model.languages, object)[best[lettered]]
                score[lettered] = odds[lettered]
            accepted = lettered & (score >= reject_below)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], ["id", "held_out", "lang_pred", "score", "accepted"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"id {kind}, held_out boolean, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Model | None, reject_below: float = 0.02, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns; a map without a join."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def accepted(text: pa.Array) -> np.ndarray:
        codes, offsets, lettered = letters_of(*ragged(text))
        if shared.value is None:
            return lettered & False
        return lettered & (shared.value.judge(*shared.value.losses(codes, offsets))[1] >= reject_below)

    return filtered(docs, text_col, accepted, STEP_BYTES)
