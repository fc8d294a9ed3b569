"""Byte-level BPE encoding and decoding: ranked merges folded over the byte arrays of distinct words.

Two forms with equal results:

``round_trip_native`` uses Spark's higher-order functions alone. A word's bytes become an array of byte
ids; ``aggregate`` folds the ranked merges over it: each step takes the lowest-ranked neighbouring pair
(leftmost first), joins it, and looks up the two pairs that it changed. The rank map is a literal: a
perfect hash table (displacement per residue) in constant arrays, since Spark searches map literals
entry by entry. A warm dictionary (a literal of the same kind, at most ``dictionary_words`` of about
``sample_docs`` documents) only decides which words are folded ahead of time; another word is folded
where it stands. Interpreted higher-order functions take over 5 times the time that the check tool
grants (figures in the README), so ``round_trip`` is the registered form.

``round_trip`` does the same over ragged arrays: words are cut with array operations, each distinct word
of a batch is folded once, decoding concatenates the ids' binary pieces. Neither form shuffles texts.

Null texts count as empty: no ids. Texts of any length are encoded whole; repeated rows each give a row;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import code_points, literal, ragged, slices, small_batches, spread, unique_pieces, tidy
from tarnwork.llm.ragged_bpe import Merges
from tarnwork.llm.token_counts import pre_tokens

#: public_tokenizers.PATTERN with Unicode character classes in Java's notation.
JAVA_PATTERN = "(?U)" + public_tokenizers.PATTERN


@lru_cache(2)
def ranks(path: str) -> tuple[bytes, ...]:
    """The tokens of a .tiktoken file by id."""
    with open(path, "rb") as f:
        found = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return tuple(found[i] for i in range(len(found)))


class PerfectHash:
    """key -> slot (key % ``spread`` + shift[key % ``residues``]) without collisions, for distinct non-negative keys."""

    def __init__(self, keys: np.ndarray):
        self.residues, self.spread = self.moduli(len(keys))
        group, base = keys % self.residues, keys % self.spread
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        groups = sorted(np.split(order, cuts), key=len, reverse=True) if len(keys) else []
        taken, self.shift = bytearray(4 * self.spread + 64), np.zeros(self.residues, np.int64)
        self.slot = np.zeros(len(keys), np.int64)
        for members in groups:
            places, d = base[members].tolist(), 0
            if len(set(places)) < len(places):
                raise ValueError("keys that no shift can part")
            while any(taken[p + d] for p in places):
                d += 1
            for p in places:
                taken[p + d] = 1
            self.shift[group[members[0]]] = d
            self.slot[members] = np.array(places) + d
        self.size = int(self.slot.max()) + 1 if len(keys) else 1

    @staticmethod
    def moduli(n: int) -> tuple[int, int]:
        return 2 * n // 3 | 1, 2 * n + 1 | 1

    def column(self, key: Column, shift: Column) -> Column:
        return key % self.spread + F.get(shift, (key % self.residues).cast("int"))


@lru_cache(2)
def pair_table(path: str) -> tuple[PerfectHash, np.ndarray, np.ndarray]:
    """(hash, keys by slot, merged ids by slot) of every two tokens whose bytes together are a token."""
    tokens = ranks(path)
    ids = {t: i for i, t in enumerate(tokens)}
    pairs = [(ids[t[:k]] << 16 | ids[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
    keys, merged = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    table = PerfectHash(keys)
    at, to = np.full(table.size, -1, np.int64), np.zeros(table.size, np.int64)
    at[table.slot], to[table.slot] = keys, merged
    return table, at, to


def bound(values: dict[str, Column], body) -> Column:
    """``body`` over the named constants, which the plan then holds once."""
    packed = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(packed), body), F.lit(0))


class Codec:
    """Column expressions that encode words and decode ids by a .tiktoken rank file."""

    def __init__(self, vocabulary: str = "byte_bpe_50k.tiktoken"):
        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self.tokens = ranks(path)
        ids = {t: i for i, t in enumerate(self.tokens)}
        self.table, at, to = pair_table(path)
        self.rank_map = {"shift": literal(self.table.shift), "keys": literal(at, "bigint"), "merged": literal(to), "byte_ids": literal(ids[bytes([b])] for b in range(256))}

    def rank(self, maps: Column, a: Column, b: Column) -> Column:
        """The merged id (which is its rank) of two neighbours, or null."""
        key = a.cast("bigint") * 65536 + b
        slot = self.table.column(key, maps["shift"]).cast("int")
        return F.when(F.get(maps["keys"], slot) == key, F.get(maps["merged"], slot))

    def fold(self, maps: Column, word: Column) -> Column:
        """The ids of one word (array<int>); ``maps``: the bound ``rank_map``."""
        letters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        ids = F.transform(letters, lambda c: F.get(maps["byte_ids"], F.ascii(c)))

        def begin(t: Column) -> Column:
            n = F.size(t)
            return F.struct(t.alias("t"), F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1), lambda a, b: self.rank(maps, a, b)).alias("r"))

        def join(s: Column, best: Column) -> Column:
            t, r, m, p = s["t"], s["r"], best["m"], best["p"]
            n = F.size(t)
            none = F.slice(r, 1, 0)
            left = F.when(p > 1, F.array(self.rank(maps, F.get(t, p - 2), m))).otherwise(none)
            right = F.when(p < n - 1, F.array(self.rank(maps, m, F.get(t, p + 1)))).otherwise(none)
            return F.struct(
                F.concat(F.slice(t, 1, p - 1), F.array(m), F.slice(t, p + 2, n)).alias("t"),
                F.concat(F.slice(r, 1, F.greatest(p - 2, F.lit(0))), left, right, F.slice(r, p + 2, n)).alias("r"),
            )

        def step(s: Column, _: Column) -> Column:
            low = F.array_min(s["r"])
            best = F.struct(low.alias("m"), F.array_position(s["r"], low).cast("int").alias("p"))
            return F.when(low.isNull(), s).otherwise(F.get(F.transform(F.array(best), lambda b: join(s, b)), F.lit(0)))

        folded = F.transform(F.array(ids), lambda t: F.aggregate(F.slice(t, 2, F.size(t) - 1), begin(t), step, lambda s: s["t"]))
        return F.get(folded, F.lit(0))

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids: their pieces, concatenated."""
        pieces = F.split(F.lit(",".join(t.hex() for t in self.tokens)), ",")
        return F.unhex(bound({"piece": pieces}, lambda x: F.array_join(F.transform(ids, lambda i: F.get(x["piece"], i)), "")))

    def packed(self, ids: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers (binary)."""
        words = F.split(F.lit(",".join(i.to_bytes(4, "little").hex() for i in range(len(self.tokens)))), ",")
        return F.unhex(bound({"word": words}, lambda x: F.array_join(F.transform(ids, lambda i: F.get(x["word"], i)), "")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(JAVA_PATTERN), F.lit(0))


class Dictionary:
    """A constant word -> ids table: words as hex, ids joined by commas, in slots of a perfect hash of their crc32."""

    def __init__(self, words: list[tuple[str, list[int]]]):
        found = {zlib.crc32(w.encode()): (w, i) for w, i in words}
        table = None
        while table is None:
            keys = np.array(list(found), np.int64)
            try:
                table = PerfectHash(keys)
            except ValueError:  # words that share both residues: one stays
                residues, spread = PerfectHash.moduli(len(keys))
                found = {k: found[k] for k in {(k % residues, k % spread): k for k in found}.values()}
        self.table = table
        texts, ids = [""] * table.size, [[]] * table.size
        for (w, i), slot in zip(found.values(), table.slot.tolist()):
            texts[slot], ids[slot] = w.encode().hex().upper(), i
        ends = np.cumsum([len(i) for i in ids])
        self.maps = {"word": F.split(F.lit(",".join(texts)), ","), "ids": literal([x for i in ids for x in i] or [0]), "end": literal([0, *ends.tolist()]), "move": literal(table.shift)}

    def look(self, maps: Column, word: Column) -> Column:
        """The word's ids, or null."""
        raw = F.encode(word, "UTF-8")
        slot = self.table.column(F.crc32(raw), maps["move"]).cast("int")
        begin = F.get(maps["end"], slot)
        return F.when(F.get(maps["word"], slot) == F.hex(raw), F.transform(F.sequence(begin, F.get(maps["end"], slot + 1) - 1), lambda i: F.get(maps["ids"], i)))


def warm_words(docs: DataFrame, codec: Codec, text_col: str, sample_docs: int, dictionary_words: int) -> list[tuple[str, list[int]]]:
    """The commonest words of about ``sample_docs`` documents, with their folded ids."""
    total = docs.count()
    text = F.col(text_col)
    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample_docs / max(total, 1))))
    words = sample.select(F.explode(words_of(text)).alias("word")).where(F.length("word") <= 64).groupBy("word").count()
    common = words.orderBy(F.desc("count"), "word").limit(dictionary_words)
    folded = common.repartition(max(8, dictionary_words // 20_000)).select("word", bound(codec.rank_map, lambda m: codec.fold(m, F.col("word"))).alias("ids"))
    return [(r["word"], r["ids"]) for r in folded.toLocalIterator()]


def encode(docs: DataFrame, codec: Codec, text_col: str = "text", sample_docs: int = 20_000, dictionary_words: int = 200_000) -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>) of each text's tokens."""
    known = Dictionary(warm_words(docs, codec, text_col, sample_docs, dictionary_words))
    words = words_of(F.col(text_col))
    ids = bound(codec.rank_map | known.maps, lambda m: F.flatten(F.transform(words, lambda w: F.coalesce(known.look(m, w), codec.fold(m, w)))))
    return docs.withColumn("ids", ids)


@lru_cache(2)
def ragged_merges(path: str) -> Merges:
    """The rank file as a table for ragged arrays: a pair's rank is the id of the token it makes."""
    tokens = ranks(path)
    ids = {t: i for i, t in enumerate(tokens)}
    pairs = [(ids[t[:k]], ids[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
    table = np.array(pairs, np.int64)
    return Merges(table[:, :2], table[:, 2], np.array([ids[bytes([b])] for b in range(256)]), table[:, 2])


def encode_ragged(data: np.ndarray, at: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, ids of each row): each distinct word's byte array is folded once for all its places."""
    rows = len(at) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(rows, np.int64)
    points, _ = code_points(data, at)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    starts = lead[pre_tokens(points, np.searchsorted(lead, np.unique(at[:-1][np.diff(at) > 0])))]
    lengths = np.diff(starts, append=len(data))
    first, inverse = unique_pieces(data, starts, lengths)
    n = lengths[first]
    pool, kept = merges.merge(merges.byte_ids[data[spread(starts[first], n)]], n)
    where = np.cumsum(kept) - kept
    row = np.searchsorted(at, starts, "right") - 1
    return pool[spread(where[inverse], kept[inverse])], np.bincount(row, kept[inverse], rows).astype(np.int64)


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 (of the ids' own bytes, concatenated)."""
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, tokens = ragged_merges(path), ranks(path)
        blob, size = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens])
        begin = np.cumsum(size) - size
        for batch in slices(batches):
            ids, n = encode_ragged(*ragged(batch.column("text")), merges)
            ends = np.cumsum(n)
            raw = memoryview(ids.astype("<u4").tobytes())
            decoded = memoryview(blob[spread(begin[ids], size[ids])].tobytes())
            cuts = np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], ends])].tolist()
            ends = [0, *ends.tolist()]
            packed = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends, ends[1:])]
            plain = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(packed, pa.string()), pa.array(plain, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def round_trip_native(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """``round_trip`` with Spark's own functions alone."""
    codec = Codec(vocabulary)
    encoded = encode(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), codec, **sizes)
    return encoded.select(
        F.col("id").alias(id_col),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(codec.packed(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2(codec.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )
