"""Byte-pair merges over ragged numpy arrays, and the character classes that pre-tokenisers go by."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

from tarnwork.llm.common import spread

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Unicode White_Space (fixed values).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NONE = np.int64(1) << 40


@lru_cache(1)
def classes() -> np.ndarray:
    """Character class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110000, OTHER, np.uint8)
    out[:0x33480] = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x33480)), np.uint8, 0x33480)
    out[WHITE] = SPACE
    return out


def split_contractions(points: np.ndarray, start: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The starts, with 's 't 'm 'd 're 've 'll as pieces of their own; fresh: where texts begin."""
    n = len(points)
    # 's 't 'm 'd 're 've 'll
    quote = np.flatnonzero((points == 39) & start[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~fresh[quote + 1]]
    one = points[quote + 1]
    short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
    two = points[np.minimum(quote + 2, n - 1)]
    long = (quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
    for found, size in ((quote[short], 2), (quote[long & ~short], 3)):
        start[found + 1] = False
        start[found + size] = True
    return np.flatnonzero(start[:n])


class Merges:
    """Ranked merges in an open-addressing table: (left id, right id) -> rank, merged id."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray, byte_ids: np.ndarray, ranks: np.ndarray | None = None):
        self.byte_ids = byte_ids.astype(np.int64)
        ranks = np.arange(len(pairs)) if ranks is None else ranks  # pairs of equal rank make the same token
        self.merged = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.int64)
        self.merged[ranks] = merged
        keys = (pairs[:, 0].astype(np.int64) << 20) | pairs[:, 1]
        self.bits = max(12, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = left[self.keys[slot] < 0]
            place = slot[self.keys[slot] < 0]
            place, who = np.unique(place, return_index=True)
            self.keys[place] = keys[free[who]]
            self.ranks[place] = ranks[free[who]]
            rest = self.keys[slot] != keys[left]
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 20) | b
        slot = self.slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.ranks[slot], NONE)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot]
            hit = seen == keys[left]
            out[left[hit]] = self.ranks[slot[hit]]
            more = ~hit & (seen >= 0)
            left, slot = left[more], slot[more]
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(surviving symbols end to end, how many each sequence keeps); sequences hold one symbol at least.

        Rank-synchronous: each round applies every active sequence's own lowest-rank pair.
        """
        counts, parts = lengths.copy(), []
        who = np.arange(len(lengths))
        rank = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        if len(symbols):
            rank[np.cumsum(lengths) - 1] = NONE
        while len(who):
            lowest = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
            active = lowest < NONE
            if not active.all():
                keep = np.repeat(active, lengths)
                counts[who[~active]] = lengths[~active]
                parts.append((who[~active], symbols[~keep]))
                symbols, rank, who, lengths, lowest = symbols[keep], rank[keep], who[active], lengths[active], lowest[active]
                if not len(who):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, lengths))
            run = np.cumsum(np.diff(at, prepend=-2) != 1) - 1  # of neighbours, as in a a a a: every other place
            if run[-1] + 1 < len(at):
                first = np.flatnonzero(np.diff(run, prepend=-1))
                at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            seq = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            lengths = lengths - np.bincount(seq[at], minlength=len(lengths))
            at = at - np.arange(len(at))
            symbols, rank = symbols[keep], rank[keep]
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(lengths) - 1] = True
            for i in (at, at[at > 0] - 1):
                inner = i[~last[i]]
                rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
                rank[i[last[i]]] = NONE
        out = np.empty(int(counts.sum()), np.int64)
        where = np.cumsum(counts) - counts
        for ids, kept in parts:
            out[spread(where[ids], counts[ids])] = kept
        return out, counts


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(4)
def load(path: str) -> tuple[Merges, tuple[bytes, ...], np.ndarray]:
    """(merges of a byte-level tokenizer file, its special strings, ids of bytes that end a word)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters, end = spec["model"]["vocab"], _byte_letters(), spec["model"].get("end_of_word_suffix") or ""
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
    merged = np.array([vocab[a + b] for a, b in merges], np.int64)
    byte_ids, last_ids = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for letter, b in letters.items():
        byte_ids[b], last_ids[b] = vocab[letter], vocab[letter + end]
    return Merges(pairs, merged, byte_ids), tuple(x["content"].encode() for x in spec["added_tokens"]), last_ids
