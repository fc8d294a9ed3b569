"""Suffix order with common-prefix values by external induced sorting.

A suffix is of type S if it is smaller than the next one, else L; an S suffix after an L suffix is an LMS suffix.

1. The stretches between LMS positions are cut into pieces of a few symbols, which are named in order by an
   external distribution sort. If names repeat, the string of names is sorted by recursion; that gives the
   order of the LMS suffixes and, through the names two of them share, their common prefixes.
2. A scan of the LMS suffixes in order induces the L suffixes, a scan of these in reverse order the S
   suffixes: each suffix met gives the one before it to a priority queue by first symbol. Tuples in a queue
   are (symbol, position, common prefix with the tuple before of the same symbol); the prefix is one more than
   the least one that the scan has met since. The queue is dealt into blocks of symbols and is emptied
   block by block; what a block gives to itself is ordered at once, by doubling along the chains of suffixes.
   A symbol with more suffixes than fit is taken in pieces, first in, first out.

Queues, names and results keep at most about ``memory`` bytes in all; what is beyond lies in unnamed temporary
files of the task, which a lost task does not need again. A block holds ``memory`` / 256 suffixes at most. The text may be
a memory map, which the operating system pages; all else is read and written in order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

ROOM = 1 << 17  # suffixes of a block at most, as many as suit a processor's cache


class Disk:
    """Keeps arrays in memory up to a bound, else in one unnamed temporary file."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file = memory, 0, None
        self.room = int(min(max(memory // 256, 8), ROOM))

    def _at(self, size: int) -> int:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = -(-self.file.seek(0, 2) // 8) * 8
        self.file.truncate(at + size)
        return at

    def put(self, arrays: tuple[np.ndarray, ...]):
        size = sum(a.nbytes for a in arrays)
        if self.held + size <= self.memory:
            self.held += size
            return size, arrays
        at = self._at(size)
        self.file.seek(at)
        for a in arrays:
            self.file.write(np.ascontiguousarray(a).data)
        return at, [(a.dtype, len(a)) for a in arrays]

    def take(self, kept) -> tuple[np.ndarray, ...]:
        """The arrays that ``put`` has kept; they are asked for once."""
        at, what = kept
        if isinstance(what, tuple):
            self.held -= at
            return what
        self.file.seek(at)
        return tuple(np.frombuffer(self.file.read(t.itemsize * n), t) for t, n in what)

    def array(self, n: int, kind) -> np.ndarray:
        """A writable array, in memory only if there is room."""
        size = n * np.dtype(kind).itemsize
        if self.held + size <= self.memory or not n:
            self.held += size
            return np.empty(n, kind)
        at = self._at(size)
        return np.memmap(self.file, kind, "r+", at, (n,))

    def free(self, a: np.ndarray) -> None:
        if not isinstance(a, np.memmap):
            self.held -= a.nbytes


class RangeMin:
    """Least value of any stretch of an array."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of values[first..last], ends included."""
        level = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), self.rows[0].dtype)
        for k in range(int(level.max()) + 1 if len(level) else 0):
            at = np.flatnonzero(level == k)
            if len(at):
                row = self.rows[k]
                out[at] = np.minimum(row[first[at]], row[last[at] - (1 << k) + 1])
        return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` share, compared one by one (callers know all but the last few)."""
    out = np.zeros(len(a), np.int32)
    left, n, k = np.flatnonzero(a != b), len(text), 0
    out[a == b] = n
    while len(left):
        i, j = a[left] + k, b[left] + k
        same = (i < n) & (j < n)
        same &= text[np.minimum(i, n - 1)] == text[np.minimum(j, n - 1)]
        left = left[same]
        k += 1
        out[left] = k
    return out


def _sorted_by(keys: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 on."""
    n, bits = len(keys), max(1, int(len(keys)).bit_length())
    if not n:
        return np.zeros(0, np.int64)
    top = int(keys.max())
    if top < 1 << 16:
        return np.argsort(keys.astype(np.uint16), kind="stable")
    if top.bit_length() + bits < 63:
        return np.sort((keys.astype(np.int64) << bits) | np.arange(n)) & ((1 << bits) - 1)
    return np.argsort(keys, kind="stable")


# --- pieces and their names -------------------------------------------------------------------------------


def _lms(text: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """LMS positions in falling order, stretch by stretch."""
    end, small = len(text) - 1, True  # type of text[end]
    yield np.array([end])
    while end > 0:
        begin = max(0, end - step)
        x = np.asarray(text[begin : end + 1]).astype(np.int64)
        turn = np.sign(np.diff(x))  # 1: S, -1: L, 0: as the next
        known = np.where(turn != 0, np.arange(len(turn)), len(turn))
        known = np.minimum.accumulate(known[::-1])[::-1]
        types = np.append(np.append(turn, 1 if small else -1)[known] > 0, small)  # of begin..end
        found = np.flatnonzero(types[1:] & ~types[:-1]) + 1 + begin
        found = found[found < len(text) - 1]
        if len(found):
            yield found[::-1]
        end, small = begin, bool(types[0])


def _pieces(text: np.ndarray, disk: Disk, wide: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all pieces in text order, whether each starts at an LMS position, key of its symbols)."""
    parts, total, after = [], 0, len(text) - 1
    for lms in _lms(text, max(16, disk.room)):
        gap = np.append(after, lms[:-1]) - lms  # to the next LMS position; 0 for the last symbol
        after = int(lms[-1])
        lms, gap = lms[::-1], gap[::-1]
        many = np.maximum(-(-gap // wide), 1)
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        start = np.repeat(lms, many) + wide * nth
        left = np.repeat(gap, many) - wide * nth  # symbols up to the next LMS position
        key = np.zeros(len(start), np.int64)
        for j in range(wide):  # the last piece also holds the next LMS symbol; its end comes after every symbol
            key = (key << bits) | np.where(j <= left, text[np.minimum(start + j, len(text) - 1)], (1 << bits) - 1)
        parts.append(disk.put((start, nth == 0, (key << 1) | (left < wide))))
        total += len(start)
    out = disk.array(total, np.int64), disk.array(total, bool), disk.array(total, np.int64)
    at = 0
    for kept in reversed(parts):
        for whole, part in zip(out, disk.take(kept)):
            whole[at : at + len(part)] = part
        at += len(part)
    return out


def _named(keys: np.ndarray, disk: Disk) -> tuple[np.ndarray, int]:
    """(dense rank of each key, number of ranks)."""
    n = len(keys)
    names = disk.array(n, np.int32 if n < 1 << 31 else np.int64)
    if n <= 4 * disk.room:
        order = np.argsort(keys)
        held = keys[order]
        rank = np.cumsum(np.append(0, held[1:] != held[:-1]))
        names[order] = rank
        return names, int(rank[-1]) + 1
    room = disk.room
    # deal the keys to ranges; a key that splits two ranges has one of its own
    some = np.sort(np.asarray(keys[:: max(1, n // (64 * (n // room + 1)))]))
    split = np.unique(some[:: max(1, len(some) * room // n // 2)])
    ranges: list[list] = [[] for _ in range(2 * len(split) + 1)]
    for a in range(0, n, room):
        part = np.asarray(keys[a : a + room])
        low = np.searchsorted(split, part, "left")
        _deal(disk, ranges, low + np.searchsorted(split, part, "right"), (part, np.arange(a, a + len(part))))
    many = 0
    back: list[list] = [[] for _ in range(n // room + 1)]
    for i, kept in enumerate(ranges):
        if i % 2:  # one key
            for k in kept:
                _, at = disk.take(k)
                _deal(disk, back, at // room, (at, np.full(len(at), many)))
            many += bool(kept)
        elif kept:
            part, at = (np.concatenate(x) for x in zip(*(disk.take(k) for k in kept)))
            order = np.argsort(part)
            held, at = part[order], at[order]
            rank = many + np.cumsum(np.append(0, held[1:] != held[:-1]))
            many = int(rank[-1]) + 1
            _deal(disk, back, at // room, (at, rank))
    for kept in back:
        for k in kept:
            at, rank = disk.take(k)
            names[at] = rank
    return names, many


def _deal(disk: Disk, to: list[list], where: np.ndarray, arrays: tuple[np.ndarray, ...]) -> None:
    order = _sorted_by(where)
    where = where[order]
    cut = np.flatnonzero(np.diff(where, prepend=-1, append=1 << 62)).tolist()
    arrays = tuple(a[order] for a in arrays)
    for a, b in zip(cut, cut[1:]):
        to[int(where[a])].append(disk.put(tuple(x[a:b] for x in arrays)))


# --- the scans --------------------------------------------------------------------------------------------


def _blocks(text: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(first symbol of each block of symbols, suffixes in each); more than twice ``room`` only where one symbol has more."""
    def cut(low: int, high: int, shift: int) -> list[tuple[int, int]]:
        """Blocks of the symbols low..high, told apart by their bits from ``shift`` on."""
        count = np.zeros(((high - low) >> shift) + 1, np.int64)
        for a in range(0, len(text), 1 << 20):
            x = np.asarray(text[a : a + (1 << 20)]).astype(np.int64) - low
            if low or high < top:
                x = x[(x >= 0) & (x <= high - low)]
            count += np.bincount(x >> shift, minlength=len(count))
        before = np.cumsum(count) - count
        large = count > room
        new = np.append(True, (np.diff(before // room) != 0) | large[1:] | large[:-1])
        first = np.flatnonzero(new)
        out = []
        for k, total in zip(first.tolist(), np.add.reduceat(count, first).tolist()):
            begin = low + (k << shift)
            if total > 2 * room and shift:
                out += cut(begin, min(begin + (1 << shift) - 1, high), max(0, shift - 16))
            elif total:
                out.append((begin, total))
        return out

    top = 0
    for a in range(0, len(text), 1 << 20):
        top = max(top, int(text[a : a + (1 << 20)].max()))
    found = cut(0, top, max(0, top.bit_length() - 16))
    return tuple(np.array(x, np.int64) for x in zip(*found))


class Scan:
    """One scan: in rising order of symbols from LMS to L suffixes (``way`` 1), in falling order from L to S suffixes (-1)."""

    def __init__(self, text: np.ndarray, blocks: tuple[np.ndarray, np.ndarray], top: int, way: int, disk: Disk, seeds: Iterator, emit: Callable, with_seeds: bool):
        self.text, self.top, self.way, self.disk, self.seeds, self.emit, self.with_seeds = text, top, way, disk, seeds, emit, with_seeds
        first, self.sizes = blocks
        if way < 0:  # keys are counted from the greatest symbol
            first, self.sizes = (top - np.append(first[1:], top + 1) + 1)[::-1], self.sizes[::-1]
        self.first = first
        self.queues: list[list] = [[] for _ in first]
        self.waiting = None

    def key(self, positions: np.ndarray) -> np.ndarray:
        k = self.text[positions]
        return k.astype(np.int64) if self.way > 0 else self.top - k.astype(np.int64)

    def seeded(self, high: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, position, prefix) of the next seeds with keys up to ``high``, ``most`` or a few more at a time."""
        got, n = [], 0
        while most is None or n < most:
            if self.waiting is None:
                nxt = next(self.seeds, None)
                if nxt is None:
                    break
                self.waiting = (self.key(nxt[0]), *nxt)
            at = int(np.searchsorted(self.waiting[0], high, "right"))
            if most is not None:
                at = min(at, most - n)
            if at:
                got.append(tuple(x[:at] for x in self.waiting))
                n += at
            left = tuple(x[at:] for x in self.waiting)
            self.waiting = left if len(left[0]) else None
            if self.waiting is not None:
                break
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*got)) if len(got) > 1 else got[0]

    def run(self) -> None:
        for b, low in enumerate(self.first.tolist()):
            high = int(self.first[b + 1]) - 1 if b + 1 < len(self.first) else self.top
            if self.sizes[b] <= 2 * self.disk.room:
                kept, self.queues[b] = self.queues[b], []
                parts = [self.disk.take(k) for k in kept]
                come = tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
                self.block(low, high, come, self.seeded(high))
            else:
                self.stream(b, low, high)

    def push(self, s: np.ndarray, p: np.ndarray, q: np.ndarray, table: RangeMin, since: list | None = None) -> None:
        """Keys, positions and their parents' places in the scan, in order of the scan."""
        by = _sorted_by(s)
        s, p, q = s[by], p[by], q[by]
        shared = np.ones(len(s), np.int32)
        same = np.flatnonzero(s[1:] == s[:-1]) + 1
        shared[same] = 1 + table(q[same - 1] + 1, q[same])
        if since is not None:
            self._carry(s, q, table, shared, since)
        _deal_sorted(self.disk, self.queues, np.searchsorted(self.first, s, "right") - 1, (s, p, shared))

    def _carry(self, s, q, table, shared, since) -> None:
        """Prefixes over the pieces of one symbol; ``since``: keys and the least prefix met since each was last pushed."""
        keys, least = since
        whole, n = int(table.rows[0].min()), len(table.rows[0])
        if not len(s):
            since[1] = np.minimum(least, whole)
            return
        new = np.flatnonzero(np.diff(s, prepend=-1))
        if len(keys) and len(new):
            at = np.minimum(np.searchsorted(keys, s[new]), len(keys) - 1)
            old = keys[at] == s[new]
            begin = new[old]
            shared[begin] = 1 + np.minimum(least[at[old]], table(np.zeros(len(begin), np.int64), q[begin]))
        last = np.append(new[1:], len(s)) - 1
        tail = np.full(len(new), np.iinfo(np.int32).max, np.int32)
        inner = np.flatnonzero(q[last] + 1 < n)
        tail[inner] = table(q[last[inner]] + 1, np.full(len(inner), n - 1))
        rest = ~np.isin(keys, s[new])
        keys, least = np.append(keys[rest], s[new]), np.append(np.minimum(least[rest], whole), tail)
        order = np.argsort(keys)
        since[:] = keys[order], least[order]

    def stream(self, b: int, low: int, high: int) -> None:
        """A symbol of more suffixes than fit: piece by piece, what it gives to itself goes to the end of its queue."""
        since: list = [np.zeros(0, np.int64), np.zeros(0, np.int32)]
        last, fresh, induced = -1, True, True
        while True:
            if induced and self.queues[b]:
                k, p, shared = self.disk.take(self.queues[b].pop(0))
            else:
                k, p, shared = self.seeded(high, self.disk.room)
                if not len(p):
                    break
                if induced and last >= 0:
                    shared = shared.copy()
                    shared[0] = common_prefix(self.text, np.array([last]), p[:1])[0]
                induced = False
            if fresh:
                shared = shared.copy()
                shared[0], fresh = 0, False
            last = int(p[-1])
            before = p - 1
            s = self.key(np.maximum(before, 0))
            go = np.flatnonzero((before >= 0) & (s >= k if induced else s > k))
            self.push(s[go], before[go], go, RangeMin(shared), since)
            if induced or self.with_seeds:
                self.emit(p, shared)

    def block(self, low: int, high: int, come: tuple, seeds: tuple) -> None:
        na, nz = len(come[0]), len(seeds[0])
        if not na + nz:
            return
        keys, places = [come[0], seeds[0]], [come[1], seeds[1]]
        parents, n = [], na + nz
        given: list = []
        k, p, front = np.concatenate(keys), np.concatenate(places), np.arange(n)
        floor = k + (front >= na)  # a seed gives only to greater keys
        while len(front):
            before = p - 1
            s = self.key(np.maximum(before, 0))
            go = (before >= 0) & (s >= floor)
            inside = s <= high
            out = np.flatnonzero(go & ~inside)
            given.append((s[out], before[out], front[out]))
            own = np.flatnonzero(go & inside)
            k, p = s[own], before[own]
            keys.append(k)
            places.append(p)
            parents.append(front[own])
            front = np.arange(n, n + len(own))
            floor = k
            n += len(own)
        key, place = np.concatenate(keys), np.concatenate(places)
        parent = np.concatenate([np.arange(na + nz), *parents])
        kind = np.ones(n, np.int8)
        kind[:na], kind[na : na + nz] = 0, 2
        rank, levels = _ranks(key - low, kind, parent, na + nz)
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        shared = self.prefixes(order, rank, key, kind, place, levels, come[2], seeds[2])
        table = RangeMin(shared)
        s, before, who = (np.concatenate(x) for x in zip(*given))
        q = rank[who]
        at = np.full(n, -1)
        at[q] = np.arange(len(q))
        at = at[at >= 0]
        self.push(s[at], before[at], q[at], table)
        place = place[order]
        if not self.with_seeds and nz:
            pick = kind[order] != 2
            place, shared = place[pick], shared[pick]
        if len(place):
            self.emit(place, shared)

    def prefixes(self, order, rank, key, kind, place, levels, of_come, of_seeds) -> np.ndarray:
        n, na = len(order), len(of_come)
        shared = np.zeros(n, np.int32)
        x, y = order[:-1], order[1:]
        same = np.append(False, key[x] == key[y])
        a, b = np.append(0, kind[x]), np.append(0, kind[y])
        at = np.flatnonzero(same & (a == 0) & (b == 0))
        shared[at] = of_come[order[at]]
        at = np.flatnonzero(same & (a == 2) & (b == 2))
        shared[at] = of_seeds[order[at] - na]
        shared[same & (a == 0) & (b == 1)] = 1
        at = np.flatnonzero(same & (a != 2) & (b == 2))
        shared[at] = common_prefix(self.text, place[order[at - 1]], place[order[at]])
        at = np.flatnonzero(same & (a == 1) & (b == 1))
        if len(at):
            u, v, more = order[at - 1], order[at], np.zeros(len(at), np.int32)
            for j in range(len(levels) - 1, -1, -1):
                ranks, up = levels[j]
                equal = np.flatnonzero(ranks[u] == ranks[v])
                more[equal] += 1 << j
                u[equal], v[equal] = up[u[equal]], up[v[equal]]
            alike = key[u] == key[v]
            more[alike & (kind[u] == 0) & (kind[v] == 1)] += 1
            pick = np.flatnonzero(alike & (kind[u] != 2) & (kind[v] == 2))
            more[pick] += common_prefix(self.text, place[u[pick]], place[v[pick]])
            pick = np.flatnonzero(alike & (kind[u] == kind[v]))  # two that came, or two seeds
            if len(pick):
                more[pick] += RangeMin(shared)(rank[u[pick]] + 1, rank[v[pick]])
            shared[at] = more
        return shared


def _deal_sorted(disk: Disk, to: list[list], where: np.ndarray, arrays: tuple[np.ndarray, ...]) -> None:
    cut = np.flatnonzero(np.diff(where, prepend=-1, append=1 << 62)).tolist()
    for a, b in zip(cut, cut[1:]):
        for c in range(a, b, disk.room):
            to[int(where[a])].append(disk.put(tuple(x[c : min(b, c + disk.room)] for x in arrays)))


def _ranks(key: np.ndarray, kind: np.ndarray, parent: np.ndarray, ends: int) -> tuple[np.ndarray, list]:
    """(place of each suffix of a block in the scan, [(rank by the first 2^j suffixes of its chain, the suffix 2^j further)]).

    The first ``ends`` suffixes end chains: they come in order of their index within key and kind. Others
    come in order of their parents.
    """
    n = len(key)
    bits = max(1, n.bit_length())
    packed = np.sort((((key << 2) | kind) << bits) | np.arange(n))
    order, head = packed & ((1 << bits) - 1), packed >> bits
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    if n == ends:
        return rank, []
    new = np.append(True, head[1:] != head[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    child = np.flatnonzero(kind[order] == 1)  # in order of key
    who = order[child]
    rank[who] = begin[child]
    levels, up = [], parent
    while True:
        levels.append((rank, up))
        old = rank[who]
        by = np.sort((((old << bits) | rank[up[who]]) << bits) | np.arange(len(who)))  # a block's numbers are short
        who = who[by & ((1 << bits) - 1)]
        old, next_ = rank[who], rank[up[who]]
        group = np.append(True, old[1:] != old[:-1])
        fresh = group | np.append(True, next_[1:] != next_[:-1])
        at = np.arange(len(who))
        moved = np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[who] = old + moved
        if fresh.all():
            return rank, levels
        up = up[up]


def _reversed(chunks: list, disk: Disk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The chunks from the last to the first, each entry with the prefix it shares with the one after it (now before it)."""
    held = 0
    for kept in reversed(chunks):
        positions, shared = disk.take(kept)
        yield positions[::-1], np.append(np.int32(held), shared[1:][::-1]).astype(np.int32)
        held = int(shared[0])


def sorted_suffixes(text: np.ndarray, memory: int = 256 << 20, disk: Disk | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffix positions in order, chunk by chunk, each with the symbols it shares with the one before.

    ``text``: whole numbers from 0 on that end with their only 0.
    """
    disk = disk or Disk(memory)
    n = len(text)
    if n < 2:
        yield np.arange(n), np.zeros(n, np.int32)
        return
    blocks = _blocks(text, disk.room)
    top = 0
    for a in range(0, n, 1 << 20):
        top = max(top, int(text[a : a + (1 << 20)].max()))
    found: list = []
    keep = lambda *arrays: found.append(disk.put(arrays))
    Scan(text, blocks, top, 1, disk, _sorted_lms(text, top, disk), keep, False).run()
    larger, found = found, []
    Scan(text, blocks, top, -1, disk, _reversed(larger, disk), keep, True).run()
    yield np.array([n - 1]), np.zeros(1, np.int32)
    first = True
    for positions, shared in _reversed(found, disk):
        if first:
            shared = shared.copy()
            shared[0], first = 0, False
        yield positions, shared


def _sorted_lms(text: np.ndarray, top: int, disk: Disk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """LMS positions in order, each with the symbols its suffix shares with the one before."""
    bits = max(1, (top + 1).bit_length())
    start, lead, keys = _pieces(text, disk, max(2, 62 // bits), bits)
    names, many = _named(keys, disk)
    disk.free(keys)
    del keys
    if many == len(names):
        order = disk.array(many, np.int64)
        for a in range(0, many, 1 << 20):
            order[names[a : a + (1 << 20)]] = np.arange(a, min(many, a + (1 << 20)))
        chunks = ((order[a : a + disk.room], np.zeros(min(disk.room, many - a), np.int32)) for a in range(0, many, disk.room))
    else:
        chunks = sorted_suffixes(names, disk=disk)
    last = -1
    for b, whole in picked(chunks, lambda piece: lead[piece]):
        a = np.append(last if last >= 0 else b[0], b[:-1])
        last = int(b[-1])
        positions = np.asarray(start[b])
        i, j = start[np.minimum(a + whole, len(start) - 1)], start[np.minimum(b + whole, len(start) - 1)]
        prefix = (j - positions + common_prefix(text, i, j)).astype(np.int32)
        prefix[a == b] = 0
        yield positions, prefix
    for a in (start, lead, names):
        disk.free(a)


def picked(chunks: Iterator, choose: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes whose positions ``choose`` marks, each with the symbols it shares with the marked one before (none: 0)."""
    most = np.iinfo(np.int32).max
    least, first = most, True
    for positions, shared in chunks:
        at = np.flatnonzero(choose(positions))
        if not len(at):
            least = min(least, int(shared.min(initial=most)))
            continue
        whole = np.minimum.reduceat(shared[: at[-1] + 1], np.append(0, at[:-1] + 1))
        whole[0] = 0 if first else min(int(whole[0]), least)
        least, first = int(shared[at[-1] + 1 :].min(initial=most)), False
        yield positions[at], whole


class Text:
    """A text of 16-bit symbols put together part by part, on disk beyond ``memory`` bytes."""

    def __init__(self, memory: int):
        self.memory, self.parts, self.size, self.file = memory, [], 0, None

    def add(self, part: np.ndarray) -> None:
        self.parts.append(part.astype(np.int16))
        self.size += len(part)
        if self.file is None and 2 * self.size > self.memory:
            self.file = tempfile.TemporaryFile()
        if self.file is not None:
            for p in self.parts:
                self.file.write(p.data)
            self.parts.clear()

    def whole(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts)
        self.file.flush()
        return np.memmap(self.file, np.int16, "r", 0, (self.size,))


def suffix_order(text: np.ndarray, memory: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """``sorted_suffixes`` as two arrays."""
    return tuple(np.concatenate(x) for x in zip(*sorted_suffixes(text, memory)))
