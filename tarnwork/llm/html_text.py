"""Main text of web pages by a suffix array over each host, with page structure as a guard.

1. A page's token stream is read once: blocks of text, each with the kind of element that holds it (an article,
   a main element, one that names itself so, or none of these) and whether it is marked as page furniture
   (menu, header, footer, sidebar, notice, advert, form, reader comment).
2. The streams of all pages of a host, furniture included, are concatenated and put into suffix order. Strings
   of at least ``min_words`` tokens on at least ``min_pages`` different pages are boilerplate; what they cover
   goes, unique runs stay. Pages of equal content (article, or all text where none is marked) count as one
   page, whatever furniture is around it. (A string whose hash no other has does not repeat; what only such strings
   cover need not be sorted.)
3. Guards: marked furniture goes although it is unique. An article, or else a main element or one named so,
   is the page's text if it has more words than there are unique words outside of it; its words stay although
   other pages repeat them (a copied article is no boilerplate). Where no element wins, the unique runs of
   the whole page are its text.

Hosts of more than ``SHARD_PAGES`` pages are dealt to shards by page content. Each shard puts its own pages into
suffix order and sends a hash (at least 48 bits, more for large hosts) and the number of pages of every string;
these meet by ranges of hashes, and each shard gets back which of its strings are boilerplate in the
whole host. As equal pages share a shard, the numbers add up exactly, so the size of a shard decides nothing.

Null or empty html gives an empty text; null urls form one host; repeated rows each give a row;
extra columns are ignored; an empty table gives no rows. Nothing is dropped for its length.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import _mix, _words, piece_hashes, release, slices, small_batches, spread, unique_pieces, tidy
from tarnwork.llm.induced_sort import picked, sorted_suffixes

SHARD_PAGES = 2000
#: Hosts meet in so many buckets to be counted; a bucket's hosts share a number of shards.
HOST_BUCKETS = 1 << 20
#: Ranges of hashes for each shard of a host, and for a host at most.
PARTS, MOST_PARTS = 8, 4096
TAG = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"[ \t\n\r\f\v \u0085  -     　]+")
#: Elements whose content is never text.
MUTE = set("script style noscript template svg math iframe object canvas audio video map select textarea button head title".split())
RAW = {"script", "style", "textarea", "title"}
#: Elements that hold page furniture.
FURNITURE = set("nav footer aside form dialog menu".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What ends an open element of its kind, and what holds such elements.
SIBLINGS = {"body": (("head",), ()), "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}
#: What becomes of an element's text: kept, kept as marked furniture, marked within a line, never text.
TEXT, MARKED, SIDE, MUTED = range(4)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are closed by their own end tag and so can hold others.
HOLDERS = (BLOCKS - {"p", "li", "hr", "dd", "dt", "td", "th", "tr", "option", "html", "body", "h1", "h2", "h3", "h4", "h5", "h6"}) | MUTE
#: Words in class, id and role that mark furniture.
MARKS = set("ad ads advert adverts advertisement advertising adsense banner promo sponsor sponsored sidebar menu nav navigation navbar breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices newsletter subscribe popup modal comment comments disqus respond share sharing social related widget login signup search pagination pager complementary contentinfo dialog alert alertdialog masthead topbar toolbar".split())
MAIN_MARKS = set("article articlebody main post story entry".split())


def _marks(attributes: str) -> tuple[set[str], bool]:
    """(words of class, id, role and itemprop, whether the element is hidden)."""
    words: set[str] = set()
    hidden = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role", "itemprop"):
            words.update(re.split(r"[\s_\-:]+", value))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return words, hidden




def blocks_of(page: str) -> list[tuple[int, bool, str]]:
    """(3 in an article, 2 in a main element, 1 in one named so, 0 elsewhere; whether marked as furniture; text) of each block in page order."""
    found: list[tuple[int, bool, str]] = []
    stack: list[tuple[str, int, int]] = []  # (element, level, what becomes of its text)
    level, fate, marked_parts = 0, TEXT, False
    parts: list[str] = []
    side: list[str] = []  # furniture within a line

    def flush() -> None:
        for held, marked in ((parts, marked_parts), (side, True)):
            if held:
                text = SPACE.sub(" ", entities.unescape("".join(held))).strip(" ")
                held.clear()
                if text:
                    found.append((level, marked, text))

    def close(to: int) -> None:
        nonlocal level, fate
        if any(e[0] in BLOCKS and e[2] != MUTED for e in stack[to:]):
            flush()
        del stack[to:]
        level, fate = (stack[-1][1], stack[-1][2]) if stack else (0, TEXT)

    def say(text: str) -> None:
        nonlocal marked_parts
        if fate == SIDE:
            side.append(text)
        elif fate != MUTED:
            parts.append(text)
            marked_parts = fate == MARKED

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, ends, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "br":
            say(" ")
            continue
        if name in BLOCKS and fate != MUTED:
            flush()
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in VOID:
            continue
        if name in BLOCKS:  # what an opening element ends; such elements are here only where marked
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            among, within = SIBLINGS.get(name, ((), ()))
            for i in range(len(stack) - 1, -1, -1) if among else ():
                if stack[i][0] in among:
                    close(i)
                    break
                if stack[i][0] in within:
                    break
        words, hidden = _marks(attributes) if attributes.strip() else (set(), False)
        furniture = hidden or name in FURNITURE or bool(words & MARKS) or level == 0 and (name == "header" or "header" in words)
        if name in HOLDERS or furniture or fate != TEXT and any(e[0] == name for e in stack):
            if name in RAW:
                stop = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                end = page.find(">", stop.start()) if stop else -1
                at = end + 1 if end >= 0 else n
                continue
            if not attributes.rstrip().endswith("/") or name in BLOCKS:
                rank = 3 if name == "article" else 2 if name == "main" or "main" in words else 1 if words & MAIN_MARKS else 0
                if name in MUTE or fate == MUTED:
                    to = MUTED
                elif furniture or fate != TEXT:
                    to = MARKED if name in BLOCKS or fate == MARKED else SIDE
                else:
                    to = TEXT
                stack.append((name, max(level, rank) if name in BLOCKS else level, to))
                level, fate = stack[-1][1], to
    flush()
    return found


def pack(blocks: list[tuple[int, bool, str]]) -> bytes:
    """A page's blocks: a line of one figure for each (twice the level, plus one for furniture), then the texts by lines."""
    kinds = "".join(chr(48 + 2 * level + marked) for level, marked, _ in blocks)
    return "\n".join([kinds, *(t for _, _, t in blocks)]).encode("utf-8", "surrogatepass")


def content_key(blocks: list[tuple[int, bool, str]]) -> int:
    """64-bit hash of the page's content: what its best mark holds if that is the larger part, else all of its text."""
    plain = [(level, t) for level, marked, t in blocks if not marked]
    total, own = sum(len(t) for _, t in plain), [t for _, _, t in blocks]
    for rank in (3, 2, 1):
        inside = [t for level, t in plain if level >= rank]
        if 2 * sum(map(len, inside)) > total:
            own = inside
            break
    return int.from_bytes(hashlib.blake2b("\n".join(own).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Streams:
    """The token streams of packed pages: numbers of their words, 2 before each block, 1 after each page, 0 at the end."""

    def __init__(self, packed: list[bytes], keys: np.ndarray):
        kinds, bodies = [], []
        for raw in packed:
            cut = raw.find(b"\n")
            kinds.append(raw[:cut] if cut >= 0 else raw[:0])
            bodies.append(raw[cut:] if cut >= 0 else raw[:0])
        self.raw = b"".join(bodies)
        data = np.frombuffer(self.raw, np.uint8)
        bytes_end = np.cumsum([len(b) for b in bodies], dtype=np.int64)
        kind = np.frombuffer(b"".join(kinds), np.uint8) - 48
        self.level, self.marked = kind >> 1, (kind & 1).astype(bool)
        line = data == 10
        solid = ~line & (data != 32)
        start = solid & np.append(True, ~solid[:-1]) if len(data) else solid
        at = np.flatnonzero(line | start)
        mark = line[at]
        first, last = at[~mark], np.flatnonzero(solid & np.append(~solid[1:], True)) + 1 if len(data) else at
        page = np.searchsorted(bytes_end, at, "right")
        pages = len(packed)
        self.ends = np.cumsum(np.bincount(page, minlength=pages) + 1)
        self.text = np.ones(int(self.ends[-1]) + 1 if pages else 1, np.int32)
        self.text[-1] = 0
        self.token = np.arange(len(at)) + page  # places of marks and words in the text
        rep, number = unique_pieces(data, first, last - first) if len(first) else (first, first)
        self.text[self.token[mark]] = 2
        self.text[self.token[~mark]] = number + 3
        words = piece_hashes(_words(data), first[rep], (last - first)[rep]) if len(first) else np.zeros(0, np.uint64)
        self.hashes = _mix(np.append(np.arange(3, dtype=np.uint64), words))
        self.mark, self.first, self.last = mark, first, last
        self.block_page = page[mark]
        self.block_at = np.append(at[mark] + 1, len(data) + 1)  # bytes
        self.same = np.unique(keys, return_inverse=True)[1]

    def windows(self, min_words: int) -> np.ndarray:
        """Starts of every ``min_words`` tokens within a page."""
        size = np.diff(self.ends, prepend=0) - 1
        return spread(self.ends - size - 1, np.maximum(size - min_words + 1, 0))

    def strings(self, min_words: int, memory: int = 256 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, number of its string, pages that hold it by string; hashes of all others) of every ``min_words`` tokens that may repeat.

        Equal strings have equal hashes, so a string whose hash stands alone does not repeat. Only what the others
        cover is put into suffix order, which tells them apart.
        """
        start = self.windows(min_words)
        h = self.string_hashes(start, min_words)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        often = np.zeros(len(h), bool)
        often[order[1:][same]] = often[order[:-1][same]] = True
        own, alone = start[often], h[~often]
        if not len(own):
            return own, own, own, alone
        step = np.zeros(len(self.text) + 1, np.int32)
        step[own] += 1
        step[own + min_words] -= 1
        at = np.flatnonzero(np.cumsum(step) > 0)
        place = np.arange(len(at)) + np.cumsum(np.diff(at, prepend=at[0] - 1) > 1)  # a 1 parts stretches
        text = np.ones(int(place[-1]) + 3, np.int32)
        text[place], text[-1] = self.text[at], 0
        back = np.full(len(text), -1)
        back[place] = at
        wanted = np.zeros(len(self.text) + 1, bool)
        wanted[own] = True  # the last one, which -1 means, is no start
        start, shared = (np.concatenate(x) for x in zip(*picked(sorted_suffixes(text, memory), lambda positions: wanted[back[positions]])))
        start = back[start]
        number = np.cumsum(shared < min_words) - 1
        number -= number[0]
        page = self.same[np.searchsorted(self.ends, start, "right")]
        pairs = np.unique(number * len(self.ends) + page)
        return start, number, np.bincount(pairs // len(self.ends)), alone

    def string_hashes(self, start: np.ndarray, min_words: int) -> np.ndarray:
        """64-bit hash of the ``min_words`` tokens from each ``start`` on, the same in every shard."""
        h = np.zeros(len(start), np.uint64)
        for k in range(min_words):
            h = _mix(h ^ self.hashes[self.text[start + k]])
        return h

    def covered(self, start: np.ndarray, min_words: int) -> np.ndarray:
        """Which tokens the strings from each ``start`` on cover."""
        gone = np.zeros(len(self.text), bool)
        # what reaches into a next block counts for whole blocks only: an article's ends are not a footer's
        edge = self.text <= 2
        before = np.maximum.accumulate(np.where(edge, np.arange(len(edge)), 0))
        last, across = before[start + min_words], before[start + min_words - 1] > start
        fine = ~across | edge[start]
        gone[spread(start[fine], np.where(across, last - start, min_words)[fine])] = True
        return gone

    def texts(self, gone: np.ndarray) -> list[bytes]:
        """The text of each page, where ``gone`` tokens are boilerplate."""
        pages, blocks = len(self.ends), len(self.level)
        word_block = (np.cumsum(self.mark) - 1)[~self.mark]
        left = ~gone[self.token[~self.mark]]
        whole = np.bincount(word_block, minlength=blocks)
        unique = np.bincount(word_block, left, blocks)
        rank = np.zeros(pages, np.int8)
        for r in (1, 2, 3):
            inside = ~self.marked & (self.level >= r)
            outside = ~self.marked & ~inside
            won = np.bincount(self.block_page, whole * inside, pages) > np.bincount(self.block_page, unique * outside, pages)
            rank[won] = r
        kept = ~self.marked & (self.level >= rank[self.block_page])
        closed = rank[self.block_page] > 0
        bounds = np.append(0, np.cumsum(whole))
        out: list[list[bytes]] = [[] for _ in range(pages)]
        for b in np.flatnonzero(kept & (closed | (unique > 0))).tolist():
            if closed[b] or unique[b] == whole[b]:
                out[self.block_page[b]].append(self.raw[self.block_at[b] : self.block_at[b + 1] - 1])
            else:
                own = np.flatnonzero(left[bounds[b] : bounds[b + 1]]) + bounds[b]
                out[self.block_page[b]].append(b" ".join(self.raw[i:j] for i, j in zip(self.first[own].tolist(), self.last[own].tolist())))
        return [b"\n".join(x) for x in out]


def unique_runs(pages: list[str], min_words: int = 6, min_pages: int = 3) -> list[str]:
    """The texts of pages (html) of one host."""
    blocks = [blocks_of(p) for p in pages]
    streams = Streams([pack(b) for b in blocks], np.array([content_key(b) for b in blocks], np.int64))
    start, number, many, _ = streams.strings(min_words)
    return [t.decode("utf-8", "surrogatepass") for t in streams.texts(streams.covered(start[many[number] >= min_pages], min_words))]


def extract(pages: DataFrame, min_words: int = 6, min_pages: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (blocks joined by newlines), n_chars."""
    if min_pages < 2:
        raise ValueError("what one page holds is no boilerplate")
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    source = source.withColumn("bucket", F.pmod(F.xxhash64("host"), F.lit(HOST_BUCKETS)).cast("int"))
    kind = source.schema["id"].dataType.simpleString()
    # a few bytes for each of HOST_BUCKETS buckets at most, whatever the table holds
    large = source.groupBy("bucket").count().where(F.col("count") > SHARD_PAGES).select("bucket", F.ceil(F.col("count") / SHARD_PAGES).cast("int").alias("shards"))
    source = source.join(F.broadcast(large), "bucket", "left").drop("bucket")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "html"):
            blocks = [blocks_of(h or "") for h in batch.column("html").to_pylist()]
            keys = np.array([content_key(b) for b in blocks], np.int64)
            shards = batch.column("shards").fill_null(1).to_numpy().astype(np.int64)
            packed = pa.array([press.compress(pack(b)) for b in blocks], pa.binary())
            columns = [batch.column("host"), pa.array((keys % shards).astype(np.int32)), pa.array(shards.astype(np.int32)), batch.column("id"), batch.column("url"), pa.array(keys), packed]
            yield pa.RecordBatch.from_arrays(columns, ["host", "shard", "shards", "id", "url", "key", "packed"])

    form = f"host string, shard int, shards int, id {kind}, url string, key bigint, packed binary"

    def streams(group: pa.Table) -> Streams:
        if group.num_rows > SHARD_PAGES // 4:
            release()  # what the group before has left
        open_ = zstandard.ZstdDecompressor()
        return Streams([open_.decompress(x.as_py()) for x in group.column("packed")], group.column("key").to_numpy())

    def written(group: pa.Table, texts: list[bytes]) -> pa.Table:
        return pa.table({"id": group.column("id"), "url": group.column("url"), "text": pa.array(texts, pa.binary()).cast(pa.string())})

    def whole(group: pa.Table) -> pa.Table:
        own = streams(group)
        start, number, many, _ = own.strings(min_words)
        return written(group, own.texts(own.covered(start[many[number] >= min_pages], min_words)))

    def sent(group: pa.Table) -> pa.Table:
        """Hashes (48 bits, besides the range) and pages of a shard's strings, by range of hashes."""
        own = streams(group)
        start, number, many, alone = own.strings(min_words)
        first = np.flatnonzero(np.diff(number, prepend=-1))
        h = np.append(own.string_hashes(start[first], min_words), alone)
        many = np.append(many, np.ones(len(alone), np.int64))
        parts = min(MOST_PARTS, PARTS * group.column("shards")[0].as_py())
        part = (h & np.uint64(0xFFFF)).astype(np.int64) % parts
        order = np.lexsort((h, part))
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        values, counts = h[order] >> np.uint64(16), np.minimum(many[order], min_pages)
        rows = [(p, _rising(values[a:b]), _pressed(counts[a:b].astype("<u4"))) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        keys = {c: pa.repeat(group.column(c)[0], len(rows)) for c in ("host", "shard")}
        return pa.table(keys | {"part": pa.array([r[0] for r in rows], pa.int32()), "strings": pa.array([r[1] for r in rows], pa.binary()), "pages": pa.array([r[2] for r in rows], pa.binary())})

    def met(group: pa.Table) -> pa.Table:
        own = [_risen(x.as_py()) for x in group.column("strings")]
        _, number = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(number, np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), "<u4") for x in group.column("pages")]))
        often = (total >= min_pages)[number]
        cut = np.cumsum([0, *map(len, own)])
        kept = [_rising(x[often[a:b]]) for x, a, b in zip(own, cut, cut[1:])]
        return pa.table({c: group.column(c) for c in ("host", "shard", "part")} | {"strings": pa.array(kept, pa.binary())})

    def apart(group: pa.Table, gone: pa.Table) -> pa.Table:
        own = streams(group)
        start = own.windows(min_words)
        h = own.string_hashes(start, min_words)
        parts = min(MOST_PARTS, PARTS * group.column("shards")[0].as_py())
        mine = (h & ~np.uint64(0xFFFF)) | ((h & np.uint64(0xFFFF)) % np.uint64(parts))
        known = [(_risen(x.as_py()) << np.uint64(16)) | np.uint64(p.as_py()) for x, p in zip(gone.column("strings"), gone.column("part"))]
        hit = np.isin(mine, np.concatenate(known)) if known else np.zeros(len(mine), bool)
        return written(group, own.texts(own.covered(start[hit], min_words)))

    kept = f"id {kind}, url string, text string"
    small = source.where("shards IS NULL").mapInArrow(tidy(read), form).groupBy("host").applyInArrow(whole, kept)
    keys = ["host", "shard"]
    split = source.where("shards IS NOT NULL").mapInArrow(tidy(read), form)
    strings = split.groupBy(*keys).applyInArrow(sent, "host string, shard int, part int, strings binary, pages binary")
    boilerplate = strings.groupBy("host", "part").applyInArrow(met, "host string, shard int, part int, strings binary")
    done = small.unionByName(split.groupBy(*keys).cogroup(boilerplate.groupBy(*keys)).applyInArrow(apart, kept))
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))


def _pressed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _rising(values: np.ndarray) -> bytes:
    """Rising numbers of 48 bits: their steps, byte by byte, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return _pressed(np.ascontiguousarray(steps[:, :6].T))


def _risen(raw: bytes) -> np.ndarray:
    """The numbers that ``_rising`` has packed."""
    data = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(6, -1)
    steps = np.zeros((data.shape[1], 8), np.uint8)
    steps[:, :6] = data.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)
