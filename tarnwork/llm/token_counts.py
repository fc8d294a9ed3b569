"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

Each Arrow batch is cut into pre-tokens with vectorised character-class rules, equal pre-tokens are
met once, and all distinct pre-tokens are merged together: in every round each still active sequence
applies its lowest-rank pair (all non-overlapping places at once), until no pair is left. A text's
count is the number of surviving symbols. No row leaves its partition: the plan has no shuffle.

Null or empty texts have 0 tokens; texts of any length are counted whole; repeated rows each give
their own row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import code_points, ragged, slices, small_batches, spread, unique_pieces, tidy
from tarnwork.llm.ragged_bpe import SPACE, Merges, classes, load, split_contractions

def pre_tokens(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens: contractions, words, numbers and signs with a leading space, white space.

    ``points`` holds texts end to end and ``begins`` where each one starts.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    fresh = np.zeros(n + 1, bool)
    fresh[begins] = True
    fresh[n] = True
    kind = classes()[points]
    start = fresh.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # the last white space before something else: a blank joins it, another one stands alone
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~fresh[1:n]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    return split_contractions(points, start, fresh)


def _special_spans(data: np.ndarray, at: np.ndarray, specials: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """Spans of special strings, leftmost first, within rows."""
    whole, spans = data.tobytes(), []
    for s in specials:
        i = whole.find(s)
        while i >= 0:
            row = np.searchsorted(at, i, "right") - 1
            inside = i + len(s) <= at[row + 1]
            if inside:
                spans.append((i, i + len(s)))
            i = whole.find(s, i + len(s) if inside else i + 1)
    out = []
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def count_ragged(data: np.ndarray, at: np.ndarray, merges: Merges, specials: tuple[bytes, ...]) -> np.ndarray:
    """Tokens of each row of ragged UTF-8 bytes."""
    out = np.zeros(len(at) - 1, np.int64)
    if not len(data):
        return out
    points, _ = code_points(data, at)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte offset of each code point
    spans = np.array(_special_spans(data, at, specials), np.int64).reshape(-1, 2)
    begins = np.concatenate([at[:-1][np.diff(at) > 0], spans.ravel()])
    begins = np.unique(begins[begins < len(data)])
    starts = lead[pre_tokens(points, np.searchsorted(lead, begins))]
    lengths = np.diff(starts, append=len(data))
    row = np.searchsorted(at, starts, "right") - 1
    if len(spans):  # a special string is one token whatever it holds
        inner = np.searchsorted(spans[:, 0], starts, "right") - 1
        special = (inner >= 0) & (starts < spans[np.maximum(inner, 0), 1])
        out += np.bincount(np.searchsorted(at, spans[:, 0], "right") - 1, minlength=len(out))
        starts, lengths, row = starts[~special], lengths[~special], row[~special]
        if not len(starts):
            return out
    first, inverse = unique_pieces(data, starts, lengths)
    s, n = starts[first], lengths[first]
    known = merges.merge(merges.byte_ids[data[spread(s, n)]], n)[1]
    return out + np.bincount(row, known[inverse], len(out)).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``vocabulary`` is a file of ``public_tokenizers`` or a path that executors can open.
    """
    small_batches(docs.sparkSession)
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, specials, _ = load(path)
        for batch in slices(batches):
            data, at = ragged(batch.column("text"))
            n = count_ragged(data, at, merges, specials)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
