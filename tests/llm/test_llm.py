"""The ten operators and the pipeline against brute force, exact round trips and held-out accuracy, with edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.llm import byte_bpe, hamming_topk, html_text, language_id, packing, quality_crf, rp_forest, suffix_dedup, token_counts, weighted_minhash
from tarnwork.llm.common import ragged, unique_pieces
from tarnwork.llm.induced_sort import Disk, sorted_suffixes, suffix_order

SF = "/root/testdata/sf0.001"
EDGES = ["", None, " ", "\n\n", "don't y'alls 's's ''s x's 'd  'll\n\n 're", "<|endoftext|>a <|endoftext|> B", "é É 中文12３ x😀", "a" * 999, "---" * 400, "a b\tc\r\nd", "ΑΣ ΟΔΟΣ é", "one two", "one two"]
DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("score", T.StringType()), ("id", T.StringType()))])


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Empty, null, odd and repeated texts, with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, t, None, None, "x", "y") for k, t in enumerate(EDGES)] + [(0, "", None, None, "x", "y")], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_unique_pieces_is_exact():
    rng = random.Random(0)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 24))) for _ in range(500)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    n = np.array([len(w) for w in words])
    rep, place = unique_pieces(data, np.cumsum(n) - n, n)
    assert [words[rep[p]] for p in place] == words and len(rep) == len(set(words))


def test_token_counts(edge_docs, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (edge_docs, docs):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for k, r in rows(token_counts.token_counts(df)).items():
            n = len(t.encode(texts[k], add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[k].encode()), n > 1024), texts[k][:40]
    assert token_counts.token_counts(edge_docs.limit(0)).count() == 0


def encoder():
    import tiktoken

    tokens = byte_bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_byte_bpe(edge_docs, docs):
    own = encoder()
    for df in (edge_docs, docs):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for k, r in rows(byte_bpe.round_trip(df)).items():
            ids = own.encode_ordinary(texts[k])
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(texts[k].encode()).hexdigest()


def test_byte_bpe_native_form(edge_docs):
    few = edge_docs.where("doc_id IN (0, 1, 4, 6, 11)")
    assert sorted(map(tuple, byte_bpe.round_trip_native(few, dictionary_words=3).collect())) == sorted(map(tuple, byte_bpe.round_trip(few).collect()))


def test_packing(edge_docs, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for df, capacity in ((edge_docs.dropDuplicates(["doc_id"]), 64), (docs, 2048)):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        got = packing.pack_documents(df, capacity=capacity).collect()
        by_doc, by_bin = {}, {}
        for r in got:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_bin.setdefault(r["sequence_id"], []).append(r)
        assert set(by_doc) == set(texts)
        for k, own in by_doc.items():
            ids = t.encode(texts[k], add_special_tokens=False).ids + [0]
            own.sort(key=lambda r: r["piece"])
            assert [r["start"] for r in own] == list(range(0, len(ids), capacity))
            for r in own:
                part = ids[r["start"] : r["start"] + capacity]
                assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        for own in by_bin.values():
            own.sort(key=lambda r: r["offset"])
            assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
            assert sum(r["length"] for r in own) <= capacity
        assert len(by_bin) <= -(-sum(r["length"] for r in got) // capacity) * 1.05 + 1
    assert packing.pack_documents(edge_docs.limit(0)).count() == 0


def test_plan_places_every_piece():
    rng = random.Random(5)
    for _ in range(60):
        counts = Counter({rng.randrange(1, 61): rng.randrange(1, 9) for _ in range(rng.randrange(0, 30))})
        placed, used = Counter(), {}
        for n, _, many, first, at in packing.plan(dict(counts), 60):
            placed[n] += many
            for k in range(many):
                used.setdefault(first + k, []).append((at, n))
        assert placed == counts
        for own in used.values():
            end = 0
            for at, n in sorted(own):
                assert at == end
                end += n
            assert end <= 60 and sum(3 * n > 60 for _, n in own) <= 2


def test_language_id(edge_docs, docs):
    model = language_id.fit(docs, train_docs=60)
    got = rows(language_id.identify(docs, model))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [k for k, r in got.items() if r["held_out"]]
    assert held and all((zlib.crc32(str(k).encode()) % 3 == 1) == r["held_out"] for k, r in got.items())
    assert np.mean([got[k]["lang_pred"] == truth[k] for k in held]) > 0.93
    odd = rows(language_id.identify(edge_docs, model))
    assert [odd[k]["lang_pred"] for k in (0, 1, 2, 3, 8)] == ["und"] * 5 and odd[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in [*got.values(), *odd.values()])
    assert language_id.fit(edge_docs) is None
    assert {r["lang_pred"] for r in rows(language_id.identify(edge_docs, None)).values()} == {"und"}


def test_kneser_ney_sums_to_one():
    model = language_id.train(["abab cab abc", "xyz zyx"], ["p", "q"])
    codes, offsets, _ = language_id.letters_of(*ragged(pa.array(["abab cab abc"])))
    loss, n = model.losses(codes, offsets)
    assert loss[0, 0] < loss[0, 1] and n[0] == len(codes) - 3
    alphabet = [ord(c) for c in "abcxyz "]
    contexts = np.array([[32, 97, 98]], np.uint16)
    total = 0.0
    for c in alphabet:
        one = np.append(contexts[0], np.uint16(c))
        total += np.exp(-model.losses(one, np.array([0, 4]))[0][0, 0])
    assert 0.8 < total <= 1.01  # the rest is for characters not seen


def test_quality(edge_docs, docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = quality_crf.fit(more, labels)
    got = rows(quality_crf.score(more, field))
    held = [(r["doc_id"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([got[k]["predicted"] == y for k, y in held]) > 0.95
    odd = rows(quality_crf.score(edge_docs, field))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in odd.values())
    assert quality_crf.fit(docs, labels.where("quality = 1")).prior == 1
    kept = quality_crf.keep(edge_docs, field)
    assert kept.columns == edge_docs.columns


def test_chain_against_enumeration():
    rng = np.random.default_rng(1)
    u, t = rng.normal(size=6), rng.normal(size=(2, 2))
    sizes = np.array([4, 2])
    forward, backward, _ = quality_crf.chain(u, sizes, t)
    at = 0
    for n in sizes:
        weights = {}
        for code in range(1 << n):
            y = [(code >> k) & 1 for k in range(n)]
            weights[tuple(y)] = np.exp(sum(u[at + k] * y[k] for k in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])))
        for k in range(n):
            want = sum(v for y, v in weights.items() if y[k]) / sum(weights.values())
            assert 1 / (1 + np.exp(-(forward[at + k] + backward[at + k]))) == pytest.approx(want)
        at += n


def brute_repeats(texts, width):
    seen, out = set(), {}
    for k, text in sorted(texts.items()):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[k] = (len(raw), sum(gone), sum(1 for i, g in enumerate(gone) if g and not gone[i - 1 : i] == b"\1"), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, edge_docs):
    rng = random.Random(2)
    passage = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(90, 260))) for _ in range(6)]
    texts = {k: "".join(rng.choice([*passage, "é" * rng.randrange(3), str(rng.random())]) for _ in range(6)) for k in range(60)}
    texts |= {100: texts[3], 101: "ab" * 200, 102: None, 103: "short"}
    df = spark.createDataFrame([(k, t, "c") for k, t in texts.items()], "doc_id bigint, text string, spans string").repartition(7)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(df).collect()}
    assert got == brute_repeats(texts, 100)
    assert suffix_dedup.digest(edge_docs).count() == len(EDGES) + 1
    assert suffix_dedup.digest(df.limit(0)).count() == 0


def test_suffix_dedup_keeps_the_last_group_whole(spark):
    """The last window in suffix order repeats, and the end of a segment comes after it."""
    rng = random.Random(7)

    def letters(n):
        return "".join(rng.choice("abcdefgh") for _ in range(n))

    passage = "~" + letters(59) + "~~~" + letters(37)
    texts = {k: letters(50) + passage + letters(20) for k in range(2)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(df).collect()} == brute_repeats(texts, 100)


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    """A phrase with different text around it in every document, and some repeats: no shard gets all of it."""
    rng = random.Random(11)
    phrase = "".join(rng.choice("abcdefgh") for _ in range(80))
    around = ["".join(rng.choice("mnopqrst") for _ in range(120)) for _ in range(150)]
    texts = {k: f"{around[k]}{phrase}{around[-k - 1]}" for k in range(150)}
    texts |= {200 + k: f"{around[k][-rng.randrange(15, 40):]}{phrase}{around[-k - 1][: rng.randrange(15, 40)]}" for k in range(0, 150, 5)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute_repeats(texts, 100)
    sorted_bytes, real = [], suffix_dedup.staged

    def watched(df, name):
        df = real(df, name)
        if name == "met":
            sorted_bytes.append(df.where(F.col("kind") == suffix_dedup.WANTED).groupBy("anchor").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0)
        return df

    monkeypatch.setattr(suffix_dedup, "staged", watched)
    for least, sample in ((4096, 64), (8, 1)):
        monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", least, raising=False)
        monkeypatch.setattr(suffix_dedup, "SAMPLE", sample, raising=False)
        assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(df).collect()} == want
    assert sorted_bytes[1] < sorted_bytes[0] / 10


def test_induced_sort():
    rng = np.random.default_rng(1)
    for k in range(90):
        text = rng.integers(1, [2, 3, 6, 400, 100_000][k % 5] + 1, rng.integers(0, 90))
        if k % 3 == 0:
            text = np.tile(text, 3)
        if k % 7 == 0:
            text = np.concatenate([text, np.full(40, 2), text])
        if k % 11 == 0:
            text = np.sort(text)[::-1]
        text = np.append(text, 0).astype(np.int32)
        raw = text.tolist()
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        shared = [0] + [next(j for j in range(len(raw)) if raw[a + j] != raw[b + j]) for a, b in zip(want, want[1:])]
        for memory in (1 << 24, 6000, 64):  # in memory, with small blocks, and with queues, names and results on disk
            order, prefix = suffix_order(text, memory)
            assert order.tolist() == want and prefix.tolist() == shared, (memory, raw)


def test_induced_sort_keeps_to_its_memory():
    """A text many times the memory of the sort: little is held in memory at once, the rest goes to disk."""
    rng = np.random.default_rng(2)
    text = np.append(np.tile(rng.integers(1, 200, 30_000), 4), 0).astype(np.int16)
    disk, most = Disk(1 << 16), 0
    positions = []
    for p, _ in sorted_suffixes(text, disk=disk):
        most = max(most, disk.held)
        positions.append(p)
    order = np.concatenate(positions)
    assert most <= 1 << 16 and disk.file is not None and (np.sort(order) == np.arange(len(text))).all()
    rank = np.empty(len(text), np.int64)
    rank[order] = np.arange(len(text))
    a, b = order[:-1], order[1:]  # in order: a smaller symbol, or the same one and what follows is smaller
    assert ((text[a] < text[b]) | (text[a] == text[b]) & (rank[np.minimum(a + 1, len(text) - 1)] < rank[np.minimum(b + 1, len(text) - 1)])).all()


def test_suffix_dedup_of_a_shard_beyond_memory(spark, monkeypatch):
    """One shard of many times the memory of its sort, through the whole operator."""
    monkeypatch.setattr(suffix_dedup, "SORT_MEMORY", 1 << 14)
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", 1 << 30)
    rng = random.Random(3)
    phrase = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(3)]
    texts = {k: "".join(x for _ in range(6) for x in (rng.choice(phrase), "".join(rng.choice("xyz") for _ in range(rng.randrange(30, 60))))) for k in range(250)}
    texts |= {300 + k: texts[k][40:400] for k in range(0, 60, 3)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(df).collect()} == brute_repeats(texts, 100)


def test_suffix_dedup_of_anchors_over_many_batches(spark):
    rng = random.Random(14)
    phrase = "".join(rng.choice("abcdefgh") for _ in range(70))
    texts = {k: "".join(rng.choice("xyz") for _ in range(rng.choice([20, 40]))) + phrase + "".join(rng.choice("xyz") for _ in range(60)) for k in range(40)}
    texts |= {100 + k: texts[k % 5] for k in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    for rows_ in ("2", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_)
        assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(df).collect()} == brute_repeats(texts, 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


@pytest.mark.parametrize("width", [40, 100, 300])
def test_suffix_dedup_of_other_widths(spark, width):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(700))
    texts = {k: passage[rng.randrange(300) : rng.randrange(350, 700)] + "".join(rng.choice("xyz ") for _ in range(50)) + passage[: rng.randrange(500)] for k in range(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(df, width).collect()} == brute_repeats(texts, width)


def test_suffix_dedup_of_shared_and_null_ids(spark):
    """Texts that share an id are documents of their own, rows of one id and text are one, a null id loses nothing."""
    rng = random.Random(12)
    twice = "".join(rng.choice("abcdefgh") for _ in range(150))
    df = spark.createDataFrame([(1, "b" * 150), (1, twice), (1, twice), (2, twice), (None, twice), (None, None), (3, None), (3, "")], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digest(df).collect())
    assert got == sorted([("1", 150, 149), ("1", 150, 0), ("1", 150, 0), ("2", 150, 150), ("None", 150, 0), ("None", 0, 0), ("3", 0, 0), ("3", 0, 0)])


def brute_classes(texts, threshold=0.8, rarest=1000):
    """Classes by all pairs, from words and exact document frequencies; nothing of the operator is used."""
    ids = sorted(texts)
    words = [re.findall(r"[^\W_]+", (texts[i] or "").lower()) for i in ids]
    bags = [Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))) for w in words]
    df = Counter(s for b in bags for s in b)
    weight = {s: 1 + np.log(len(ids) / max(n, len(ids) / rarest)) for s, n in df.items()}
    bags = [{s: c * weight[s] for s, c in b.items()} for b in bags]
    total = [sum(b.values()) for b in bags]
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, b in enumerate(bags):
        for s in b:
            where.setdefault(s, []).append(i)
    for i in range(len(ids)):
        for j in {j for s in bags[i] for j in where[s] if j < i} | {j for j in range(i) if not words[i] and not words[j]}:
            low = sum(min(v, bags[j].get(s, 0)) for s, v in bags[i].items())
            if words[i] == words[j] or low >= threshold * (total[i] + total[j] - low):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {k: ids[find(i)] for i, k in enumerate(ids)}


def test_near_duplicates(spark, docs, edge_docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_duplicates(docs).collect()} == brute_classes(texts)
    odd = rows(weighted_minhash.near_duplicates(edge_docs))
    assert odd[12]["class_id"] == 11 and odd[1]["class_id"] == 0 and odd[5]["class_id"] == 5
    assert weighted_minhash.near_duplicates(edge_docs.limit(0)).count() == 0


@pytest.mark.parametrize("deepest", [4, 0])
def test_near_duplicates_in_blocks(spark, monkeypatch, deepest):
    """Buckets of many blocks, dealt anew or met block by block: near copies, and unlike texts that share a passage."""
    monkeypatch.setattr(weighted_minhash, "BLOCK", 12)
    monkeypatch.setattr(weighted_minhash, "DEEPEST", deepest)
    rng = random.Random(4)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    texts = {}
    for k in range(40):
        words = list(base)
        for _ in range(k % 5):
            words[rng.randrange(120)] = f"n{rng.randrange(10**9)}"
        texts[k] = " ".join(words)
    for k in range(60):
        texts[100 + k] = " ".join(base[:80] + [f"m{rng.randrange(10**9)}" for _ in range(40)])
        if k % 6 == 0:
            texts[200 + k] = texts[100 + k] + " end"
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_duplicates(df).collect()} == brute_classes(texts)


def test_weights_are_exact_at_any_size(spark, monkeypatch):
    """Document frequencies above one in RAREST are exact although counters are shared and tasks hand over early."""
    monkeypatch.setattr(weighted_minhash, "RAREST", 20)
    monkeypatch.setattr(weighted_minhash, "HELD", 50)
    rng = random.Random(3)
    texts = [" ".join([f"c{k}" for k in range(5)] * (i % 3 == 0) + [f"d{i % 40}"] * 5 + [f"r{rng.randrange(10**6)}" for _ in range(30)]) for i in range(300)]
    w = weighted_minhash.weights(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    h = lambda t: weighted_minhash.shingles(*ragged(pa.array([t])))[0]
    assert w(h("c0 c1 c2 c3 c4"))[0] == pytest.approx(1 + np.log(3)) and w(h("d7 d7 d7 d7 d7"))[0] == pytest.approx(1 + np.log(20))
    assert (w(h(texts[1].split(" ", 9)[-1])) == 1 + np.log(20)).all() and len(w.hashes) < 40


def test_near_duplicates_of_null_ids(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "A, b c d e f!"), (4, "a b c d e f"), (None, "x y z"), (7, long), (8, long + " end")], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in weighted_minhash.near_duplicates(df).collect())
    assert got == sorted([("None", "4"), ("None", "4"), ("4", "4"), ("None", "None"), ("7", "7"), ("8", "7")])


def vectors(spark, n=300, dims=32, odd=True):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[50:80] = x[50]
    data = [(k, [float(v) for v in x[k]], 1) for k in range(n)]
    if odd:
        data += [(900, None, 1), (901, [0.0] * dims, 1), (902, [None] * dims, 1), (950, [float("nan")] * dims, 1)]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<float>, query_id int"), x.astype(float)


def test_rp_forest(spark):
    df, x = vectors(spark)
    got = {}
    for r in rp_forest.search(df, every=50, k=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q, own in got.items():
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        hits += len({v for v, _ in own.values()} & set(want.tolist()))
        assert sorted(own) == [1, 2, 3, 4, 5] and all(v == pytest.approx(s[i]) for i, v in own.values())
    assert set(got) == {0, 50, 100, 150, 200, 250} and hits >= 27
    assert [got[50][k][0] for k in range(1, 6)] == [51, 52, 53, 54, 55]
    assert rp_forest.search(df.limit(0)).count() == 0
    assert rp_forest.search(df.where("vec_id < 3"), every=1).count() == 6


def test_hamming_topk(spark):
    df, x = vectors(spark, odd=False)
    bits = x > 0
    got = {}
    for r in hamming_topk.search(df, every=100, k=4, segment_bits=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
    for q in (0, 100, 200):
        d = (bits != bits[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:4]
        assert sorted(got[q]) == [(k + 1, i, d[i]) for k, i in enumerate(want)]
    assert hamming_topk.search(df.limit(0)).count() == 0
    assert hamming_topk.search(df.where("vec_id IN (0, 7)"), every=100).count() == 1


def rows_made(spark, since):
    """(lookups, pairs let through by a join) of the statements after ``since``, and the last statement."""
    store, made, last = spark._jsparkSession.sharedState().statusStore(), Counter(), since
    statements = store.executionsList()
    for i in (statements.apply(k).executionId() for k in range(statements.size())):
        last = max(last, i)
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())) if i > since else ():
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    kind = "lookups" if re.match(r"Generate explode\(\[\d", node.desc()) else node.name()
                    made[kind] += int(values.apply(m.accumulatorId()).replace(",", ""))
    return made["lookups"], made["SortMergeJoin"], last


@pytest.mark.parametrize("hot", [False, True])
def test_hamming_makes_few_rows(spark, hot):
    """Neither far neighbours nor a value that all rows share multiply the rows that a search makes."""
    n, k = 12_000, 10
    x = np.random.default_rng(3).normal(size=(n, 61)).astype(np.float32)
    x[:, :16] = np.abs(x[:, :16]) if hot else x[:, :16]
    bits = x > 0
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)}))
    before = rows_made(spark, -1)[2]
    got = {}
    for r in hamming_topk.search(df, every=100, k=k).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["distance"])
    for q in range(0, n, 100):
        d = (bits != bits[q]).sum(axis=1)
        d[q] = 99
        assert [got[q][i + 1] for i in range(k)] == [(i, d[i]) for i in np.lexsort((np.arange(n), d))[:k]]
    lookups, pairs, _ = rows_made(spark, before)
    assert 0 < lookups <= 10 * n and 0 < pairs <= 10 * n


def test_repeated_rows_leave_room_for_k(spark):
    """Rows that repeat a query's id, or an id of a shared vector, take no place of another row's."""
    def near(ids):
        return spark.createDataFrame([(i, [1.0, 1.0, 1.0, 1.0]) for i in ids] + [(i, [1.0, 1.0, -1.0, 1.0]) for i in (7, 8, 9)], "vec_id bigint, embedding array<double>")

    got = hamming_topk.search(near([0, 0, 0, 0, 1, None, None]), every=100, k=3, segment_bits=2).collect()
    assert sorted((r["rank"], r["vec_id"], r["distance"]) for r in got) == [(1, 1, 0), (2, 7, 1), (3, 8, 1)]
    got = rp_forest.search(near([0, 0, 1, 1, 1, 2, 3]), every=100, k=3).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 1), (2, 2), (3, 3)]


def test_chance_marks_do_not_hide_the_article():
    story = "".join(f"<p>Paragraph {k} of the article itself, in plain sight.</p>" for k in range(5))
    text = [f"Paragraph {k} of the article itself, in plain sight." for k in range(5)]
    for chance in ("<article class=card>A teaser</article>", "<div class=post-meta>By A. Writer</div>"):
        assert html_text.unique_runs([f"<body><div>{story}</div>{chance}"]) == ["\n".join([*text, re.sub("<[^>]*>", "", chance)])]
    assert html_text.unique_runs([f"<body><main>{story}</main><article>A teaser</article><p>Note"]) == ["\n".join([*text, "A teaser"])]
    assert html_text.unique_runs([f"<body><p>Note</p><article>{story}</article>"]) == ["\n".join(text)]
    assert html_text.unique_runs([f"<body><main>{story}<article class=teaser>Read more</article></main>"]) == ["\n".join([*text, "Read more"])]


@pytest.mark.parametrize("page, want", [
    ("<article><p>a</p><ul><li class='ad'><div>Buy now</div></li><li>b</li></ul></article>", "a\nb"),
    ("<article>a<b>b</b>c<span class='ad'>no</span>d</article>", "abcd"),
    ("<article>a<span class='ad'>x<span>y</span>z<div><span>v</span></div>w</span>b</article>", "a\nb"),
    ("<article>a <script>x()</script>b<button>go<div>on</div></button> c<svg><text>t</text></svg></article>", "a b c"),
    ("<article><dl><dt class=ad>x<dd>y<dt>z</dl><table><tr><td class=promo>p<td>q<tr><td>r</table></article>", "y\nz\nq\nr"),
    ("<article><p class=advert>no<p>yes<ul><li class=share>no<ul><li>no</ul><li>yes</ul></article>", "yes\nyes"),
    ("<head><title>t</title><body><article>a<nav>n</nav>b</article>", "a\nb"),
    ("<article><header>top</header><div class='comments'>c<p>d</p></div>e</article><header>no</header>", "top\ne"),
])
def test_furniture_neither_leaks_nor_cuts(page, want):
    assert html_text.unique_runs([page]) == [want]


def brute_pages(pages, min_words=6, min_pages=3):
    """The contract of a host with plain blocks, with sets of strings: (content, [blocks of words]) of each page -> texts."""
    where = {}
    streams = [[w for b in blocks for w in ("\n", *b)] for _, blocks in pages]
    for (content, _), stream in zip(pages, streams):
        for i in range(len(stream) - min_words + 1):
            where.setdefault(tuple(stream[i : i + min_words]), set()).add(content)
    out = []
    for stream in streams:
        gone = [False] * len(stream)
        for i in range(len(stream) - min_words + 1):
            if len(where[tuple(stream[i : i + min_words])]) >= min_pages:
                marks = [j for j in range(i, i + min_words) if stream[j] == "\n"]
                end = i + min_words
                if marks and marks[-1] > i:  # a block that begins within the string counts only if it ends there
                    end = end if end == len(stream) or stream[end] == "\n" else marks[-1]
                    if stream[i] != "\n":
                        continue
                gone[i:end] = [True] * (end - i)
        blocks, at = [], 0
        for w, g in zip(stream, gone):
            if w == "\n":
                blocks.append([])
            elif not g:
                blocks[-1].append(w)
        out.append("\n".join(" ".join(b) for b in blocks if b))
    return out


@pytest.mark.parametrize("shard_pages", [2000, 7])
def test_host_suffix_array_against_brute_force(spark, monkeypatch, shard_pages):
    """Unmarked pages of a few hosts: menus, footers, shared passages and copies, in one shard and in many."""
    monkeypatch.setattr(html_text, "SHARD_PAGES", shard_pages)
    rng = random.Random(6)
    furniture = [[" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(2, 12))) for _ in range(5)] for _ in range(3)]
    rows_, hosts = [], {}
    for k in range(90):
        h = min(rng.randrange(6), 2)
        own = [" ".join(rng.choice("ijklmnop") + rng.choice("qrst") for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(0, 4))]
        blocks = rng.sample(furniture[h], rng.randrange(0, 4)) + own + rng.sample(furniture[h], 1)
        if rng.random() < 0.2 and hosts.get(h):
            blocks = [" ".join(b) for b in rng.choice(hosts[h])[1][1]]
        hosts.setdefault(h, []).append((k, ("\n".join(blocks), [b.split(" ") for b in blocks])))
        rows_.append((k, f"http://h{h}.x/{k}", "".join(f"<p>{b}</p>" for b in blocks)))
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows_, "page_id bigint, url string, html string")).collect()}
    want = {k: t for own in hosts.values() for (k, _), t in zip(own, brute_pages([p for _, p in own]))}
    assert got == want


PAGES = [
    ("<html><head><title>T</title><script>var t='</p>';x()</script></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; line</h1><p><b>One\n two.<br><p>Three<div class=\"comments\"><p>nice</p></div><form>f</form><aside>s</aside>x &lt;y</article><footer>f</footer>", "Head & line\nOne two.\nThree\nx <y"),
    ("<main><header>kept</header><p>a</p><!-- c --><p>b</main>", "kept\na\nb"),
    (None, ""), ("", ""), ("<p>", ""), ("plain &eacute; text", "plain é text"), ("<article><p>same</p></article>", "same"), ("<article><p>same</p></article>", "same"),
    ("<article>unclosed <i>tag", "unclosed tag"), ("<div hidden>no</div><article>yes<style>p{}</style></article>", "yes"),
]


def test_html(spark):
    df = spark.createDataFrame([(k, "http://h.x/", h, "c") for k, (h, _) in enumerate(PAGES)], "page_id bigint, url string, html string, text string")
    got = rows(html_text.extract(df), "page_id")
    for k, (h, want) in enumerate(PAGES):
        assert got[k]["text"] == want and got[k]["n_chars"] == len(want), h
    assert html_text.extract(df.limit(0)).count() == 0


def test_host_boilerplate(spark):
    menu, foot = "<p>home about contact news shop help</p>", "<p>all rights reserved by the owners of this</p>"
    pages = [(k, "https://A.b/x" if k % 2 else "https://a.b/y", f"{menu}<p>own{k} text{k} stays{k} here</p>{foot}") for k in range(8)]
    got = rows(html_text.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")), "page_id")
    assert {r["text"] for r in got.values()} == {f"own{k} text{k} stays{k} here" for k in range(8)}


def test_unique_runs_keeps_the_last_group_whole():
    pages = [f"<p>own{k} text{k} zz k l m n zzz" for k in range(3)]
    assert html_text.unique_runs(pages, 6, 3) == [f"own{k} text{k}" for k in range(3)]


def test_a_copied_article_stays_and_a_long_notice_does_not_outweigh_it(spark):
    """Copies of an article with other furniture around it count as one page; repeated text outside weighs nothing."""
    article = "<article><p>" + " ".join(f"w{j}" for j in range(30)) + "</p></article>"
    notice = "<p>" + " ".join(f"n{j}" for j in range(80)) + "</p>"
    pages = [(k, "http://c.x/", f"<p>item{k} top{k}</p>{article}{notice}") for k in range(4)]
    pages += [(10 + k, "http://c.x/", f"<article>own{k} story{k}</article>{notice}") for k in range(3)]
    pages += [(20, "http://c.x/long", "<article>" + "".join(f"<p>long{j} text{j}</p>" for j in range(20_000)) + "</article>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert {got[k] for k in range(4)} == {" ".join(f"w{j}" for j in range(30))}
    assert [got[10 + k] for k in range(3)] == [f"own{k} story{k}" for k in range(3)] and got[20].count("\n") == 19_999


@pytest.mark.parametrize("shard_pages", [2000, 5])
def test_host_boilerplate_over_shards(spark, monkeypatch, shard_pages):
    """A string on four pages of a large host goes, one on two pages stays, whatever the size of a shard."""
    monkeypatch.setattr(html_text, "SHARD_PAGES", shard_pages)
    rare, often = "seen on two pages only and so it stays", "this very line stands on four pages of the host"
    extra = {3: often, 14: often, 25: often, 36: often, 7: rare, 31: rare}
    own = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(40)]
    made = ["".join(f"<p>{t}</p>" for t in ([own[k], extra[k]] if k in extra else [own[k]])) for k in range(40)]
    copies = [(100 + k, "http://big.x/c", f"<p>{own[0]}</p><p>copies of a page count once as one page</p>") for k in range(6)]
    pages = [(k, f"http://big.x/{k}", h) for k, h in enumerate(made)] + copies
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    want = {k: f"{own[k]}\n{rare}" if extra.get(k) == rare else own[k] for k in range(40)}
    assert got == want | {100 + k: f"{own[0]}\ncopies of a page count once as one page" for k in range(6)}


def test_pipeline_keeps_rows_of_shared_and_null_ids(spark, docs):
    import corpus_pipeline

    rng = random.Random(5)
    own = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)) for _ in range(4)]
    made = [(5, own[0]), (5, own[1]), (5, own[0]), (9, own[1]), (None, own[2]), (None, own[2]), (None, own[3]), (1, own[3])]
    df = spark.createDataFrame([tuple({"doc_id": k, "text": t}.get(c) for c in docs.columns) for k, t in made], docs.schema)
    got = corpus_pipeline.near_duplicates(spark, df, SF)
    kept = [(5, own[0]), (5, own[1]), (None, own[2]), (1, own[3])]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, kept))
    tails = spark.createDataFrame([tuple({"doc_id": k, "text": t}.get(c) for c in docs.columns) for k, t in [(5, own[0]), (5, "short " + own[1]), (None, f"{own[1]} end")]], docs.schema)
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.repeated_passages(spark, tails, SF).collect()}
    assert got == {(5, own[0]), (5, "short " + own[1]), (None, " end")}


def test_pipeline_keeps_own_replacement_characters(spark, docs):
    import corpus_pipeline

    rng = random.Random(4)
    passage = "é" + "".join(rng.choice("abcdefgh") for _ in range(120))
    # 0xC3 0xA9 and 0xC4 0xA9 share their second byte, so the repeat starts within a code point
    texts = {0: f"first {passage} end", 1: f"own \ufffd mark ĩ{passage[1:]}x"}
    df = spark.createDataFrame([tuple({"doc_id": k, "text": t}.get(c) for c in docs.columns) for k, t in texts.items()], docs.schema)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_passages(spark, df, SF).collect()}
    assert got == {0: (texts[0], len(texts[0])), 1: (left := "own \ufffd mark x", len(left))}


@pytest.fixture(scope="module")
def stages(spark, docs):
    """(name, input, output) of every stage over the fixture, each working on what the one before kept."""
    import corpus_pipeline

    out, kept = [], docs
    for name, stage in corpus_pipeline.STAGES:
        done = spark.createDataFrame((df := stage(spark, kept, SF)).collect(), df.schema)
        out.append((name, kept, done))
        kept = done
    return {name: (a, b) for name, a, b in out}


def keys(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns or df.columns) for r in df.collect())


def test_pipeline_filters(spark, docs, stages):
    """The first two stages keep whole rows, those that the operators' own scores accept."""
    names = list(stages)
    assert names == ["quality classifier", "language id", "minhash near-dedup", "suffix-array dedup", "best-fit packing"]
    source, kept = stages["quality classifier"]
    scores = rows(quality_crf.score(source, quality_crf.fit(source, spark.read.parquet(f"{SF}/labels.parquet"))))
    assert keys(kept) == keys(source.where(F.col("doc_id").isin([k for k, r in scores.items() if r["score"] >= 0.3])))
    source, kept = stages["language id"]
    judged = rows(language_id.identify(source, language_id.fit(source)))
    assert keys(kept) == keys(source.where(F.col("doc_id").isin([k for k, r in judged.items() if r["accepted"]])))
    assert 0 < kept.count() < docs.count()


def test_pipeline_near_duplicates_against_brute_force(stages):
    source, kept = stages["minhash near-dedup"]
    classes = brute_classes({r["doc_id"]: r["text"] for r in source.collect()})
    assert keys(kept) == keys(source.where(F.col("doc_id").isin(sorted(set(classes.values()))))) and len(set(classes.values())) < len(classes)


def test_pipeline_repeats_against_brute_force(stages):
    source, kept = stages["suffix-array dedup"]
    want, seen = {}, set()
    for k, text in sorted((r["doc_id"], r["text"]) for r in source.collect()):
        raw = text.encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(raw[i : i + 100])
        left, at = [], 0
        for c in text:  # a code point goes if any of its bytes does
            n = len(c.encode())
            left.append("" if any(gone[at : at + n]) else c)
            at += n
        want[k] = "".join(left)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()} == {k: (t, len(t)) for k, t in want.items()}
    assert kept.columns == source.columns and want != {r["doc_id"]: r["text"] for r in source.collect()}


def test_pipeline_packing_and_run(spark, stages):
    import corpus_pipeline
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    source, packed = stages["best-fit packing"]
    want = []
    for r in source.collect():
        ids = t.encode(r["text"], add_special_tokens=False).ids + [0]
        want += [(r["doc_id"], k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r[c] for c in columns) for r in packed.collect()) == sorted(want)
    assert keys(corpus_pipeline.run(spark, SF), *columns) == keys(packed, *columns)


def test_pipeline_stages_on_odd_rows(spark, docs):
    """Empty tables, null, empty, repeated and very long texts, null ids and columns whose names clash with the operators' own."""
    import corpus_pipeline

    odd = docs.limit(60).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", "x", "y", 0), (5, None, None, "y", None), (7, "a b c", "en", None, 5), (7, "a b c", "en", None, 5), (8, "word " * 900_000, "en", "s", 1)], docs.schema))
    odd = odd.withColumns({"id": F.lit("own"), "spans": F.lit(1), "bands": F.lit(2.0), "_row": F.lit("r")})
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            done = stage(spark, df, SF)
            assert (done.columns == df.columns) == (name != "best-fit packing")
            n = done.count()
            assert n == 0 if df is not odd else n > 0
            if name == "best-fit packing" and df is odd:
                assert done.select("doc_id").where("doc_id IS NULL").count() == 2
            if name == "suffix-array dedup" and df is odd:
                assert n == odd.count()


def test_empty_tables(spark, edge_docs, docs):
    none, labels = edge_docs.limit(0), spark.read.parquet(f"{SF}/labels.parquet")
    field = quality_crf.fit(none, labels.limit(0))
    assert field.prior == 0.5 and quality_crf.score(none, field).count() == 0 and quality_crf.keep(none, field).count() == 0
    assert language_id.identify(none, language_id.fit(none)).count() == 0 and byte_bpe.round_trip(none).count() == 0
    assert {r["score"] for r in quality_crf.score(edge_docs, field).collect()} == {0.5}


def test_a_text_beyond_one_slice(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(800_000))
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert rows(token_counts.token_counts(df))[1]["n_tokens"] == len(t.encode(text, add_special_tokens=False).ids)
    assert rows(byte_bpe.round_trip(df))[1]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert rows(suffix_dedup.digest(df))[1]["n_removed"] == 0


def test_hamming_of_odd_vectors(spark):
    """Null vectors take no part, null, NaN and missing components are 0 bits; segments follow the number of rows."""
    df, x = vectors(spark)
    got = {}
    for r in hamming_topk.search(df.union(spark.createDataFrame([(500, [1.0, 2.0], 1)], df.schema)), every=100, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
    bits = {k: x[k] > 0 for k in range(300)} | {k: np.zeros(32, bool) for k in (901, 902, 950)} | {500: np.array([True, True] + [False] * 30)}
    assert set(got) == {0, 100, 200, 500}
    for q, own in got.items():
        want = sorted((int((bits[q] != b).sum()), k) for k, b in bits.items() if k != q)[:5]
        assert sorted(own) == [(i + 1, k, d) for i, (d, k) in enumerate(want)]
