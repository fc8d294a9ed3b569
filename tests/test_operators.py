"""Manifests, splits, masks, evaluation, gates, against small brute-force models."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.functions.boxes import parsed_label
from tarnwork.operators import evaluation, manifest, masks, quality, splits
from tarnwork.operators.graph import components
from tarnwork.sources import readers, sinks


def test_merge_keep_first(spark):
    schema = "id string, key string, n int"
    prior = spark.createDataFrame([("a", "ka", 1)], schema)
    new = spark.createDataFrame([("a", "kz", 2), ("b", "ka", 3), ("c", "kc", 4), ("c", "kd", 5), ("d", "kc", 6)], schema)
    once = manifest.merge_keep_first(prior, new, "id", "key", ["n"])
    assert sorted(tuple(r) for r in once.collect()) == [("a", "ka", 1), ("c", "kc", 4)]
    assert manifest.merge_keep_first(once, new, "id", "key", ["n"]).count() == 2


def test_rejections_reasons_reconcile(spark):
    schema = "p string, i string, r string, n int"
    prior = spark.createDataFrame([("p", None, "x", 1)], schema)
    new = spark.createDataFrame([("p", "", "x", 2), ("q", None, "x", 3), ("q", None, "x", 4)], schema)
    assert sorted(r["n"] for r in manifest.merge_rejections(prior, new, ["p", "i", "r"], ["n"]).collect()) == [1, 3]
    df = spark.createDataFrame([(1,), (2,), (3,)], "v int").select(manifest.first_reason([(F.col("v") > 2, "big"), (F.col("v") > 1, "mid")]).alias("x"))
    assert sorted((r["x"] or "") for r in df.collect()) == ["", "big", "mid"]
    rows = spark.createDataFrame([("a",), ("b",)], "local_path string")
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    assert manifest.check_reconciled(manifest.reconcile(rows, rows.limit(1), files))["attempted"] == 3
    with pytest.raises(ValueError, match="Reconciliación inválida"):
        manifest.check_reconciled(manifest.reconcile(rows, rows, files.limit(1)))


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr("tarnwork.operators.graph.LOCAL_EDGES", local)
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (100, 101), (101, 102), (102, 103)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


GOLDEN = {"train": 25, "val": 6, "test": 5}


def test_synthetic_split(spark):
    rows = readers.synthetic_manifest(spark)
    done = splits.make_splits(rows)
    assert {r["split"]: r["count"] for r in done.groupBy("split").count().collect()} == GOLDEN
    first = {r["sku_id"]: r["split"] for r in done.collect()}
    assert [first[f"SKU00{k}"] for k in (1, 2, 3, 4)] == ["val", "train", "test", "test"]
    report = splits.leakage_report(done).first()
    assert report["cero_leakage"] and report["all_splits_non_empty"]
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, splits.make_splits(rows).collect()))


def test_singletons_split(spark):
    rows = spark.range(655).select(F.col("id").alias("row_idx"), *[F.concat(F.lit(c), "id").alias(n) for c, n in zip("sad", splits.IDS)])
    got = {r["split"]: r["count"] for r in splits.make_splits(rows).groupBy("split").count().collect()}
    assert got == {"train": 459, "val": 98, "test": 98}


def test_split_errors(spark):
    rows = spark.createDataFrame([(k, f"s{k}", f"a{k}", f"d{k}") for k in range(2)], "row_idx bigint, sku_id string, source_asset_id string, duplicate_group_id string")
    for change, text in ((rows, "too few groups"), (rows.drop("sku_id"), "columns are missing"), (rows.withColumn("sku_id", F.lit(None).cast("string")), "null values"), (rows.withColumn("class_id", F.lit(1)), "class_id must be 0")):
        with pytest.raises(ValueError, match=text):
            splits.make_splits(change)
    for ratios, text in (((1,), "1 ratios for 3"), (("a", 0, 0), "numbers"), ((True, 0, 0), "numbers"), ((-1, 1, 1), "below 0"), ((0.5, 0.1, 0.1), "add up to 0.7"), ((float("nan"), 0, 1), "numbers")):
        with pytest.raises(ValueError, match=text):
            splits.validate_ratios(ratios)


def png(rows) -> bytes:
    """An RGBA or RGB image of 8-bit rows."""
    kind = {3: 2, 4: 6}[len(rows[0][0])]
    raw = b"".join(b"\0" + bytes(v for p in r for v in p) for r in rows)
    part = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_audit_images(spark, tmp_path):
    clear, solid = (0, 0, 0, 0), (9, 9, 9, 255)
    rect = [[solid if 2 <= x <= 6 and 1 <= y <= 5 else clear for x in range(10)] for y in range(8)]
    white = [[(10, 20, 30) if 8 <= x < 12 and 4 <= y < 9 else (255, 255, 255) for x in range(20)] for y in range(20)]
    noisy = [[((x * 37) % 255, (y * 91) % 255, 0) for x in range(20)] for y in range(20)]
    for name, body in (("rect", png(rect)), ("empty", png([[clear] * 4] * 4)), ("white", png(white)), ("noisy", png(noisy)), ("junk", b"junk")):
        (tmp_path / f"{name}.png").write_bytes(body)
    images = readers.images(spark, str(tmp_path)).select("image", F.col("stem").alias("source_asset_id"), F.lit("k").alias("sku_id"), F.col("path").alias("image_path"), F.lit("h").alias("source_sha256"))
    rgb = {"tolerance": 5.0, "delta": 30.0, "min_pixels": 10}
    audit = masks.audit_images(images, "out", rgb=rgb)
    rows = {r["source_asset_id"]: r for r in audit.collect()}
    assert len(audit.columns) == 31 and len(rows) == 5
    assert rows["rect"]["label_line"] == "0 0.450000 0.437500 0.500000 0.625000" and rows["rect"]["label_path"] == "out/rect.txt"
    assert (rows["white"]["mask_method"], rows["white"]["x0"], rows["white"]["y1"], rows["white"]["foreground_pixel_count"]) == ("rgb", 8, 9, 20)
    assert rows["junk"]["status"] == "rejected" and "decodificable" in rows["junk"]["rejection_reason"]
    assert "fondo no uniforme" in rows["noisy"]["rejection_reason"] and rows["empty"]["label_path"] == "" and "vacía" in rows["empty"]["rejection_reason"]
    alone = {r["source_asset_id"]: r for r in masks.audit_images(images, "out").collect()}
    assert alone["white"]["status"] == "rejected"
    sinks.labels(audit, str(tmp_path / "labels"))
    found = readers.labels(spark, str(tmp_path / "labels"))
    assert {r["stem"] for r in found.collect()} == {"rect", "white"}
    assert quality.label_invariants(found.withColumnRenamed("stem", "source_asset_id")).first()["invalid_boxes"] == 0


def test_rgb_mask_against_numpy(spark):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 40, (6, 7, 3))
    image[2:4, 3:5] = 200
    rows = [("k", y, x, *map(int, image[y, x])) for y in range(6) for x in range(7)]
    fg, verdict = masks.rgb_mask(spark.createDataFrame(rows, "k string, y int, x int, r int, g int, b int"), "k", ["r", "g", "b"], 6, 7, 99.0, 30.0, 1)
    edge = np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]]).astype(float)
    back = np.median(edge, axis=0)
    assert verdict.first()["border_std"] == pytest.approx(np.linalg.norm(edge - back, axis=1).std())
    want = {tuple(p) for p in np.argwhere(np.linalg.norm(image - back, axis=2) > 30)}
    assert {(r["y"], r["x"]) for r in fg.collect()} == want


def test_greedy_matching(spark):
    gt = spark.createDataFrame([("i", 0, 0, 0.0, 0.0, 10.0, 10.0), ("i", 1, 0, 2.0, 0.0, 12.0, 10.0), ("j", 0, 0, 0.0, 0.0, 5.0, 5.0)], "image string, gt_idx int, cls int, g0 double, g1 double, g2 double, g3 double")
    pred = spark.createDataFrame([("i", 0, 0, 0.9, 1.0, 0.0, 11.0, 10.0), ("i", 1, 0, 0.8, 1.0, 0.0, 11.0, 10.0), ("j", 0, 0, 0.7, 50.0, 50.0, 60.0, 60.0)], "image string, pred_idx int, cls int, conf double, p0 double, p1 double, p2 double, p3 double")
    m = evaluation.match_greedy(gt, pred)
    assert sorted((r["gt_idx"], r["pred_idx"]) for r in m.collect()) == [(0, 0), (1, 1)]
    found = evaluation.examples(gt, pred, m)
    row = evaluation.precision_recall(found).first()
    assert (row["tp"], row["fp"], row["fn"]) == (2, 1, 1)
    with pytest.raises(ValueError):
        evaluation.require_ground_truth(gt.limit(0))
    with pytest.raises(PermissionError):
        evaluation.require_unlocked("test", False)


def brute_evaluation(gt, pred, threshold):
    """Matches of each image in order of boxes; true positives by class in falling confidence; plain loops."""
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    matches, hits = set(), set()
    for image in {g[0] for g in gt}:
        used = set()
        for g in sorted(g for g in gt if g[0] == image):
            free = [(-iou(g[3:], p[4:]), p[1]) for p in pred if p[0] == image and p[1] not in used and iou(g[3:], p[4:]) > 0]
            if free and -min(free)[0] >= threshold:
                used.add(min(free)[1])
                matches.add((image, g[1], min(free)[1]))
    taken = set()
    for p in sorted(pred, key=lambda p: (-p[3], p[1])):
        own = [(-iou(g[3:], p[4:]), g[1]) for g in gt if g[0] == p[0] and g[2] == p[2]]
        if own and -min(own)[0] >= threshold and (p[0], min(own)[1]) not in taken:
            taken.add((p[0], min(own)[1]))
            hits.add(p[:2])
    return matches, hits


def test_crowded_images_of_two_classes(spark):
    rng = random.Random(8)
    box = lambda: (x := rng.randrange(0, 30, 2), y := rng.randrange(0, 12, 2), x + 10, y + 10)
    gt = [(i, g, rng.randrange(2), *map(float, box())) for i in range(12) for g in range(rng.randrange(0, 6))]
    pred = [(i, k, rng.randrange(2), rng.randrange(20) / 20, *map(float, box())) for i in range(12) for k in range(rng.randrange(0, 12))]
    pred += [(i, 100 + g, c, 0.5, *b) for i, g, c, *b in gt if rng.random() < 0.7]
    a = spark.createDataFrame(gt, "image int, gt_idx int, cls int, g0 double, g1 double, g2 double, g3 double")
    b = spark.createDataFrame(pred, "image int, pred_idx int, cls int, conf double, p0 double, p1 double, p2 double, p3 double")
    for threshold in (0.3, 0.5, 0.75):
        matches, hits = brute_evaluation(gt, pred, threshold)
        assert {(r["image"], r["gt_idx"], r["pred_idx"]) for r in evaluation.match_greedy(a, b, threshold).collect()} == matches
        got = {(r["cls"], r["conf"]): (r["n"], r["tp"]) for r in evaluation.true_positives(a, b, [threshold]).collect()}
        want = {}
        for p in pred:
            n, tp = want.get((p[2], p[3]), (0, 0))
            want[p[2], p[3]] = (n + 1, tp + (p[:2] in hits))
        assert got == want
    found, row = evaluation.evaluate(a, b)
    metrics = row.first()
    assert metrics["tp"] == len(brute_evaluation(gt, pred, 0.5)[0]) and 0 < metrics["map50_95"] <= metrics["map50"] <= 1
    two = evaluation.true_positives(a.where("image < 0").union(spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 10.0, 10.0), (0, 1, 0, 4.0, 0.0, 14.0, 10.0)], a.schema)), b.where("image < 0").union(spark.createDataFrame([(0, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 1, 0, 0.8, 4.0, 0.0, 14.0, 10.0)], b.schema)), [0.3, 0.5])
    assert sorted((r["conf"], r["tp"]) for r in two.collect()) == [(0.8, 1), (0.8, 1), (0.9, 1), (0.9, 1)]


def test_average_precision_against_numpy(spark):
    rng = random.Random(1)
    rows = [(0.5, rng.randrange(30) / 30, int(rng.random() < 0.6)) for _ in range(80)]
    positives = 60
    boxes = lambda n: spark.range(n).select(F.lit(0).alias("cls"))
    form = "cls int, threshold double, conf double, n int, tp int"
    points = evaluation.curve(spark.createDataFrame([(0, t, c, 1, hit) for t, c, hit in rows], form), boxes(positives))
    tp = n = 0
    recall, precision = [], []
    for c in sorted({r[1] for r in rows}, reverse=True):
        tp += sum(r[2] for r in rows if r[1] == c)
        n += sum(1 for r in rows if r[1] == c)
        recall.append(tp / positives)
        precision.append(tp / n)
    env = np.maximum.accumulate(np.array(precision)[::-1])[::-1]
    recall = np.array(recall)
    grid = np.linspace(0, 1, 101)
    want = {
        "exact": float(np.sum(np.diff(np.append(0, recall)) * env)),
        "coco101": float(np.mean([max(env[recall >= g - 1e-9], default=0) for g in grid])),
    }
    r, high = np.unique(recall), [env[recall == x].max() for x in np.unique(recall)]
    low = [env[recall == x].min() for x in r]
    for method, value in want.items():
        assert evaluation.average_precision(points, method).first()["ap"] == pytest.approx(value), method
    got = evaluation.average_precision(points, "trapz101").first()["ap"]
    if high == low:
        assert got == pytest.approx(np.trapezoid(np.interp(grid, np.concatenate([[0], r, [1]]), np.concatenate([[1], high, [0]])), grid))
    perfect = evaluation.curve(spark.createDataFrame([(0, 0.5, 0.9, 1, 1)] * 4, form), boxes(4))
    assert evaluation.average_precision(perfect).first()["ap"] == pytest.approx(0.995)


def test_gates(spark):
    a = spark.createDataFrame([("x",), ("y",)], "stem string")
    b = spark.createDataFrame([("y",), ("z",)], "stem string")
    assert sorted(tuple(r) for r in quality.orphans(a, b).collect()) == [("image", "x"), ("label", "z")]
    with pytest.raises(ValueError, match="huérfanos"):
        quality.check_no_orphans(a, b)
    quality.check_no_orphans(a, a)
    labels = spark.createDataFrame([("0 .5 .5 .2 .2",), ("0 .5 .5 0 .2",), ("1 .5 .5 .1 .1",)], "l string").select(parsed_label(F.col("l")).alias("b")).select("b.*")
    audit = spark.createDataFrame([("rejected", "", "UNIFORM_RGB"), ("accepted", "", "COMPLEX")], "status string, rejection_reason string, background_mode string")
    row = quality.gate(audit, labels, quality.orphans(a, b), a.limit(0)).first()
    assert (row["rejected_without_reason"], row["bad_background"], row["invalid_boxes"], row["orphans"], row["passed"]) == (1, 1, 2, 2, False)
