"""The command line on a small dataset."""

import json
import os
import sys

import numpy as np
import pandas as pd
import pytest

from tarnwork import cli
from tarnwork.functions.images import decode, png
from tarnwork.plans import crawl
from tarnwork.sources import readers, web


def test_split_command(spark, tmp_path):
    rows = "".join(f"s{k // 2},a{k},d{k}\n" for k in range(20))
    (tmp_path / "m.csv").write_text("sku_id,source_asset_id,duplicate_group_id\n" + rows)
    assert cli.main(["split", "--manifest", str(tmp_path / "m.csv"), "--output", str(tmp_path / "s.csv")]) == 0
    lines = (tmp_path / "s.csv").read_text().splitlines()
    assert lines[0] == "sku_id,source_asset_id,duplicate_group_id,split" and len(lines) == 21
    assert json.loads((tmp_path / "s.csv.evidence.json").read_text())["cero_leakage"] is True


def test_evaluate_command(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    for k in range(3):
        (tmp_path / "labels" / f"i{k}.txt").write_text("0 0.5 0.5 0.5 0.5\n")
    spark.createDataFrame([(f"i{k}", 0, 0.9, 25.0, 25.0, 75.0, 75.0, 100, 100) for k in range(3)], "stem string, pred_idx int, conf double, x0 double, y0 double, x1 double, y1 double, width int, height int").write.parquet(str(tmp_path / "p"))
    args = ["evaluate", "--predictions", str(tmp_path / "p"), "--labels", str(tmp_path / "labels"), "--output-dir", str(tmp_path / "out")]
    assert cli.main(args) == 0
    got = json.loads((tmp_path / "out" / "metrics.json").read_text())
    assert (got["tp"], got["f1"]) == (3, 1.0) and abs(got["map50"] - 0.995) < 1e-9
    assert cli.main(args) == 1  # not overwritten
    assert cli.main([*args, "--split", "test", "--overwrite"]) == 1


def stub(batch: pd.DataFrame) -> pd.DataFrame:
    """One sure detection an image, one unsure; none in the second."""
    rows = []
    for path in batch.path:
        if path.endswith("_0002.png"):
            rows.append((path, None, None, None, None, None, None, 4.0))
        else:
            rows += [(path, 0, 0.9, 1.0, 2.0, 3.0, 4.0, 2.0), (path, 1, 0.1, 0.0, 0.0, 1.0, 1.0, 2.0)]
    return pd.DataFrame(rows, columns=[x.split()[0] for x in cli.PREDICTED.split(", ")])


def test_samples_train_and_predict(spark, tmp_path):
    data = str(tmp_path / "set")
    assert cli.main(["samples", "detection", "--output-dir", data, "--n-train", "3", "--n-val", "2", "--n-test", "1"]) == 0
    assert sorted(os.listdir(f"{data}/images/train")) == [f"fixture_train_000{k}.png" for k in (1, 2, 3)]
    assert readers.labels(spark, f"{data}/labels/val").count() == 2
    (tmp_path / "c.yaml").write_text("modelo: m\nepochs: 40\nimgsz: 416\nbatch: 8\nseed: 42\nsmoke: {epochs: 2}\n")
    train = ["train", "--config", str(tmp_path / "c.yaml"), "--data", f"{data}/dataset.yaml", "--output-dir", str(tmp_path / "run"), "--smoke"]
    assert cli.main(train) == 0 and "epochs: 2" in (tmp_path / "run" / "resolved_config.yaml").read_text()
    assert cli.main(train) == 1  # not overwritten
    sys.modules["stub_predictor"] = sys.modules[__name__]
    args = ["predict", "--predictor", "stub_predictor:stub", "--input", f"{data}/images/train", "--output-dir", str(tmp_path / "p"), "--names", "product"]
    assert cli.main(args) == 0
    got = json.loads((tmp_path / "p" / "predictions.json").read_text())
    assert [len(r["detections"]) for r in got["predictions"]] == [1, 0, 1] and got["predictions"][0]["detections"][0]["class_name"] == "product"
    assert got["mean_inference_ms"] == pytest.approx(8 / 3) and json.loads((tmp_path / "p" / "timing_summary.json").read_text())["n_images"] == 3
    assert cli.main([*args, "--overwrite", "--limit", "1"]) == 0 and len(json.loads((tmp_path / "p" / "predictions.json").read_text())["predictions"]) == 1
    assert cli.main([*args, "--overwrite", "--limit", "0"]) == 1 and cli.main([*args, "--overwrite", "--conf", "2"]) == 1
    for kind in ("splits", "boxes"):
        assert cli.main(["samples", kind, "--output-dir", str(tmp_path / kind)]) == 0
    audit = pd.read_csv(tmp_path / "boxes" / "box_audit.csv")
    assert sorted(audit.status) == ["accepted"] * 4 + ["rejected"] and audit.shape[1] == 30
    assert len(pd.read_csv(tmp_path / "splits" / "splits_synthetic.csv")) == 36


def test_png_decoder():
    rng = np.random.default_rng(0)
    for channels, mode in ((1, "L"), (3, "RGB"), (4, "RGBA")):
        pixels = rng.integers(0, 256, (5, 7, channels)).astype(np.uint8)
        form, got, back = decode(png(pixels))
        assert (form, got) == ("PNG", mode) and (back == pixels).all()
    for bad in (None, b"", b"junk", png(pixels)[:-20], png(pixels)[:40]):
        with pytest.raises(ValueError):
            decode(bad)


HOME = "https://amarket.com.bo"


def product(name, image):
    return 200, "text/html; charset=utf-8", f'<title>{name}</title><meta property="og:image" content="{image}"><script>{{"sku": "{name}1"}}</script>'.encode()


def test_crawl_end_to_end(spark, tmp_path):
    """Accepted products, each kind of rejection, and a second run that adds nothing."""
    solid, clear = np.full((4, 4, 3), 200, np.uint8), np.zeros((4, 4, 4), np.uint8)
    noisy = solid.copy()
    noisy[0, 0] = 0
    image = lambda n: f"{HOME}/cdn/shop/files/{n}.png"
    good = lambda pixels: (200, "image/png", png(pixels))
    site = {f"{HOME}/products/{n}": product(n, image(n)) for n in ("a", "b", "noisy", "gone", "junk", "text", "large", "blocked-image")}
    site |= {image("a"): good(solid), image("b"): good(clear), image("noisy"): good(noisy), image("junk"): (200, "image/png", b"junk"), image("text"): (200, "text/html", b"x"), image("large"): (200, "image/png", b"x" * 5000)}
    site |= {f"{HOME}/products/plain": (200, "text/plain", b"x"), f"{HOME}/products/nameless": (200, "text/html", b"<p>x")}
    ask = web.fixture(site)

    def get(url, max_bytes):
        if url.endswith("down"):
            raise OSError("no route")
        answer = ask(url)
        if max_bytes and len(answer.body) > max_bytes:
            raise RuntimeError("REJECTED_MAX_BYTES")
        return answer

    config = {"source": {"name": "SHOP"}, "limits": {"max_image_bytes": 4000}, "outputs": {"images_dir": str(tmp_path / "images"), "manifest": str(tmp_path / "m.csv"), "rejects": str(tmp_path / "r.csv"), "summary": str(tmp_path / "s.json")}}
    products = sorted({u for u in site if "/products/" in u} | {f"{HOME}/products/{n}" for n in ("missing", "secret", "down")})
    allowed = lambda u: "secret" not in u and u != image("blocked-image")
    first = crawl.run(spark, products, get, allowed, config, collection_pages=1)
    assert (first["accepted"], first["files"], first["accepted_this_run"], first["collection_pages"]) == (2, 2, 2, 1)
    why = {r["product_page_url"].rsplit("/", 1)[1]: r["rejection_reason"] for r in readers.rejections(spark, str(tmp_path / "r.csv")).collect()}
    assert why == {
        "noisy": "ValueError: BACKGROUND_COMPLEX", "gone": "RuntimeError: IMAGE_HTTP_NOT_200", "junk": "ValueError: IMAGE_UNDECODABLE", "text": "ValueError: IMAGE_NOT_IMAGE", "large": "RuntimeError: REJECTED_MAX_BYTES",
        "blocked-image": "PermissionError: ROBOTS_IMAGE_BLOCKED", "plain": "ValueError: PRODUCT_NOT_HTML", "nameless": "ValueError: PRODUCT_NAME_MISSING", "missing": "RuntimeError: PRODUCT_HTTP_NOT_200", "secret": "PermissionError: ROBOTS_PRODUCT_BLOCKED", "down": "OSError: no route",
    }
    row = {r["sku_id"]: r for r in readers.source_assets(spark, str(tmp_path / "m.csv")).collect()}
    assert {k: r["background_mode"] for k, r in row.items()} == {"a": "UNIFORM_RGB", "b": "TRANSPARENT_ALPHA"} and os.path.exists(row["a"]["local_path"])
    again = crawl.run(spark, products, get, allowed, config, collection_pages=1)
    assert (again["accepted"], again["accepted_this_run"], again["rejected_this_run"]) == (2, 0, 0)
    smoke = crawl.run(spark, products[-1:], get, allowed, config, full=False)
    assert smoke["rejected_this_run"] == 1 and "collection_pages" not in smoke
