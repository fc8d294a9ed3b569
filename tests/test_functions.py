"""URLs, HTML, identities, geometry, reproducibility."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import boxes, html, identity, reproducibility, urls


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("url, want", [
    ("HTTPS://Amarket.COM.bo/Products/Ab-1///?v=1#x", "https://amarket.com.bo/Products/Ab-1"),
    ("https://a.b/c d/?q", "https://a.b/c d"), ("https://a.b/", "https://a.b"), ("https://A.b", "https://a.b"), ("/rel/", "/rel"), ("", ""),
])
def test_canonical(spark, url, want):
    assert one(spark, urls.canonical(F.col("u")), u=url) == want


@pytest.mark.parametrize("url, want", [("https://a.b/products/0610985012303/", "0610985012303"), ("https://a.b/products/x y", ""), ("https://a.b/products/x/z", ""), ("https://a.b/PRODUCTS/ab.c_d-1?x", "ab.c_d-1")])
def test_sku(spark, url, want):
    assert one(spark, urls.last_segment_sku(F.col("u")), u=url) == want


def test_mime_and_names(spark):
    assert one(spark, urls.mime(F.col("m")), m=" Text/HTML ; charset=x") == "text/html"
    assert one(spark, urls.is_html(F.col("m")), m=None) is False
    assert one(spark, urls.is_image(F.col("m")), m="IMAGE/png") is True
    assert one(spark, urls.extension(F.col("f"), F.lit("image/webp")), f="jpeg") == ".jpg"
    assert one(spark, urls.extension(F.col("f"), F.lit("image/webp; q")), f=None) == ".webp"
    assert one(spark, urls.file_name(F.col("s"), F.lit("0123456789abcdef"), F.lit(".png")), s="k") == "k_0123456789ab.png"
    assert one(spark, urls.labels_folder(F.col("p")), p="a/images/b\\images/train/x.png") == "a/images/b/labels/train/x.png"
    assert one(spark, urls.labels_folder(F.col("p")), p="a/b") is None
    assert one(spark, urls.stem(F.col("p")), p="/x/y.z.png") == "y.z"


def test_image_url():
    page = "https://amarket.com.bo/products/a"
    assert urls.image_of("//cdn.x/cdn/shop/files/a.png?v=1&amp;w=2#f", page) == "https://amarket.com.bo/cdn/shop/files/a.png?v=1&w=2"
    assert urls.image_of("/other/a.png", page) is None
    assert urls.image_of("http://[bad", page) is None


PAGE = '<html><head><title> A  b — Amarket</title><meta property="OG:Title" content="old"><meta name="og:title" content="Name — Amarket"><meta name="description" content="d"></head><body><a href="/products/x">l</a><img src="/cdn/shop/files/1.png" alt="other"><img src="/cdn/shop/files/2.png" alt="the NAME">t <b>u</b></body></html>'


def test_parse_and_metadata(spark):
    df = spark.createDataFrame([("https://a.b/products/s1", PAGE), ("https://a.b/products/s2", "<title></title>"), (None, None)], "url string, html string")
    rows = {r["url"]: r for r in html.product_metadata(html.parse(df)).collect()}
    r = rows["https://a.b/products/s1"]
    assert (r["title"], r["text"], r["links"], r["product_name"], r["sku_id"]) == ("A b — Amarket", "l t u", ["/products/x"], "Name", "s1")
    assert r["image_url"].endswith("/2.png") and r["description"] == "d" and r["metadata_reason"] is None
    assert rows["https://a.b/products/s2"]["metadata_reason"] == "PRODUCT_NAME_MISSING"


def test_next_page(spark):
    rows = [("https://a.b/c", 0, "https://a.b/c?page=3"), ("https://a.b/c", 1, "https://a.b/c?page=2&x"), ("https://a.b/c", 2, "https://z.b/c?page=2"), ("https://a.b/c?page=3", 0, "https://a.b/c?page=2")]
    got = html.next_page(spark.createDataFrame(rows, "page_url string, pos int, link string")).collect()
    assert [tuple(r) for r in got] == [("https://a.b/c", "https://a.b/c?page=2&x")]


def test_identity(spark):
    df = spark.createDataFrame([("s", "HTTPS://A.b/P/", "https://c.d/i.png?v=1", "h")], "s string, p string, i string, h string")
    key = identity.asset_key(*[F.col(c) for c in "spih"])
    assert df.select(key.alias("k")).first()["k"] == "s|https://a.b/P|https://c.d/i.png|h"
    assert df.select(identity.asset_id(key).alias("k")).first()["k"] == hashlib.sha256(b"s|https://a.b/P|https://c.d/i.png|h").hexdigest()
    assert df.select(identity.rejection_key(F.col("s"), F.lit(None).cast("string"), F.col("h")).alias("k")).first()["k"] == "s||h"


@pytest.mark.parametrize("box, size, want", [
    ((2, 1, 6, 5), (10, 8), "0 0.450000 0.437500 0.500000 0.625000"), ((0, 0, 0, 0), (10, 20), "0 0.050000 0.025000 0.100000 0.050000"),
    ((0, 0, 9, 7), (10, 8), "0 0.500000 0.500000 1.000000 1.000000"),
])
def test_label_lines(spark, box, size, want):
    df = spark.createDataFrame([(*box, *size)], "a int, b int, c int, d int, w int, h int")
    assert df.select(boxes.label_line(boxes.normalised(*[F.col(c) for c in "abcdwh"])).alias("x")).first()["x"] == want


def test_six_decimals_match_python(spark):
    values = [k / 128 for k in range(129)] + [k / 7 for k in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["x"] for r in df.select(boxes.six(F.col("v")).alias("x")).collect()] == [f"{v:.6f}" for v in values]
    with pytest.raises(ValueError):
        boxes.label_line({}, 1)


def test_parsed_label_and_iou(spark):
    df = spark.createDataFrame([("0 .5 .5 .2 .4",), ("0 1 2",), ("",)], "l string")
    got = [r["b"] for r in df.select(boxes.parsed_label(F.col("l")).alias("b")).collect()]
    assert tuple(got[0]) == (0, 0.5, 0.5, 0.2, 0.4) and got[1:] == [None, None]
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, boxes.iou(lit(0, 0, 2, 2), lit(1, 1, 3, 3)), z=1.0) == pytest.approx(1 / 7)
    assert one(spark, boxes.iou(lit(0, 0, 0, 0), lit(0, 0, 0, 0)), z=1.0) == 0
    assert one(spark, boxes.class_name({0: "product"}, F.lit(7)), z=1.0) == "7"


def test_fingerprints(tmp_path):
    assert reproducibility.fingerprint({"b": [1, (2,)], "a": tmp_path}) == reproducibility.fingerprint({"a": tmp_path, "b": (1, [2])})
    assert reproducibility.canonical_json({"b": "é", "a": None, 2: {"z": 1, "y": ()}}) == '{"2":{"y":[],"z":1},"a":null,"b":"é"}'
    for bad in ({"a": {1, 2}}, {"a": b"x"}):
        with pytest.raises(TypeError):
            reproducibility.canonical_json(bad)
    with pytest.raises(ValueError):
        reproducibility.canonical_json({"a": math.nan})
    (tmp_path / "f").write_bytes(b"amarket-reproducibility")
    assert reproducibility.file_sha256(tmp_path / "f") == "94353d8c8c3d85baef9f51dbe51e0a6f04ac7ada9d28867e6c950a2e27ffd9d5"
    with pytest.raises(FileNotFoundError):
        reproducibility.file_sha256(tmp_path / "no")
    assert reproducibility.parameters_hash(127, "v") == hashlib.sha256(json.dumps({"alpha_threshold": 127, "algorithm_version": "v"}, sort_keys=True).encode()).hexdigest()
    assert reproducibility.weight_manifest(tmp_path / "f")["size_bytes"] == 23


@pytest.mark.parametrize("seed, error", [(True, TypeError), (1.0, TypeError), (-1, ValueError), (1 << 32, ValueError)])
def test_seeds(seed, error):
    with pytest.raises(error):
        reproducibility.validate_seed(seed)
    assert reproducibility.set_seeds(7)["seed"] == 7


def config(**changes):
    base = {
        "source": {"name": "SHOP", "collection_url": "u"}, "http": {k: 1 for k in ("user_agent", "delay_seconds", "timeout_seconds", "max_retries", "backoff_seconds")},
        "limits": {"max_products": 3, "max_images_per_product": 1, "max_image_bytes": 100}, "outputs": {k: "x" for k in ("images_dir", "manifest", "rejects", "summary")}, "rights": {"status": "REDISTRIBUTION_PROHIBITED"},
    }
    for path, value in changes.items():
        section, _, key = path.partition("__")
        if value is None:
            (base[section].pop(key) if key else base.pop(section))
        else:
            base[section][key] = value
    return base


@pytest.mark.parametrize("mode, changes, text", [
    ("smoke", {"http": None}, "http.user_agent must be given; http.delay_seconds"), ("smoke", {"limits__max_products": None}, "limits.max_products"), ("full", {"rights": None}, "rights"),
    ("smoke", {"source__name": None}, "source.name"), ("smoke", {"limits__max_images_per_product": 2}, "max_images_per_product must be 1"), ("smoke", {"limits__max_image_bytes": "x"}, "whole number above 0"),
    ("full", {"limits__max_image_bytes": 5242881}, "5242880 at most"), ("full", {"rights__status": "x"}, "REDISTRIBUTION_PROHIBITED"),
])
def test_crawl_config(mode, changes, text):
    with pytest.raises(ValueError, match=text):
        reproducibility.check_crawl_config(config(**changes), mode)
    assert reproducibility.check_crawl_config(config(), mode)
    with pytest.raises(ValueError, match="source.name must be OTHER"):
        reproducibility.check_crawl_config(config(), mode, source="OTHER")
    full = config(limits__max_products=None)
    assert reproducibility.check_crawl_config(full, "full")


def test_hyperparameters(tmp_path):
    config_ = {"modelo": "m", "epochs": 40, "imgsz": 416, "batch": 8, "seed": 42, "smoke": {"epochs": 2}}
    got = reproducibility.resolve_hyperparameters(config_, seed=1, smoke=True)
    assert (got["epochs"], got["imgsz"], got["batch"], got["seed"], got["smoke"], got["optimizer"]) == (2, 64, 2, 1, True, "auto")
    assert reproducibility.resolve_hyperparameters(config_)["epochs"] == 40
    (tmp_path / "d.yaml").write_text("path: data\ntrain: images/train\nval: images/val\n")
    assert reproducibility.dataset_folders(tmp_path / "d.yaml") == {s: str(tmp_path / "data" / "images" / s) for s in ("train", "val")}
    assert "python" in reproducibility.environment()
