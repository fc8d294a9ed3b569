"""Readers, writers, web sources, streams, entry points."""

import hashlib
from urllib.error import URLError

import pytest
from pyspark.sql import functions as F

from tarnwork.schemas import REJECTIONS, SOURCE_ASSETS
from tarnwork.sources import readers, sinks, web
from tarnwork.streaming import ingest

HOME = "https://amarket.com.bo/collections/all"


def page(*links):
    return (200, "text/html", "".join(f'<a href="{x}">x</a>' for x in links).encode())


def test_discover():
    site = web.fixture({HOME: page("/products/A", "/products/A/", "?page=2", "https://other.bo/products/Z"), HOME + "?page=2": page("/products/B", "/collections/all?page=3"), HOME + "?page=3": page("/products/C", "/products/D?x=1")})
    found, pages = web.discover(site, HOME)
    assert [u[-1] for u in found] == list("ABCD") and pages == 3
    with pytest.raises(PermissionError):
        web.discover(site, HOME, lambda u: False)
    with pytest.raises(RuntimeError, match="COLLECTION_HTTP_404"):
        web.discover(web.fixture({}), HOME)
    assert web.next_collection('<a href="https://evil.bo/collections/all?page=2">', HOME) is None


def test_robots():
    rules = web.robots(web.fixture({"https://amarket.com.bo/robots.txt": (200, "text/plain", b"User-agent: *\nDisallow: /private")}), HOME, "t")
    web.check_robots(rules, "t", HOME)
    with pytest.raises(PermissionError):
        web.check_robots(rules, "t", "https://amarket.com.bo/private/x")
    with pytest.raises(RuntimeError):
        web.robots(web.fixture({}), HOME, "t")


@pytest.mark.parametrize("status, calls", [(404, 1), (429, 4), (500, 4), (200, 1)])
def test_retries(status, calls):
    made, slept = [], []

    def send(url):
        made.append(url)
        return web.Response(status, "", b"")

    assert web.with_retries(send, "u", 3, 2, slept.append).status == status
    assert len(made) == calls and slept == [2 * (k + 1) for k in range(calls - 1)]

    def broken(url):
        raise URLError("x")

    with pytest.raises(URLError):
        web.with_retries(broken, "u", 1, 0, slept.append)


def test_fetch_all(spark):
    urls = spark.createDataFrame([("a",), ("b",)], "url string")
    got = {r["url"]: r["status"] for r in web.fetch_all(urls, web.fixture({"a": (200, "text/html", b"x")})).collect()}
    assert got == {"a": 200, "b": 404}


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "d" / "m.csv")
    df = spark.createDataFrame([("1", "007", 'q "x",\nline', None)], "source_asset_id string, sku_id string, description string, extra string")
    sinks.csv(df, path, SOURCE_ASSETS)
    row = readers.source_assets(spark, path).first()
    assert row["sku_id"] == "007" and row["description"] == 'q "x",\nline' and len(row) == 22
    assert readers.rejections(spark, str(tmp_path / "none.csv")).columns == REJECTIONS
    assert readers.typed_assets(readers.source_assets(spark, path)).first()["http_status"] is None


def test_csv_by_address(spark, tmp_path):
    """Through Spark's file systems: a new file, one that is replaced, an empty table, no leftovers."""
    rows = spark.createDataFrame([("1", "a,b"), ("2", None)], "x string, y string")
    for df, want in ((rows, 'y,x\n"a,b",1\n,2\n'), (rows.where("x = '2'"), "y,x\n,2\n"), (rows.limit(0), "y,x\n")):
        sinks.csv(df, f"file://{tmp_path}/m.csv", ["y", "x"])
        assert (tmp_path / "m.csv").read_text() == want
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["m.csv"]


def test_file_hashes(spark, tmp_path):
    body = bytes(range(256)) * 9000
    (tmp_path / "a b.png").write_bytes(body)
    (tmp_path / "c.png").write_bytes(b"c")
    got = {r["stem"]: r["sha256"] for r in readers.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {"a b": hashlib.sha256(body).hexdigest(), "c": hashlib.sha256(b"c").hexdigest()}


def test_writers(spark, tmp_path):
    assert sinks.blob(str(tmp_path / "x" / "b"), b"1") == "created"
    assert sinks.blob(str(tmp_path / "x" / "b"), b"1") == "existing"
    with pytest.raises(FileExistsError):
        sinks.blob(str(tmp_path / "x" / "b"), b"2")
    sinks.json_document({"a": "é"}, str(tmp_path / "j.json"))
    assert (tmp_path / "j.json").read_text(encoding="utf-8") == '{\n  "a": "é"\n}\n'
    with pytest.raises(FileExistsError):
        sinks.prepare_output(str(tmp_path / "x"))
    assert not any(sinks.prepare_output(str(tmp_path / "x"), overwrite=True).iterdir())


def test_stream_ingest_is_idempotent(spark, tmp_path):
    schema = "id string, key string, n int"
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([("a", "k", 1), ("a", "k", 2), ("b", "l", 3)], schema).write.parquet(source)
    for run in ("one", "two"):
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.ingest(stream, store, str(tmp_path / run), "id", "key", ["n"]).awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(store).collect()) == [1, 3]


def test_tumbling(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D UNION ALL SELECT timestamp'2024-01-01 01:00:00', 'a', 4.0D")
    assert sorted((r["n"], r["total"]) for r in ingest.tumbling_counts(df).collect()) == [(1, 4.0), (2, 3.0)]


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


def test_checksums(spark, tmp_path):
    (tmp_path / "m").write_text("a" * 64 + "  docs/x.md\n\nbad\n")
    assert [tuple(r) for r in readers.checksums(spark, str(tmp_path / "m")).collect()] == [("a" * 64, "docs/x.md")]
    assert readers.file_hashes(spark, str(tmp_path), (".m",)).where(F.lit(False)).count() == 0
