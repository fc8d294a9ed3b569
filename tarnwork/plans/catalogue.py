"""The registered queries over the driver's tables, and their DuckDB counterparts.

Tables without images or detections stand in for them: ``embeddings`` rows are 8 x 8 rasters, the lines of
an order are detections of one object whose box is made from the order's first line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.functions import boxes, html, identity, urls
from tarnwork.operators import evaluation, manifest, masks, quality, splits
from tarnwork.operators.graph import components
from tarnwork.plans import crawl
from tarnwork.streaming.ingest import tumbling_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SIDE, LEVEL = 8, 0.2


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB form."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- addresses -------------------------------------------------------------------------------------------

_CANON = r"""(CASE WHEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) = '' THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')
    ELSE lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)) || substr(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), length(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)) + 1) END)"""


@query(f"SELECT page_id, url, {_CANON} AS canonical FROM pages")
def url_canonical(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", "url", urls.canonical(F.col("url")).alias("canonical"))


@query(f"SELECT DISTINCT {_CANON} AS canonical FROM pages ORDER BY 1")
def url_distinct_sorted(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(urls.canonical(F.col("url")).alias("canonical")).distinct().orderBy("canonical")


@query("SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host_counts(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


_SEGMENT = "regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '(?i)/(?:en|fr|de|es)/([^/?#]+)$', 1)"


@query(f"SELECT page_id, CASE WHEN regexp_matches({_SEGMENT}, '^[A-Za-z0-9._-]+$') THEN {_SEGMENT} ELSE '' END AS sku_id FROM pages")
def url_sku_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.last_segment_sku(F.col("url"), "(?:en|fr|de|es)").alias("sku_id"))


@query("SELECT page_id, coalesce(CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS INTEGER), 1) AS page FROM pages")
def url_page_number(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.coalesce(urls.page_number(F.col("url")), F.lit(1)).alias("page"))


@query("""SELECT doc_id, lower(trim(split_part(source || '; charset=' || lang, ';', 1))) AS mime,
    ('text/' || lang) IN ('text/html', 'application/xhtml+xml') AS html, starts_with(lower(trim(split_part('Image/' || source || ';q=1', ';', 1))), 'image/') AS image FROM documents""")
def mime_normalize(spark, sf_dir):
    c = F.col
    return read(spark, sf_dir, "documents").select("doc_id", urls.mime(F.concat("source", F.lit("; charset="), "lang")).alias("mime"), urls.is_html(F.concat(F.lit("text/"), "lang")).alias("html"), urls.is_image(F.concat(F.lit("Image/"), c("source"), F.lit(";q=1"))).alias("image"))


@query("SELECT doc_id, source || '_' || substr(sha256(text), 1, 12) || CASE lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN '.png' ELSE '.webp' END AS file_name FROM documents")
def file_name(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "JPEG").when(F.col("lang") == "fr", "png")
    ext = urls.extension(kind, F.lit("image/webp; q=1"))
    return read(spark, sf_dir, "documents").select("doc_id", urls.file_name(F.col("source"), identity.content_sha256(F.col("text")), ext).alias("file_name"))


@query("""WITH p AS (SELECT page_id, '/data/images/' || lang_dir || '/images/x.png' AS path FROM (SELECT page_id, coalesce(nullif(regexp_extract(url, '/(en|fr|de|es)/', 1), ''), 'zz') AS lang_dir FROM pages))
    SELECT page_id, regexp_replace(path, '^(.*)/images/x[.]png$', '\\1/labels/x.png') AS labels_path FROM p""")
def labels_folder(spark, sf_dir):
    part = F.coalesce(F.nullif(F.regexp_extract("url", "/(en|fr|de|es)/", 1), F.lit("")), F.lit("zz"))
    path = F.concat(F.lit("/data/images/"), part, F.lit("/images/x.png"))
    return read(spark, sf_dir, "pages").select("page_id", urls.labels_folder(path).alias("labels_path"))


# --- pages -----------------------------------------------------------------------------------------------


@query("""SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS pos FROM pages)""")
def html_links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(html.link_list(F.col("html"))).alias("pos", "link"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INTEGER) AS links FROM pages""")
def html_link_counts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.size(html.link_list(F.col("html"))).alias("links"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("""SELECT page_id, lower(regexp_extract(html, '<meta charset="([^"]*)"', 1)) AS charset FROM pages""")
def html_meta_charset(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.charset(F.col("html")).alias("charset"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INTEGER) AS n_links, CAST(len(regexp_extract_all(html, '<img ')) AS INTEGER) AS n_images FROM pages""")
def html_parsed(spark, sf_dir):
    """The full parser, not the regular expressions."""
    return html.parse(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.size("links").alias("n_links"), F.size("images").alias("n_images"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages)
    SELECT link, count(DISTINCT page_id) AS pages FROM l GROUP BY link HAVING count(DISTINCT page_id) > 1""")
def shared_links(spark, sf_dir):
    return html_links(spark, sf_dir).groupBy("link").agg(F.count_distinct("page_id").alias("pages")).where("pages > 1")


# --- identity and manifests ------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_sha256(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", identity.content_sha256(F.col("text")).alias("sha256"))


@query("SELECT sha256(text) AS duplicate_group_id, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(identity.duplicate_group_id(F.col("text")).alias("duplicate_group_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def _assets(spark, sf_dir):
    sha = identity.content_sha256(F.col("text"))
    key = identity.joined(F.col("source"), F.col("lang"), sha)
    return read(spark, sf_dir, "documents").select("doc_id", sha.alias("sha256"), key.alias("identity"), identity.asset_id(identity.joined(key, F.col("doc_id") % 2)).alias("asset_id"), "source", "n_chars")


_ASSETS = "assets AS (SELECT doc_id, sha256(text) AS sha256, concat_ws('|', source, lang, sha256(text)) AS identity, sha256(concat_ws('|', source, lang, sha256(text), doc_id % 2)) AS asset_id, source, n_chars FROM documents)"


@query(f"WITH {_ASSETS} SELECT doc_id, identity, asset_id FROM assets")
def asset_identity(spark, sf_dir):
    return _assets(spark, sf_dir).select("doc_id", "identity", "asset_id")


@query("SELECT page_id, sha256('src|' || " + _CANON + " || '|' || " + _CANON.replace("'/+$'", "'$'") + " || '|' || sha256(html)) AS asset_id FROM pages")
def asset_id_of_pages(spark, sf_dir):
    key = identity.asset_key(F.lit("src"), F.col("url"), F.col("url"), identity.content_sha256(F.col("html")))
    return read(spark, sf_dir, "pages").select("page_id", identity.asset_id(key).alias("asset_id"))


@query(f"""WITH {_ASSETS}, prior AS (SELECT * FROM assets WHERE doc_id % 2 = 0),
    fresh AS (SELECT * FROM assets n WHERE NOT EXISTS (SELECT 1 FROM prior p WHERE p.asset_id = n.asset_id) AND NOT EXISTS (SELECT 1 FROM prior p WHERE p.identity = n.identity)),
    once AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY doc_id) AS k FROM fresh)
    SELECT doc_id, asset_id FROM prior UNION ALL SELECT doc_id, asset_id FROM once WHERE k = 1""")
def manifest_merge_keep_first(spark, sf_dir):
    rows = _assets(spark, sf_dir)
    return manifest.merge_keep_first(rows.where("doc_id % 2 = 0"), rows, "asset_id", "identity", ["doc_id"]).select("doc_id", "asset_id")


@query("""WITH r AS (SELECT doc_id, source, lang, CASE WHEN n_chars < 600 THEN 'SHORT' ELSE 'LONG' END AS reason FROM documents), prior AS (SELECT * FROM r WHERE doc_id % 4 = 0 AND lang = 'en'),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY source, lang, reason ORDER BY doc_id) AS k FROM r n WHERE NOT EXISTS (SELECT 1 FROM prior p WHERE p.source = n.source AND p.lang = n.lang AND p.reason = n.reason))
    SELECT doc_id, source, lang, reason FROM prior UNION ALL SELECT doc_id, source, lang, reason FROM fresh WHERE k = 1""")
def rejection_dedup(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.when(F.col("n_chars") < 600, "SHORT").otherwise("LONG").alias("reason"))
    return manifest.merge_rejections(rows.where("doc_id % 4 = 0 AND lang = 'en'"), rows, ["source", "lang", "reason"], ["doc_id"])


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN 'PermissionError: ROBOTS_PRODUCT_BLOCKED' WHEN n_chars < 500 THEN 'RuntimeError: PRODUCT_HTTP_NOT_200'
    WHEN source = 'src3' THEN 'ValueError: PRODUCT_NOT_HTML' WHEN doc_id % 13 = 0 THEN 'OSError: x' WHEN doc_id % 7 = 0 THEN 'RuntimeError: IMAGE_HTTP_NOT_200' WHEN n_chars > 5000 THEN 'RuntimeError: REJECTED_MAX_BYTES'
    WHEN doc_id % 5 = 0 THEN 'ValueError: BACKGROUND_COMPLEX' WHEN doc_id % 3 <> 0 AND doc_id % 11 = 0 THEN 'ValueError: IMAGE_FORMAT_NOT_ALLOWED' END AS reason FROM documents""")
def first_failing_reason(spark, sf_dir):
    c, yes = F.col, F.lit(True)
    docs = read(spark, sf_dir, "documents").withColumns({
        "robots_product": c("lang") != "de", "product_status": F.when(c("n_chars") < 500, 404).otherwise(200), "product_type": F.when(c("source") == "src3", "image/png").otherwise("text/html; x"),
        "metadata_reason": F.lit(None).cast("string"), "robots_image": yes, "image_status": F.when(c("doc_id") % 7 == 0, 500).otherwise(200), "image_body": F.repeat(F.lit("x"), F.when(c("n_chars") > 5000, 2).otherwise(1)),
        "product_error": F.lit(None).cast("string"), "image_error": F.when(c("doc_id") % 13 == 0, "OSError: x"), "image_format": F.when(c("doc_id") % 3 == 0, "PNG"),
        "image_type": F.when(c("doc_id") % 11 == 0, "image/tiff").otherwise("image/png"), "decoded": yes, "background_mode": F.when(c("doc_id") % 5 == 0, "COMPLEX").otherwise("UNIFORM_RGB"),
    })
    return docs.select("doc_id", manifest.first_reason(manifest.crawl_rules(1)).alias("reason"))


@query("SELECT count(*) FILTER (WHERE n_chars >= 600) AS accepted, count(*) FILTER (WHERE n_chars < 600) AS rejected, count(*) AS attempted FROM documents")
def crawl_summary(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return manifest.summary(docs.where("n_chars >= 600"), docs.where("n_chars < 600"))


@query("""WITH a AS (SELECT * FROM documents WHERE n_chars >= 600) SELECT (SELECT count(*) FROM a) AS accepted, (SELECT count(*) FROM documents WHERE n_chars < 600) AS rejected, (SELECT count(*) FROM documents WHERE n_chars IS NOT NULL) AS attempted, (SELECT count(*) FROM labels) AS files,
    (SELECT count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.doc_id)) AS missing, (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM a WHERE l.doc_id = a.doc_id)) AS extra""")
def reconcile_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("f"), "doc_id").alias("local_path"), "n_chars")
    return manifest.reconcile(docs.where("n_chars >= 600"), docs.where("n_chars < 600"), read(spark, sf_dir, "labels").select(F.concat(F.lit("f"), "doc_id").alias("path")))


@query("SELECT 'p/' || doc_id AS product_page_url, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS image_url, '2024-01-01T00:00:00+00:00' AS retrieved_at, 'run' AS retrieval_run_id, 'ValueError: ' || lang AS rejection_reason FROM documents")
def rejection_records(spark, sf_dir):
    image, reason = F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.concat(F.lit("ValueError: "), "lang")
    return read(spark, sf_dir, "documents").select(*crawl.rejection(F.concat(F.lit("p/"), "doc_id"), image, "2024-01-01T00:00:00+00:00", "run", reason))


_NAME = "trim(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END)"
_SHOP = urls.IMAGE_ROOT


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE {_NAME} END AS product_name, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE '' END AS description,
    CASE WHEN p_partkey % 2 = 0 THEN 'item-' || p_partkey WHEN p_partkey % 11 = 0 THEN '' ELSE 'S' || p_size END AS sku_id,
    CASE WHEN p_partkey % 5 <> 0 THEN '{_SHOP}/cdn/shop/files/' || p_partkey || '.png?v=1&w=2' WHEN p_partkey % 13 <> 0 THEN '{_SHOP}/cdn/shop/files/named.jpg' WHEN p_partkey % 7 <> 0 THEN '{_SHOP}/cdn/shop/files/last.webp' END AS image_url,
    CASE WHEN p_partkey % 13 = 0 THEN 'PRODUCT_NAME_MISSING' WHEN p_partkey % 2 = 1 AND p_partkey % 11 = 0 THEN 'SKU_MISSING' END AS metadata_reason FROM part""")
def product_metadata(spark, sf_dir):
    """Product pages made of parts: names, descriptions, skus and image candidates in several places."""
    c, n = F.col, F.col("p_partkey")
    some = lambda test, *x: F.when(test, F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])).otherwise("")
    named = F.when(n % 3 == 0, c("p_brand")).otherwise(c("p_name"))
    page = F.concat(
        some(n % 13 != 0, "<title> ", c("p_name"), " </title>"), some((n % 3 == 0) & (n % 13 != 0), '<meta property="og:title" content="', c("p_brand"), ' — Amarket">'),
        some(n % 4 == 0, '<meta name="description" content="', c("p_type"), '">'), some(n % 5 != 0, '<meta property="og:image" content="//cdn.x/cdn/shop/files/', n.cast("string"), '.png?v=1&amp;w=2">'),
        F.lit('<img src="/other/x.png" alt="x">'), some(n % 7 != 0, '<img src="https://z.x/cdn/shop/files/last.webp" alt="">'), some(n % 13 != 0, '<img src="/cdn/shop/files/named.jpg" alt="A ', F.upper(named), '!">'),
        some(n % 11 != 0, '<script>{"sku" : "S', c("p_size").cast("string"), '"}</script>'),
    )
    url = F.concat(F.lit(f"{_SHOP}/"), F.when(n % 2 == 0, F.concat(F.lit("products/item-"), n.cast("string"), F.lit("/?x=1"))).otherwise("pages/item"))
    made = read(spark, sf_dir, "part").select("p_partkey", url.alias("url"), page.alias("html"))
    found = html.product_metadata(html.parse(made).join(made.select("p_partkey", "html"), "p_partkey"))
    return found.select("p_partkey", "product_name", "description", "sku_id", "image_url", "metadata_reason")


_LINKS = "links AS (SELECT 'https://s.x/c' || o_custkey || CASE WHEN o_custkey % 2 = 0 THEN '?page=3' ELSE '' END AS page_url, o_orderkey AS pos, CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE 1 END AS here, CAST(o_orderkey % 9 AS INTEGER) AS there, o_orderkey % 4 <> 0 AS same, 'https://' || CASE WHEN o_orderkey % 4 = 0 THEN 'other.x' ELSE 'S.x' END || '/c' || o_custkey || '?page=' || o_orderkey % 9 || '&o=' || o_orderkey AS link FROM orders)"


@query(f"WITH {_LINKS} SELECT page_url, arg_min(link, there * 10000000000 + pos) AS next_url FROM links WHERE same AND there > here GROUP BY page_url")
def next_collection_page(spark, sf_dir):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    page = F.concat(F.lit("https://s.x/c"), k, F.when(k % 2 == 0, "?page=3").otherwise(""))
    link = F.concat(F.lit("https://"), F.when(o % 4 == 0, "other.x").otherwise("S.x"), F.lit("/c"), k, F.lit("?page="), o % 9, F.lit("&o="), o)
    return html.next_page(read(spark, sf_dir, "orders").select(page.alias("page_url"), o.alias("pos"), link.alias("link")))


# --- rasters, boxes, audit -------------------------------------------------------------------------------


def _pixels(spark, sf_dir):
    return masks.raster(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", SIDE)


def _extremes(spark, sf_dir):
    return masks.extremes(_pixels(spark, sf_dir).where(F.col("value") > F.lit(LEVEL).cast("float")), "vec_id")


_PIX = f"""pix AS (SELECT vec_id, (i - 1) // {SIDE} AS y, (i - 1) % {SIDE} AS x, embedding[i] AS value FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings)),
    box AS (SELECT vec_id, CAST(min(x) AS INTEGER) AS x_min, CAST(min(y) AS INTEGER) AS y_min, CAST(max(x) AS INTEGER) AS x_max, CAST(max(y) AS INTEGER) AS y_max, count(*) AS foreground_pixel_count
        FROM pix WHERE value > CAST({LEVEL} AS FLOAT) GROUP BY vec_id),
    norm AS (SELECT *, (x_min + x_max + 1) / 2.0::DOUBLE / {SIDE} AS xc, (y_min + y_max + 1) / 2.0::DOUBLE / {SIDE} AS yc, (x_max + 1 - x_min) / {SIDE}::DOUBLE AS w, (y_max + 1 - y_min) / {SIDE}::DOUBLE AS h FROM box),
    line AS (SELECT *, printf('0 %.6f %.6f %.6f %.6f', xc, yc, w, h) AS label_line FROM norm)"""


@query(f"WITH {_PIX} SELECT * FROM box")
def bbox_extremes(spark, sf_dir):
    return _extremes(spark, sf_dir)


@query(f"WITH {_PIX} SELECT vec_id, label_line FROM line")
def bbox_yolo_line(spark, sf_dir):
    sized = _extremes(spark, sf_dir).withColumns({"image_width_px": F.lit(SIDE), "image_height_px": F.lit(SIDE)})
    return masks.boxed(sized).select("vec_id", "label_line")


@query(f"WITH {_PIX} SELECT vec_id, CASE WHEN b.vec_id IS NULL THEN 'rejected' ELSE 'accepted' END AS status FROM embeddings e LEFT JOIN box b USING (vec_id)".replace("b.vec_id IS NULL", "b.x_min IS NULL"))
def mask_empty_rejected(spark, sf_dir):
    found = read(spark, sf_dir, "embeddings").select("vec_id").join(_extremes(spark, sf_dir), "vec_id", "left")
    return found.select("vec_id", F.when(F.col("x_min").isNull(), "rejected").otherwise("accepted").alias("status"))


_ZERO = ", ".join(f"coalesce({e}, 0) AS {n}" for n, e in {
    "foreground_pixel_count": "CAST(foreground_pixel_count AS INTEGER)", "x_min": "x_min", "y_min": "y_min", "x_max": "x_max", "y_max": "y_max", "x0": "x_min", "y0": "y_min", "x1": "x_max + 1", "y1": "y_max + 1",
    "x_center_px": "x_min + (x_max + 1 - x_min) / 2.0::DOUBLE", "y_center_px": "y_min + (y_max + 1 - y_min) / 2.0::DOUBLE", "box_width_px": "x_max + 1 - x_min", "box_height_px": "y_max + 1 - y_min",
    "x_center": "CAST(split_part(label_line, ' ', 2) AS DOUBLE)", "y_center": "CAST(split_part(label_line, ' ', 3) AS DOUBLE)", "width": "CAST(split_part(label_line, ' ', 4) AS DOUBLE)", "height": "CAST(split_part(label_line, ' ', 5) AS DOUBLE)",
}.items())


@query(f"""WITH {_PIX} SELECT CAST(e.vec_id AS VARCHAR) AS source_asset_id, CAST(label AS VARCHAR) AS sku_id, 0 AS class_id, 'i/' || e.vec_id || '.png' AS image_path, CASE WHEN l.x_min IS NULL THEN '' ELSE 'labels/' || e.vec_id || '.txt' END AS label_path,
    {SIDE} AS image_width_px, {SIDE} AS image_height_px, CASE WHEN l.x_min IS NOT NULL AND label = 1 THEN 'rgb' ELSE 'alpha' END AS mask_method, 'pixel-extremes-v1' AS algorithm_version,
    sha256('{{"algorithm_version": "pixel-extremes-v1", "alpha_threshold": 127}}') AS parameters_hash, {_ZERO}, sha256(CAST(e.vec_id AS VARCHAR)) AS source_sha256,
    CASE WHEN l.x_min IS NULL THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN l.x_min IS NULL THEN 'Máscara vacía: no hay píxeles de foreground (rechazo, sin label).' ELSE '' END AS rejection_reason
    FROM embeddings e LEFT JOIN line l USING (vec_id)""")
def box_audit(spark, sf_dir):
    """All thirty columns."""
    name = F.col("vec_id").cast("string")
    rows = read(spark, sf_dir, "embeddings").select(name.alias("source_asset_id"), F.col("label").cast("string").alias("sku_id"), F.concat(F.lit("i/"), name, F.lit(".png")).alias("image_path"), F.lit(SIDE).alias("image_width_px"), F.lit(SIDE).alias("image_height_px"), F.sha2(name.cast("binary"), 256).alias("source_sha256"), F.lit(None).cast("string").alias("reason"))
    method = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") == 1, "rgb").otherwise("alpha").alias("mask_method"))
    found = _extremes(spark, sf_dir).join(method, "vec_id").select(name.alias("source_asset_id"), "x_min", "y_min", "x_max", "y_max", "foreground_pixel_count", "mask_method")
    return masks.audit(rows, found, "labels", 127, "pixel-extremes-v1").drop("label_line")


@query(f"""WITH {_PIX}, a AS (SELECT vec_id, CASE WHEN label = 0 THEN 255 WHEN value > CAST({LEVEL} AS FLOAT) THEN 200 ELSE 100 END AS a FROM pix JOIN embeddings USING (vec_id))
    SELECT vec_id, min(a) = 255 AS opaque, CASE WHEN min(a) = 255 THEN 0 ELSE count(*) FILTER (WHERE a > 127) END AS foreground_pixel_count FROM a GROUP BY vec_id""")
def alpha_mask(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    alpha = F.when(F.col("label") == 0, 255).when(F.col("value") > F.lit(LEVEL).cast("float"), 200).otherwise(100)
    mask, opaque = masks.alpha_mask(_pixels(spark, sf_dir).join(rows, "vec_id").withColumn("a", alpha), "vec_id", 127)
    counts = mask.groupBy("vec_id").agg(F.count("*").alias("foreground_pixel_count"))
    out = rows.join(opaque.withColumn("opaque", F.lit(True)), "vec_id", "left").join(counts, "vec_id", "left")
    return out.select("vec_id", F.coalesce("opaque", F.lit(False)).alias("opaque"), F.coalesce("foreground_pixel_count", F.lit(0)).alias("foreground_pixel_count"))


_EDGE = "edge AS (SELECT * FROM pix WHERE y = 0 UNION ALL SELECT * FROM pix WHERE y = 7 UNION ALL SELECT * FROM pix WHERE x = 0 UNION ALL SELECT * FROM pix WHERE x = 7), bg AS (SELECT vec_id, median(CAST(value AS DOUBLE)) AS background FROM edge GROUP BY vec_id)"


@query(f"WITH {_PIX}, {_EDGE} SELECT vec_id, round(background, 6) AS background FROM bg")
def border_background(spark, sf_dir):
    pixels = _pixels(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    return masks.background(masks.border(pixels, SIDE, SIDE), "vec_id", ["value"]).select("vec_id", F.round("bg_value", 6).alias("background"))


_RGB = f"""{_EDGE}, spread AS (SELECT vec_id, stddev_pop(sqrt(pow(value - background, 2))) AS s FROM edge JOIN bg USING (vec_id) GROUP BY vec_id),
    far AS (SELECT vec_id, count(*) AS n FROM pix JOIN bg USING (vec_id) WHERE sqrt(pow(value - background, 2)) > 0.15 GROUP BY vec_id)"""


@query(f"""WITH {_PIX}, {_RGB} SELECT vec_id, round(s, 6) AS border_std, coalesce(n, 0) AS foreground_pixel_count,
    CASE WHEN s > 0.08 THEN 'fondo no uniforme' WHEN coalesce(n, 0) < 10 THEN 'foreground insuficiente' END AS rejection_reason FROM spread LEFT JOIN far USING (vec_id)""")
def border_uniformity(spark, sf_dir):
    pixels = _pixels(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    _, verdict = masks.rgb_mask(pixels, "vec_id", ["value"], SIDE, SIDE, 0.08, 0.15, 10)
    return verdict.select("vec_id", F.round("border_std", 6).alias("border_std"), "foreground_pixel_count", "rejection_reason")


@query("""WITH c AS (SELECT vec_id, embedding[1] AS a, [embedding[1], embedding[8], embedding[57], embedding[64]] AS k, label FROM embeddings)
    SELECT vec_id, CASE WHEN label = 0 THEN 'TRANSPARENT_ALPHA' WHEN list_max([abs(v::DOUBLE - a::DOUBLE) FOR v IN k]) <= 0.12 THEN 'UNIFORM_RGB' ELSE 'COMPLEX' END AS background_mode FROM c""")
def background_mode(spark, sf_dir):
    v = F.col("embedding")
    corner = F.posexplode(F.array(*[F.get(v, F.lit(k)).cast("double") for k in (0, 7, 56, 63)])).alias("corner", "value")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") == 0, 0).otherwise(255).alias("low_alpha"), corner)
    return masks.background_mode(rows, "vec_id", ["value"], 0.12)


def _labels(spark, sf_dir):
    lines = bbox_yolo_line(spark, sf_dir).select(F.col("vec_id").cast("string").alias("source_asset_id"), boxes.parsed_label(F.col("label_line")).alias("b"))
    return lines.select("source_asset_id", "b.*")


@query(f"WITH {_PIX} SELECT count(*) AS labels, count(*) FILTER (WHERE NOT (xc BETWEEN 0 AND 1 AND yc BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1)) AS invalid_boxes, CAST(0 AS BIGINT) AS not_exactly_one FROM line")
def yolo_invariants(spark, sf_dir):
    return quality.label_invariants(_labels(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans_left(spark, sf_dir):
    found = quality.orphans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")
    return found.where("side = 'image'").select("doc_id")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def orphans_right(spark, sf_dir):
    found = quality.orphans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")
    return found.where("side = 'label'").select("doc_id")


@query(f"""WITH {_PIX}, g AS (SELECT e.vec_id, label, b.vec_id IS NULL AS empty FROM embeddings e LEFT JOIN box b ON b.vec_id = e.vec_id), x AS (SELECT doc_id // 3 AS sku FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 10 < 8) > 1)
    SELECT *, rejected_without_reason + bad_background + invalid_boxes + orphans + cross_split = 0 AS passed FROM (SELECT (SELECT count(*) FROM g WHERE empty AND label % 2 = 0) AS rejected_without_reason, (SELECT count(*) FROM g WHERE NOT empty AND label = 3) AS bad_background,
    (SELECT count(*) FROM line WHERE vec_id % 11 = 0) AS invalid_boxes, (SELECT count(*) FROM g WHERE empty) AS orphans, (SELECT count(*) FROM x) AS cross_split)""")
def quality_gate(spark, sf_dir):
    """Every rule has something to find: reasons left out, complex grounds, labels of another class, orphans, ids in two splits."""
    found = read(spark, sf_dir, "embeddings").join(_extremes(spark, sf_dir).select("vec_id", "x_min"), "vec_id", "left")
    empty = F.col("x_min").isNull()
    reason = F.when(empty & (F.col("label") % 2 == 1), "vacía").otherwise("")
    audit = found.select(F.when(empty, "rejected").otherwise("accepted").alias("status"), reason.alias("rejection_reason"), F.when(F.col("label") == 3, "COMPLEX").otherwise("UNIFORM_RGB").alias("background_mode"))
    labels = _labels(spark, sf_dir).withColumn("class", F.when(F.col("source_asset_id").cast("bigint") % 11 == 0, 1).otherwise(F.col("class")))
    orphan_rows = quality.orphans(found.select(F.col("vec_id").cast("string").alias("stem")), labels.select(F.col("source_asset_id").alias("stem")))
    split = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("sku_id"), F.when(F.col("doc_id") % 10 < 8, "train").otherwise("val").alias("split"))
    return quality.gate(audit, labels, orphan_rows, splits.leakage(split, ["sku_id"]))


# --- groups and splits -----------------------------------------------------------------------------------


def _manifest(spark, sf_dir):
    c = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(c.alias("row_idx"), F.floor(c / 3).cast("string").alias("sku_id"), c.cast("string").alias("source_asset_id"), identity.duplicate_group_id(F.col("text")).alias("duplicate_group_id"))


_COMP = """m AS MATERIALIZED (SELECT doc_id AS row_idx, doc_id // 3 AS sku, sha256(text) AS dup FROM documents),
    e AS MATERIALIZED (SELECT a.row_idx AS a, min(b.row_idx) AS b FROM m a JOIN m b ON a.sku = b.sku GROUP BY a.row_idx UNION SELECT a.row_idx, min(b.row_idx) FROM m a JOIN m b ON a.dup = b.dup GROUP BY a.row_idx),
    duo AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach(a, b) AS (SELECT a, b FROM duo UNION SELECT r.a, x.b FROM reach r JOIN duo x ON r.b = x.a),
    comp AS MATERIALIZED (SELECT a AS row_idx, min(b) AS grp FROM reach GROUP BY a)"""


@query(f'WITH RECURSIVE {_COMP} SELECT row_idx, grp AS "group" FROM comp')
def component_groups(spark, sf_dir):
    return splits.groups(_manifest(spark, sf_dir))


_SPLIT = f"""{_COMP}, sized AS (SELECT grp, count(*) AS n, row_number() OVER (ORDER BY sha256('42|' || grp)) AS k FROM comp GROUP BY grp), total AS (SELECT sum(n)::DOUBLE AS t FROM sized),
    walk(k, grp, s, a, b, c) AS (
        SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST('' AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
        UNION ALL SELECT k, grp, s, a + CASE WHEN s = 'train' THEN n ELSE 0 END, b + CASE WHEN s = 'val' THEN n ELSE 0 END, c + CASE WHEN s = 'test' THEN n ELSE 0 END FROM (
            SELECT z.k, z.grp, z.n, w.a, w.b, w.c, CASE WHEN 0.7::DOUBLE * t - w.a >= 0.15::DOUBLE * t - w.b AND 0.7::DOUBLE * t - w.a >= 0.15::DOUBLE * t - w.c THEN 'train' WHEN 0.15::DOUBLE * t - w.b >= 0.15::DOUBLE * t - w.c THEN 'val' ELSE 'test' END AS s
            FROM walk w JOIN sized z ON z.k = w.k + 1 CROSS JOIN total)),
    split AS (SELECT row_idx, s AS split FROM comp JOIN walk USING (grp))"""


@query(f"WITH RECURSIVE {_SPLIT} SELECT row_idx, split FROM split")
def split_assign_hash(spark, sf_dir):
    return splits.make_splits(_manifest(spark, sf_dir), order="hash").select("row_idx", "split")


@query(f"WITH RECURSIVE {_SPLIT} SELECT split, count(*) AS n FROM split GROUP BY split")
def split_counts(spark, sf_dir):
    return split_assign_hash(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_SPLIT} SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test,
    CAST(0 AS BIGINT) AS violations_sku_id, CAST(0 AS BIGINT) AS violations_source_asset_id, CAST(0 AS BIGINT) AS violations_duplicate_group_id, true AS cero_leakage, true AS all_splits_non_empty FROM split""")
def leakage_report(spark, sf_dir):
    return splits.leakage_report(splits.make_splits(_manifest(spark, sf_dir), order="hash"))


@query()
def split_assign_compat(spark, sf_dir):
    """The Mersenne Twister order, which SQL cannot express; tests hold it against a known result."""
    return splits.make_splits(_manifest(spark, sf_dir), order="mersenne").select("row_idx", "split")


_NAIVE = "naive AS (SELECT doc_id, sha256(text) AS dup, source, CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM documents)"


def _naive(spark, sf_dir):
    k = F.col("doc_id") % 20
    return read(spark, sf_dir, "documents").select("doc_id", identity.duplicate_group_id(F.col("text")).alias("duplicate_group_id"), "source", F.when(k < 14, "train").when(k < 17, "val").otherwise("test").alias("split"))


@query(f"WITH {_NAIVE} SELECT 'duplicate_group_id' AS dimension, dup AS value, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM naive GROUP BY dup HAVING count(DISTINCT split) > 1")
def leakage_duplicates(spark, sf_dir):
    return splits.leakage(_naive(spark, sf_dir), ["duplicate_group_id"]).withColumn("splits", F.array_join("splits", ","))


@query(f"WITH {_NAIVE} SELECT 'source' AS dimension, source AS value, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM naive GROUP BY source HAVING count(DISTINCT split) > 1")
def leakage_sources(spark, sf_dir):
    return splits.leakage(_naive(spark, sf_dir), ["source"]).withColumn("splits", F.array_join("splits", ","))


# --- detections ------------------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    """image, line, nth, first: an order's lines in order, each with its number and the first of them.

    A line is one struct that is the sort key too, so no branch of a plan prunes it, and boxes and predictions read one
    shuffle. Numbers are running counts, since a limit on row_number would be applied before that shuffle.
    """
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag")
    so_far = Window.partitionBy("image").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), line.alias("line"))
    return lines.select("image", "line", F.count("*").over(so_far).cast("int").alias("nth"), F.first("line").over(so_far).alias("first"))


def _detections(spark, sf_dir):
    """(ground truth: the first line of each order; predictions: all its lines, moved and scaled by tax and discount)."""
    c = F.col
    base = [(0.3 + 0.4 * c("first.l_quantity") / 50).alias("cx"), (0.2 + c("first.l_discount")).alias("w")]
    lines = _lines(spark, sf_dir).select("image", c("nth").alias("pred_idx"), *[f"line.{n}" for n in ("l_quantity", "l_discount", "l_tax", "l_returnflag")], *base)
    gt = lines.where("pred_idx = 1").select("image", F.lit(0).alias("gt_idx"), F.lit(0).alias("cls"), "cx", "w")
    pred = lines.where("image IS NOT NULL").select("image", "pred_idx", F.lit(0).alias("cls"), (c("l_quantity") / 50).alias("conf"), "l_returnflag", (c("cx") + c("l_tax") - 0.04).alias("cx"), (0.5 + (c("l_discount") - 0.05) * 2).alias("cy"), (c("w") * (1 + c("l_tax"))).alias("w"))
    corner = lambda cy: boxes.corners(c("cx"), cy, c("w"), F.lit(0.3), F.lit(100), F.lit(100))
    gt = gt.select("image", "gt_idx", "cls", *[x.alias(n) for x, n in zip(corner(F.lit(0.5)), evaluation.GT)])
    pred = pred.select("image", "pred_idx", "cls", "conf", "l_returnflag", *[x.alias(n) for x, n in zip(corner(c("cy")), evaluation.PRED)])
    return gt, pred


_DET = """lines AS (SELECT l_orderkey AS image, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS pred_idx, l_quantity, l_discount, l_tax, l_returnflag FROM lineitem),
    first AS (SELECT * FROM lines WHERE pred_idx = 1),
    base AS (SELECT image, 0.3::DOUBLE + 0.4::DOUBLE * l_quantity / 50 AS cx, 0.2::DOUBLE + l_discount AS w FROM first),
    gt AS (SELECT image, 0 AS gt_idx, (cx - w / 2) * 100 AS g0, (0.5::DOUBLE - 0.3::DOUBLE / 2) * 100 AS g1, (cx + w / 2) * 100 AS g2, (0.5::DOUBLE + 0.3::DOUBLE / 2) * 100 AS g3 FROM base),
    moved AS (SELECT l.image, pred_idx, l_quantity / 50 AS conf, l_returnflag, b.cx + l_tax - 0.04::DOUBLE AS cx, 0.5::DOUBLE + (l_discount - 0.05::DOUBLE) * 2 AS cy, b.w * (1 + l_tax) AS w FROM lines l JOIN base b USING (image)),
    pred AS (SELECT image, pred_idx, conf, l_returnflag, (cx - w / 2) * 100 AS p0, (cy - 0.3::DOUBLE / 2) * 100 AS p1, (cx + w / 2) * 100 AS p2, (cy + 0.3::DOUBLE / 2) * 100 AS p3 FROM moved),
    wide AS (SELECT *, greatest(0, least(g2, p2) - greatest(g0, p0)) * greatest(0, least(g3, p3) - greatest(g1, p1)) AS i, (g2 - g0) * (g3 - g1) + (p2 - p0) * (p3 - p1) AS s FROM gt JOIN pred USING (image)),
    pairs AS (SELECT image, gt_idx, pred_idx, conf, l_returnflag, CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END AS iou FROM wide),
    hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, gt_idx ORDER BY iou DESC, pred_idx) AS k FROM pairs WHERE iou > 0) WHERE k = 1 AND iou >= 0.5),
    examples AS (SELECT CAST(image AS VARCHAR) AS source_asset_id, 'correcto' AS categoria, conf AS confianza, round_even(iou, 4) AS iou FROM hit
        UNION ALL SELECT CAST(image AS VARCHAR), 'omision', NULL, 0 FROM gt WHERE image NOT IN (SELECT image FROM hit)
        UNION ALL SELECT CAST(p.image AS VARCHAR), 'falso_positivo', p.conf, 0 FROM pred p LEFT JOIN hit h ON h.image = p.image AND h.pred_idx = p.pred_idx WHERE h.image IS NULL)"""
_PRF = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall"
_COUNTS = "CAST(count(*) FILTER (WHERE categoria = 'correcto') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE categoria = 'falso_positivo') AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE categoria = 'omision') AS BIGINT) AS fn"


@query(f"WITH {_DET} SELECT image, round(g0, 6) AS x0, round(g1, 6) AS y0, round(g2, 6) AS x1, round(g3, 6) AS y1 FROM gt")
def yolo_to_xyxy(spark, sf_dir):
    gt, _ = _detections(spark, sf_dir)
    return gt.select("image", *[F.round(c, 6).alias(n) for c, n in zip(evaluation.GT, ("x0", "y0", "x1", "y1"))])


@query(f"WITH {_DET} SELECT image, pred_idx, round(iou, 6) AS iou FROM pairs")
def iou_pairs(spark, sf_dir):
    return evaluation.overlaps(*_detections(spark, sf_dir)).select("image", "pred_idx", F.round("iou", 6).alias("iou"))


@query(f"WITH {_DET} SELECT image, pred_idx, round(iou, 6) AS iou FROM hit")
def match_single_gt(spark, sf_dir):
    return evaluation.match_single(*_detections(spark, sf_dir)).select("image", "pred_idx", F.round("iou", 6).alias("iou"))


@query(f"WITH {_DET} SELECT image, pred_idx, round(iou, 6) AS iou FROM hit")
def match_greedy(spark, sf_dir):
    return evaluation.match_greedy(*_detections(spark, sf_dir)).select("image", "pred_idx", F.round("iou", 6).alias("iou"))


def _examples(spark, sf_dir):
    gt, pred = _detections(spark, sf_dir)
    return evaluation.examples(gt, pred, evaluation.match_single(gt, pred)).drop("hipotesis")


@query(f"WITH {_DET} SELECT categoria, count(*) AS n FROM examples GROUP BY categoria")
def error_categories(spark, sf_dir):
    return _examples(spark, sf_dir).groupBy("categoria").agg(F.count("*").alias("n"))


@query(f"WITH {_DET}, k AS (SELECT {_COUNTS} FROM examples), pr AS (SELECT *, {_PRF} FROM k) SELECT tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM pr")
def prf1(spark, sf_dir):
    out = evaluation.precision_recall(_examples(spark, sf_dir))
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_DET}, g AS (SELECT *, CAST(source_asset_id AS BIGINT) % 5 AS grp FROM examples), k AS (SELECT grp, {_COUNTS} FROM g GROUP BY grp), pr AS (SELECT *, {_PRF} FROM k) SELECT grp, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM pr")
def prf1_by_group(spark, sf_dir):
    out = evaluation.precision_recall(_examples(spark, sf_dir).withColumn("grp", F.col("source_asset_id").cast("bigint") % 5), ["grp"])
    return out.select("grp", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


_CURVE = f"""{_DET}, thr AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS threshold),
    fp1 AS (SELECT threshold, image, pred_idx FROM (SELECT *, row_number() OVER (PARTITION BY threshold, image ORDER BY conf DESC, pred_idx) AS k FROM pairs, thr WHERE iou >= threshold) WHERE k = 1),
    sc AS (SELECT t.threshold, p.conf, CASE WHEN f.image IS NULL THEN 0 ELSE 1 END AS tp FROM pred p CROSS JOIN thr t LEFT JOIN fp1 f ON f.threshold = t.threshold AND f.image = p.image AND f.pred_idx = p.pred_idx),
    pt AS (SELECT threshold, conf, sum(tp) AS tp, count(*) AS n FROM sc GROUP BY threshold, conf),
    run AS (SELECT threshold, conf, sum(tp) OVER w AS rtp, sum(n) OVER w AS rn FROM pt WINDOW w AS (PARTITION BY threshold ORDER BY conf DESC)),
    pr AS (SELECT threshold, conf, rtp / (SELECT count(*) FROM gt)::DOUBLE AS recall, rtp / rn::DOUBLE AS precision FROM run),
    env AS (SELECT *, max(precision) OVER (PARTITION BY threshold ORDER BY conf) AS envelope FROM pr),
    st AS (SELECT threshold, recall, max(envelope) AS high FROM env GROUP BY threshold, recall),
    ap AS (SELECT threshold, sum((recall - prev) * high) AS ap FROM (SELECT *, coalesce(lag(recall) OVER (PARTITION BY threshold ORDER BY recall), 0) AS prev FROM st) GROUP BY threshold)"""


def _aps(spark, sf_dir, method):
    gt, pred = _detections(spark, sf_dir)
    return evaluation.average_precision(evaluation.curve(evaluation.true_positives(gt, pred, evaluation.THRESHOLDS), gt), method)


@query(f"WITH {_CURVE} SELECT threshold, round(recall, 6) AS recall, round(precision, 6) AS precision, round(envelope, 6) AS envelope FROM env")
def precision_recall_curve(spark, sf_dir):
    gt, pred = _detections(spark, sf_dir)
    return evaluation.curve(evaluation.true_positives(gt, pred, evaluation.THRESHOLDS), gt).select("threshold", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "envelope")])


@query(f"WITH {_CURVE} SELECT threshold, round(ap, 6) AS ap FROM ap")
def ap_at_iou(spark, sf_dir):
    return _aps(spark, sf_dir, "exact").select("threshold", F.round("ap", 6).alias("ap"))


@query(f"WITH {_CURVE} SELECT round(max(ap) FILTER (WHERE threshold = 0.5), 6) AS map50, round(max(ap) FILTER (WHERE threshold = 0.75), 6) AS map75, round(avg(ap), 6) AS map50_95 FROM ap")
def map_50_95(spark, sf_dir):
    out = evaluation.mean_average_precision(_aps(spark, sf_dir, "exact"), _detections(spark, sf_dir)[0])
    return out.select(*[F.round(c, 6).alias(c) for c in ("map50", "map75", "map50_95")])


@query(f"""WITH {_CURVE}, grid AS (SELECT unnest(generate_series(0, 100)) AS k) SELECT threshold, round(sum(v) / 101, 6) AS ap FROM (
    SELECT t.threshold, g.k, coalesce(max(s.high), 0) AS v FROM thr t CROSS JOIN grid g LEFT JOIN st s ON s.threshold = t.threshold AND s.recall * 100 >= g.k - 1e-9 GROUP BY t.threshold, g.k) GROUP BY threshold""")
def ap_coco101(spark, sf_dir):
    return _aps(spark, sf_dir, "coco101").select("threshold", F.round("ap", 6).alias("ap"))


@query(f"""WITH {_CURVE}, grid AS (SELECT unnest(generate_series(0, 100)) AS k), lo AS (SELECT threshold, recall, max(envelope) AS high, min(envelope) AS low FROM env GROUP BY threshold, recall),
    near AS (SELECT t.threshold, g.k, g.k / 100.0::DOUBLE AS r, min(s.low) FILTER (WHERE abs(s.recall - g.k / 100.0::DOUBLE) < 1e-9) AS here,
        coalesce(max(s.recall) FILTER (WHERE floor(s.recall * 100 + 1e-9) < g.k), 0) AS r0, coalesce(arg_max(s.low, s.recall) FILTER (WHERE floor(s.recall * 100 + 1e-9) < g.k), 1) AS v0,
        coalesce(min(s.recall) FILTER (WHERE floor(s.recall * 100 + 1e-9) >= g.k), 1) AS r1, coalesce(arg_min(s.high, s.recall) FILTER (WHERE floor(s.recall * 100 + 1e-9) >= g.k), 0) AS v1
        FROM thr t CROSS JOIN grid g LEFT JOIN lo s ON s.threshold = t.threshold GROUP BY t.threshold, g.k)
    SELECT threshold, round(sum(CASE WHEN k IN (0, 100) THEN 0.005 ELSE 0.01 END * CASE WHEN k = 100 THEN 0 WHEN here IS NOT NULL THEN here WHEN r1 > r0 THEN v0 + (v1 - v0) * (r - r0) / (r1 - r0) ELSE v1 END), 6) AS ap FROM near GROUP BY threshold""")
def ap_trapz101(spark, sf_dir):
    """The interpolation that explains the published values."""
    return _aps(spark, sf_dir, "trapz101").select("threshold", F.round("ap", 6).alias("ap"))


# --- crowded images of two classes ------------------------------------------------------------------------


def _crowd(spark, sf_dir):
    """Up to three boxes and any number of predictions an order, of two classes, on a common grid so that overlaps tie."""
    c = F.col
    lines = _lines(spark, sf_dir).select("image", "nth", *[f"line.{n}" for n in ("l_quantity", "l_tax", "l_returnflag")])
    left = (c("l_quantity") % 5) * 8
    gt = lines.where("nth <= 3").select("image", c("nth").alias("gt_idx"), (c("nth") % 2).alias("cls"), left.alias("g0"), F.lit(0.0).alias("g1"), (left + 20).alias("g2"), F.lit(30.0).alias("g3"))
    left = left + F.round(c("l_tax") * 100) / 2 - 2
    cls = ((c("nth") + F.when(c("l_returnflag") == "R", 1).otherwise(0)) % 2).alias("cls")
    pred = lines.select("image", c("nth").alias("pred_idx"), cls, (c("l_quantity") / 50).alias("conf"), left.alias("p0"), F.lit(0.0).alias("p1"), (left + 20).alias("p2"), F.lit(30.0).alias("p3"))
    return gt, pred


_BEST = "SELECT image, gt_idx, pred_idx, conf, iou FROM (SELECT p.*, row_number() OVER (PARTITION BY image ORDER BY iou DESC, pred_idx) AS k FROM cpairs p {but} WHERE gt_idx = {g} AND iou > 0 {on}) WHERE k = 1 AND iou >= 0.5"
_CROWD = f"""clines AS (SELECT l_orderkey AS image, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS nth, l_quantity, l_tax, l_returnflag FROM lineitem),
    cgt AS (SELECT image, nth AS gt_idx, nth % 2 AS cls, (l_quantity % 5) * 8 AS g0 FROM clines WHERE nth <= 3),
    cpred AS (SELECT image, nth AS pred_idx, (nth + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) % 2 AS cls, l_quantity / 50 AS conf, (l_quantity % 5) * 8 + round(l_tax * 100) / 2 - 2 AS p0 FROM clines),
    cwide AS (SELECT g.image, gt_idx, pred_idx, conf, g.cls, p.cls AS pred_cls, greatest(0, 20 - abs(g0 - p0)) * 30 AS i FROM cgt g JOIN cpred p USING (image)),
    cpairs AS (SELECT *, i / (1200 - i)::DOUBLE AS iou FROM cwide),
    m1 AS ({_BEST.format(g=1, but="", on="")}),
    m2 AS ({_BEST.format(g=2, but="LEFT JOIN (SELECT image, pred_idx, 1 AS taken FROM m1) u USING (image, pred_idx)", on="AND taken IS NULL")}),
    m3 AS ({_BEST.format(g=3, but="LEFT JOIN (SELECT image, pred_idx, 1 AS taken FROM m1 UNION ALL SELECT image, pred_idx, 1 FROM m2) u USING (image, pred_idx)", on="AND taken IS NULL")}),
    cm AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"""


@query(f"WITH {_CROWD} SELECT image, gt_idx, pred_idx, round(iou, 6) AS iou FROM cm")
def match_crowded(spark, sf_dir):
    return evaluation.match_greedy(*_crowd(spark, sf_dir)).select("image", "gt_idx", "pred_idx", F.round("iou", 6).alias("iou"))


@query(f"WITH {_CROWD} SELECT categoria, count(*) AS n FROM (SELECT 'correcto' AS categoria FROM cm UNION ALL SELECT 'omision' FROM cgt ANTI JOIN cm USING (image, gt_idx) UNION ALL SELECT 'falso_positivo' FROM cpred ANTI JOIN cm USING (image, pred_idx)) GROUP BY categoria")
def crowded_error_categories(spark, sf_dir):
    gt, pred = _crowd(spark, sf_dir)
    return evaluation.examples(gt, pred, evaluation.match_greedy(gt, pred)).groupBy("categoria").agg(F.count("*").alias("n"))


_CROWD_CLASS = _CROWD.replace("FROM cwide)", "FROM cwide WHERE cls = pred_cls)")
_CLASS_COUNTS = f"""{_CROWD_CLASS}, cc AS (SELECT cls, CAST(sum(hit) AS BIGINT) AS tp, CAST(sum(made) - sum(hit) AS BIGINT) AS fp, CAST(sum(box) - sum(hit) AS BIGINT) AS fn FROM
    (SELECT cls, 1 AS box, 0 AS made, 0 AS hit FROM cgt UNION ALL SELECT cls, 0, 1, 0 FROM cpred UNION ALL SELECT cls, 0, 0, 1 FROM cm JOIN cgt USING (image, gt_idx)) GROUP BY cls),
    cpr AS (SELECT *, {_PRF} FROM cc), cf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM cpr)"""


@query(f"WITH {_CLASS_COUNTS} SELECT cls, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM cf")
def prf1_by_class(spark, sf_dir):
    return evaluation.class_metrics(*_crowd(spark, sf_dir)).select("cls", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_CLASS_COUNTS} SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM cf WHERE tp + fn > 0")
def prf1_mean(spark, sf_dir):
    return evaluation.mean_metrics(evaluation.class_metrics(*_crowd(spark, sf_dir))).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_CROWD_CLASS}, thr AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS threshold),
    goes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, pred_idx ORDER BY iou DESC, gt_idx) AS k FROM cpairs WHERE iou >= 0.5) WHERE k = 1),
    won AS (SELECT threshold, image, pred_idx FROM (SELECT *, row_number() OVER (PARTITION BY threshold, image, gt_idx ORDER BY conf DESC, pred_idx) AS r FROM goes, thr WHERE iou >= threshold) WHERE r = 1),
    pt AS (SELECT p.cls, t.threshold, p.conf, count(w.image) AS tp, count(*) AS n FROM cpred p CROSS JOIN thr t LEFT JOIN won w ON w.threshold = t.threshold AND w.image = p.image AND w.pred_idx = p.pred_idx GROUP BY ALL),
    run AS (SELECT cls, threshold, conf, sum(tp) OVER w AS rtp, sum(n) OVER w AS rn FROM pt WINDOW w AS (PARTITION BY cls, threshold ORDER BY conf DESC)),
    pr AS (SELECT r.cls, threshold, conf, rtp / b.boxes::DOUBLE AS recall, rtp / rn::DOUBLE AS precision FROM run r JOIN (SELECT cls, count(*) AS boxes FROM cgt GROUP BY cls) b ON b.cls = r.cls),
    env AS (SELECT *, max(precision) OVER (PARTITION BY cls, threshold ORDER BY conf) AS envelope FROM pr),
    st AS (SELECT cls, threshold, recall, max(envelope) AS high FROM env GROUP BY ALL),
    ap AS (SELECT cls, threshold, sum((recall - prev) * high) AS ap FROM (SELECT *, coalesce(lag(recall) OVER (PARTITION BY cls, threshold ORDER BY recall), 0) AS prev FROM st) GROUP BY ALL)
    SELECT round(avg(ap) FILTER (WHERE threshold = 0.5), 6) AS map50, round(avg(ap) FILTER (WHERE threshold = 0.75), 6) AS map75, round(avg(ap), 6) AS map50_95 FROM ap""")
def map_of_classes(spark, sf_dir):
    gt, pred = _crowd(spark, sf_dir)
    aps = evaluation.average_precision(evaluation.curve(evaluation.true_positives(gt, pred, evaluation.THRESHOLDS), gt), "exact")
    return evaluation.mean_average_precision(aps, gt).select(*[F.round(c, 6).alias(c) for c in ("map50", "map75", "map50_95")])


def _twentieths(df: DataFrame) -> DataFrame:
    """Overlaps in whole twentieths: engines round decimal ties of doubles differently."""
    return df.select("source_asset_id", "categoria", "confianza", F.floor(F.col("iou") * 20 + F.lit(1e-6)).alias("iou_twentieths"))


@query(f"WITH {_DET} SELECT source_asset_id, categoria, confianza, CAST(floor(iou * 20 + 1e-6) AS BIGINT) AS iou_twentieths FROM examples WHERE categoria = 'correcto' ORDER BY confianza DESC, source_asset_id, iou LIMIT 15")
def examples_top_correct(spark, sf_dir):
    return _twentieths(evaluation.select_examples(_examples(spark, sf_dir))[0])


@query(f"WITH {_DET} SELECT source_asset_id, categoria, confianza, CAST(floor(iou * 20 + 1e-6) AS BIGINT) AS iou_twentieths FROM examples WHERE categoria <> 'correcto' ORDER BY source_asset_id, categoria, confianza LIMIT 15")
def examples_top_errors(spark, sf_dir):
    return _twentieths(evaluation.select_examples(_examples(spark, sf_dir))[1])


@query(f"WITH {_DET} SELECT source_asset_id, categoria, confianza, CAST(floor(iou * 20 + 1e-6) AS BIGINT) AS iou_twentieths FROM examples WHERE categoria = 'correcto' ORDER BY iou, source_asset_id, confianza LIMIT 15")
def hardest_correct(spark, sf_dir):
    return _twentieths(evaluation.hardest(_examples(spark, sf_dir)))


@query(f"WITH {_DET} SELECT source_asset_id, categoria, confianza, CAST(floor(iou * 20 + 1e-6) AS BIGINT) AS iou_twentieths FROM examples")
def union_examples(spark, sf_dir):
    return _twentieths(_examples(spark, sf_dir))


@query("SELECT vec_id, CASE label WHEN 0 THEN 'product' WHEN 1 THEN 'box' ELSE CAST(label AS VARCHAR) END AS name FROM embeddings")
def class_names(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", boxes.class_name(["product", "box"], F.col("label")).alias("name"))


# --- counts, sets, time ----------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_stems(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").subtract(read(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT round(coalesce(avg(value), 0), 6) AS mean_ms, count(*) AS n FROM events")
def mean_latency(spark, sf_dir):
    return read(spark, sf_dir, "events").agg(F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean_ms"), F.count("*").alias("n"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark, sf_dir):
    return tumbling_counts(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT url FROM pages ORDER BY url, page_id LIMIT 20")
def sorted_prefix(spark, sf_dir):
    return read(spark, sf_dir, "pages").orderBy("url", "page_id").limit(20).select("url")


@query("""WITH s AS (SELECT doc_id // 3 AS sku_id, doc_id AS source_asset_id, sha256(text) AS duplicate_group_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM documents)
    SELECT *, violations_sku_id + violations_source_asset_id + violations_duplicate_group_id = 0 AS cero_leakage, n_train > 0 AND n_val > 0 AND n_test > 0 AS all_splits_non_empty FROM
    (SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test,
        (SELECT count(*) FROM (SELECT 1 FROM s GROUP BY sku_id HAVING count(DISTINCT split) > 1)) AS violations_sku_id, (SELECT count(*) FROM (SELECT 1 FROM s GROUP BY source_asset_id HAVING count(DISTINCT split) > 1)) AS violations_source_asset_id,
        (SELECT count(*) FROM (SELECT 1 FROM s GROUP BY duplicate_group_id HAVING count(DISTINCT split) > 1)) AS violations_duplicate_group_id FROM s)""")
def leakage_report_of_a_bad_split(spark, sf_dir):
    """Rows dealt one by one, so that groups are torn."""
    nth = F.col("row_idx") % 10
    return splits.leakage_report(_manifest(spark, sf_dir).withColumn("split", F.when(nth < 7, "train").when(nth == 7, "val").otherwise("test")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content identity, connected groups, split, leakage report: the whole chain."""
    return splits.leakage_report(splits.make_splits(_manifest(spark, sf_dir), order="hash"))


__all__ = ["ORACLES", "QUERIES", "components", "flagship"]
