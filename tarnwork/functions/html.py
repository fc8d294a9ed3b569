"""Links, title, metadata, images and text of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.functions.urls import image_of

PARSED = "links array<string>, meta map<string,string>, images array<struct<url:string,alt:string>>, title string, text string"


def link_list(html: Column) -> Column:
    """Values of ``<a href="...">`` in page order (regular markup only; ``parse`` reads any)."""
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1), r"\s+", " "))


def charset(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r'<meta charset="([^"]*)"', 1))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.links, self.meta, self.images, self.words, self.titles, self.inside = [], {}, [], [], [], 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "meta" and (a.get("property") or a.get("name")):
            self.meta[(a.get("property") or a["name"]).lower()] = a.get("content", "")
        elif tag == "img":
            self.images.append({"url": a.get("src") or a.get("data-src", ""), "alt": a.get("alt", "")})
        self.inside += tag == "title"

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.inside -= tag == "title" and self.inside > 0

    def handle_data(self, data):
        words = data.split()
        if words:
            (self.titles if self.inside else self.words).extend(words)


def read(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    return {"links": page.links, "meta": page.meta, "images": page.images, "title": " ".join(page.titles), "text": " ".join(page.words)}


def parse(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with columns links, meta, images, title and text of their html, in place of it."""
    keep = [c for c in pages.columns if c != html_col]
    schema = ", ".join(f"{n} {t}" for n, t in pages.select(*keep).dtypes) + ", " + PARSED

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat([batch[keep].reset_index(drop=True), pd.DataFrame([read(h) for h in batch[html_col]], columns=["links", "meta", "images", "title", "text"])], axis=1)

    return pages.mapInPandas(run, schema)


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def product_metadata(parsed: DataFrame, url_col: str = "url") -> DataFrame:
    """Name, description, sku, image address and, where one is missing, the first reason why.

    ``parsed`` has the columns of ``parse`` and the page's address and html (for a sku in its data).
    """
    from tarnwork.functions.urls import last_segment_sku

    meta = lambda k: F.try_element_at("meta", F.lit(k))
    name = F.trim(F.replace(F.coalesce(_filled(meta("og:title")), F.col("title"), F.lit("")), F.lit(" — Amarket"), F.lit("")))
    out = parsed.withColumn("product_name", name)
    out = out.withColumn("description", F.coalesce(_filled(meta("og:description")), _filled(meta("description")), F.lit("")))
    inner = F.regexp_extract("html", r'"sku"\s*:\s*"([A-Za-z0-9._-]+)"', 1) if "html" in parsed.columns else F.lit("")
    out = out.withColumn("sku_id", F.coalesce(_filled(last_segment_sku(F.col(url_col))), inner))
    # candidates in order: three meta keys, images whose text names the product, all images
    named = F.filter("images", lambda i: (F.length("product_name") > 0) & F.contains(F.lower(i["alt"]), F.lower(F.col("product_name"))))
    keys = F.array(*[F.coalesce(meta(k), F.lit("")) for k in ("og:image:secure_url", "og:image", "twitter:image")])
    candidates = F.filter(F.concat(keys, F.transform(named, lambda i: i["url"]), F.transform("images", lambda i: i["url"])), lambda u: F.length(u) > 0)
    out = out.withColumn("image_url", first_image(candidates, F.col(url_col)))
    reason = F.when(F.length("product_name") == 0, "PRODUCT_NAME_MISSING").when(F.length("sku_id") == 0, "SKU_MISSING").when(F.col("image_url").isNull(), "IMAGE_MISSING")
    return out.withColumn("metadata_reason", reason)


@F.pandas_udf(T.StringType())
def first_image(candidates: pd.Series, page: pd.Series) -> pd.Series:
    """The first candidate that is an address of the shop's own images."""
    found = [next((u for u in (image_of(x, p) for x in ([] if c is None else c)) if u), None) for c, p in zip(candidates, page)]
    return pd.Series(found, dtype=object)


def next_page(links: DataFrame, page: str = "page_url", link: str = "link") -> DataFrame:
    """For each collection page the link to the least later page of the same host and path (the first, on a tie).

    ``links`` has page_url, pos and link (absolute).
    """
    from tarnwork.functions.urls import host, page_number, without_query

    now = F.coalesce(page_number(F.col(page)), F.lit(1))
    there = page_number(F.col(link))
    path = lambda c: F.regexp_replace(without_query(F.col(c)), r"^[^/]*//[^/]*", "")
    same = (host(F.col(page)) == host(F.col(link))) & F.col(link).startswith("https://") & (path(page) == path(link)) & (there > now)
    return links.where(same).groupBy(page).agg(F.min_by(link, F.struct(there, "pos")).alias("next_url"))
