"""Structured records and links from raw pages (O-19, O-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import html as H
from vitrine.operators.partitioning import spread_small

# The selectors of a catalogue detail page (fixed values).
CATALOGUE_SPEC = {
    "name": ("text", "h1", "h3"),
    "series": ("anchor", "/series/"),
    "rarity": ("classes", "span", ["badge", "rarity"]),
    "origin": ("anchor", "/origin/"),
    "edition": ("table", "table table-bordered", "Edition"),
    "release_date": ("table", "table table-bordered", "Release Date"),
    "original_price": ("table", "table table-bordered", "Original Price"),
    "sku": ("table", "table table-bordered", "SKU"),
    "description": ("block", ("div", "card-body"), "h5", "Pin Description:"),
    "image_url": ("attr", "img", "src", "img-fluid m-auto"),
    "tags": ("texts", "a", "badge rounded-pill bg-secondary"),
}
# Where a listing page keeps the links to its items (fixed values).
LISTING_PATH = [("div", "pin-card"), ("div", "card-body"), ("h5", "card-title")]


def listing_links(
    pages: DataFrame,
    page: str,
    path: list[tuple[str, str | None]] = (),
    base: str | None = None,
) -> DataFrame:
    """O-19: ``(page, item, href)``, one row per link; anchors without href are skipped.

    With no ``path`` every anchor counts; with ``base`` hrefs are resolved against it.
    """
    hrefs = H.hrefs_below(F.col("html"), list(path), base)
    return spread_small(pages).select(page, F.posexplode(hrefs).alias("item", "href"))


def listing_counts(
    pages: DataFrame, page: str, path: list[tuple[str, str | None]] = ()
) -> DataFrame:
    """O-19, O-41: ``(page, n_links)`` for every page, 0 where it lists nothing."""
    found = F.size(F.coalesce(H.hrefs_below(F.col("html"), list(path)), F.array()))
    return spread_small(pages).select(page, found.cast("long").alias("n_links"))


def extract_records(
    pages: DataFrame, spec: dict[str, tuple] = CATALOGUE_SPEC, keep: tuple[str, ...] = ()
) -> DataFrame:
    """O-20: one record per page from a mapping of column name to a rule of ``html.fields``.

    All fields come from one parse of the page. A page that lacks a field gives NULL there,
    so no page can fail another.
    """
    found = spread_small(pages).select(*keep, H.fields(F.col("html"), spec).alias("_fields"))
    return found.select(*keep, *(F.col(f"_fields.`{name}`").alias(name) for name in spec))
