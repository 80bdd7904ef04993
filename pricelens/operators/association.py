"""Housing-association pages and outcome probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions import text as tx


def association_page_facts(pages: DataFrame) -> DataFrame:
    """Association pages (``brf_slug``, ``url``, ``body``, ``heading``) -> one fact row each."""
    body = F.col("body")
    streets = F.regexp_extract_all(body, F.lit(fv.STREET_ADDRESS), F.lit(1))
    numbers = F.regexp_extract_all(body, F.lit(fv.STREET_ADDRESS), F.lit(2))
    genuine = F.when(F.regexp_like(body, F.lit(fv.NON_GENUINE_TEXT)), False).when(
        F.regexp_like(body, F.lit(fv.GENUINE_TEXT)), True
    )
    return pages.select(
        "brf_slug",
        "url",
        F.nullif(tx.squash("heading"), F.lit("")).alias("forening"),
        (~F.regexp_like(body, F.lit("(?iu)tomträtt"))).alias("brf_ager_marken"),
        genuine.alias("brf_akta"),
        tx.capture(body, fv.APARTMENT_COUNT).try_cast("int").alias("brf_n_lgh"),
        tx.capture(body, fv.FOUNDED_YEAR).try_cast("int").alias("brf_byggar"),
        F.replace(tx.capture(body, fv.FEE_PER_M2, 2), F.lit(" "), F.lit(""))
        .try_cast("int")
        .alias("brf_arsavgift_kr_m2"),
        tx.capture(body, fv.FEE_PER_M2, 1).try_cast("int").alias("brf_arsavgift_kr_m2_year"),
        F.array_sort(
            F.array_distinct(F.zip_with(streets, numbers, lambda s, n: F.concat_ws(" ", s, n)))
        ).alias("addresses"),
    )


def linked_association(hrefs: Column | str, own_slug: Column | str, host: str) -> Column:
    """First association slug among the tab links of an address page, own slug excluded."""
    pattern = host.replace(".", r"\.") + r"/([^/]+)/(?:" + fv.ASSOCIATION_TABS + r")\b"
    slugs = F.transform(tx.col(hrefs), lambda h: F.regexp_extract(h, pattern, 1))
    return F.get(F.filter(slugs, lambda s: (s != "") & (s != tx.col(own_slug))), F.lit(0))


def resolve_address_pages(pages: DataFrame, host: str, keep: list[str] | None = None) -> DataFrame:
    """Address pages (``addr_slug``, ``body``, ``hrefs``) -> (addr_slug, brf_slug, orgnr);
    both null for missing pages and pages without a foreign tab link."""
    missing = F.col("body").contains(fv.PAGE_NOT_FOUND) | F.substring("body", 1, 200).contains("404")
    slug = F.when(~missing, linked_association("hrefs", "addr_slug", host))
    return pages.select(
        *(keep or []),
        "addr_slug",
        slug.alias("brf_slug"),
        F.when(slug.isNotNull(), tx.capture("body", fv.ORG_NUMBER)).alias("orgnr"),
    )


def final_price(body: Column | str) -> Column:
    """Final price in page text; null unless the figure is digits and spaces only."""
    digits = F.translate(tx.capture(body, fv.PROBE_FINAL_PRICE), f"{tx.NBSP} ", "")
    return F.when(F.regexp_like(digits, F.lit(r"^\d+$")), digits.try_cast("bigint"))


def probe_signals(probes: DataFrame) -> DataFrame:
    """Probe pages -> outcome per probe: sold, withdrawn or nothing conclusive.

    A sold page's price comes from the linked sold page when there is a link, else from
    the probed page itself.
    """
    landed_on_sold = F.col("final_url").contains(fv.SOLD_PATH)
    sold = (
        landed_on_sold
        | F.coalesce(F.col("body").contains("har sålts"), F.lit(False))
        | F.coalesce(F.col("body").contains("Slutpris"), F.lit(False))
    )
    sold = F.coalesce(sold, F.lit(False))
    removed = tx.removal_date("body")
    link = F.when(landed_on_sold, F.col("final_url")).otherwise(F.col("salda_url"))
    price = F.when(link.isNotNull(), final_price("salda_body")).otherwise(final_price("body"))
    outcome = F.when(sold, "sold").when(removed.isNotNull(), "withdrawn")
    return probes.select(
        "id",
        "probe_date",
        outcome.alias("outcome"),
        removed.alias("removed_on"),
        F.when(sold, link).alias("sold_url"),
        F.when(sold, price).alias("sold_price_kr"),
    )
