"""List cards: captured card text -> typed listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions import text as tx
from pricelens.operators.dedupe import first_seen


def _first(lines: Column, predicate) -> Column:
    return F.get(F.filter(lines, predicate), F.lit(0))


def _first_index(lines: Column, predicate) -> Column:
    """0-based index of the first line that satisfies the predicate, null when none does."""
    flags = F.transform(lines, predicate)
    return F.nullif(F.array_position(flags, F.lit(True)), F.lit(0)) - 1


def _tail(lines: Column, start: Column) -> Column:
    """Lines from a 0-based start to the end."""
    return F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))


def _matches(pattern: str):
    return lambda line: F.regexp_like(line, F.lit(pattern))


def find_in_lines(lines: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first single line that matches; never spans lines."""
    return tx.capture(_first(lines, _matches(pattern)), pattern, group)


def card_lines(text: Column | str) -> Column:
    """Trimmed, non-blank lines without the map overlay line."""
    lines = F.transform(F.split(tx.col(text), "\n"), tx.squash)
    return F.filter(lines, lambda line: (line != "") & ~line.startswith("Maps Data"))


def last_plain_line(lines: Column, excluded: str, tags: list[str] | None = None) -> Column:
    """Last line that does not match ``excluded`` and is no tag."""

    def plain(line: Column) -> Column:
        keep = ~F.regexp_like(line, F.lit(excluded))
        return keep & ~line.isin(tags) if tags else keep

    return F.try_element_at(F.filter(lines, plain), F.lit(-1))


def longest_free_line(lines: Column, min_chars: int = fv.MIN_DESCRIPTION_CHARS) -> Column:
    """Longest line above ``min_chars`` that is neither tag nor structured; first on ties."""

    def free(line: Column) -> Column:
        return (
            (F.length(line) > min_chars)
            & ~line.isin(fv.PROMOTION_TAGS + fv.FEATURE_TAGS)
            & ~F.regexp_like(line, F.lit(fv.STRUCTURED_LINE))
        )

    ranked = F.transform(
        F.filter(lines, free),
        lambda line, i: F.struct(F.length(line).alias("n"), (-i).alias("neg_pos"), line.alias("line")),
    )
    return F.array_max(ranked)["line"]


def _settle(df: DataFrame) -> DataFrame:
    """Fix the columns as they are. A later filter on a parsed column would otherwise be
    pushed below these projections, with every intermediate expression expanded inside it;
    filters do not pass a generator."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _split_address(df: DataFrame) -> DataFrame:
    """lines -> address, area, body. The first line naming a municipality is the area and
    the line before it the address; without one, line 0 is the address."""
    at = _first_index(F.col("lines"), _matches("(?iu)kommun"))
    df = df.withColumn("area_at", F.when(at > 0, at))
    has_area = F.col("area_at").isNotNull()
    return _settle(
        df.withColumn(
            "address", F.get("lines", F.when(has_area, F.col("area_at") - 1).otherwise(0))
        )
        .withColumn("area", F.when(has_area, F.get("lines", F.col("area_at"))))
        .withColumn(
            "body", _tail(F.col("lines"), F.when(has_area, F.col("area_at") + 1).otherwise(F.lit(1)))
        )
        .drop("area_at", "lines")
    )


def _full_href(href: Column, site: str) -> Column:
    return F.when(href.startswith("/"), F.concat(F.lit(site), href)).otherwise(href)


def parse_sold_cards(cards: DataFrame, site: str = "", keep: list[str] | None = None) -> DataFrame:
    """Sold cards (``href``, ``text``) -> one typed row each; ``keep`` columns pass through."""
    keep = keep or []
    base = cards.select(
        *keep,
        _full_href(F.col("href"), site).alias("href"),
        F.col("text").alias("raw"),
        card_lines("text").alias("lines"),
    )
    base = base.withColumn("sold_at", _first_index(F.col("lines"), _matches(fv.SOLD_LINE)))
    at = F.col("sold_at")
    without = F.concat(F.slice("lines", F.lit(1), at), _tail(F.col("lines"), at + 1))
    base = base.withColumn(
        "sold_date",
        F.regexp_replace(tx.squash(tx.capture(F.get("lines", at), fv.SOLD_LINE)), r"\.+$", ""),
    ).withColumn("lines", F.when(at.isNotNull(), without).otherwise(F.col("lines")))
    base = _split_address(base.drop("sold_at"))
    body = F.col("body")
    fee_at = _first_index(body, lambda line: line.contains("kr/mån"))
    price_at = F.coalesce(
        _first_index(body, lambda line: line.startswith("Slutpris") & ~line.contains("kr/mån")),
        F.size(body),
    )
    between = F.slice(body, F.col("fee_at") + 2, F.greatest(F.col("price_at") - F.col("fee_at") - 1, F.lit(0)))
    # The texts of the numbers are columns first: a number names its text several times.
    parsed = base.withColumn("fee_at", fee_at).withColumn("price_at", price_at).withColumns(
        {
            "_m2": find_in_lines(body, fv.AREA_M2),
            "_rooms": find_in_lines(body, fv.ROOMS),
            "_fee": find_in_lines(body, fv.MONTHLY_FEE),
            "_price": find_in_lines(body, fv.FINAL_PRICE),
            "_per_m2": find_in_lines(body, fv.PRICE_PER_M2),
            "_diff": find_in_lines(body, fv.PRICE_DIFF),
        }
    )
    return parsed.select(
        *keep,
        "href",
        "raw",
        "sold_date",
        tx.swedish_date("sold_date").alias("sold_on"),
        "address",
        "area",
        tx.list_number("_m2").alias("m2"),
        tx.list_number("_rooms").alias("rooms"),
        tx.list_integer("_fee").alias("fee_kr"),
        tx.list_integer("_price").alias("price_kr"),
        tx.list_integer("_per_m2").alias("kr_per_m2"),
        tx.signed_percent("_diff").alias("price_diff_pct"),
        F.when(
            F.col("fee_at") < F.col("price_at"),
            F.filter(between, lambda line: ~F.regexp_like(line, F.lit(r"(?U)\d")) & ~line.contains("kr/mån")),
        )
        .otherwise(F.array().cast("array<string>"))
        .alias("tags"),
        last_plain_line(body, r"(?U)\d|kr|m²|%").alias("agent"),
    )


def parse_onsale_cards(cards: DataFrame, site: str = "", keep: list[str] | None = None) -> DataFrame:
    """On-sale and upcoming cards -> one typed row each."""
    keep = keep or []
    base = cards.select(
        *keep,
        _full_href(F.col("href"), site).alias("href"),
        F.col("text").alias("raw"),
        card_lines("text").alias("lines"),
    )
    base = base.withColumn(
        "visning",
        F.when(F.regexp_like(F.get("lines", F.lit(0)), F.lit(fv.VIEWING_LINE)), F.get("lines", F.lit(0))),
    ).withColumn(
        "lines", F.when(F.col("visning").isNotNull(), _tail(F.col("lines"), F.lit(1))).otherwise(F.col("lines"))
    )
    base = _split_address(base)
    body = F.col("body")
    base = base.withColumns(
        {
            "floor_line": _first(body, _matches("(?iu)vån")),
            "_price": find_in_lines(body, fv.ASKING_PRICE),
            "_m2": find_in_lines(body, fv.AREA_M2),
            "_rooms": find_in_lines(body, fv.ROOMS),
            "_fee": find_in_lines(body, fv.MONTHLY_FEE),
            "_per_m2": find_in_lines(body, fv.PRICE_PER_M2),
        }
    )
    stated = F.regexp_like("floor_line", F.lit(fv.FLOOR_OF))
    tags = fv.PROMOTION_TAGS + fv.FEATURE_TAGS
    return base.select(
        *keep,
        "href",
        "raw",
        "visning",
        "address",
        "area",
        tx.list_integer("_price").alias("asking_price_kr"),
        tx.list_number("_m2").alias("m2"),
        tx.list_number("_rooms").alias("rooms"),
        tx.list_integer("_fee").alias("fee_kr"),
        tx.list_integer("_per_m2").alias("kr_per_m2"),
        F.when(stated, tx.capture("floor_line", fv.FLOOR_OF, 1))
        .otherwise(tx.capture("address", fv.FLOOR_SUFFIX, 1))
        .try_cast("int")
        .alias("vaning"),
        F.when(stated, tx.capture("floor_line", fv.FLOOR_OF, 2)).try_cast("int").alias("vaning_total"),
        F.filter(body, lambda line: line.isin(fv.PROMOTION_TAGS)).alias("promotions"),
        F.filter(body, lambda line: line.isin(fv.FEATURE_TAGS)).alias("tags"),
        longest_free_line(body).alias("description"),
        last_plain_line(body, r"(?U)\d|kr|m²", tags).alias("agent"),
    )


def parse_cards(cards: DataFrame, site: str = "", carry: list[str] | None = None) -> DataFrame:
    """Raw cards (``kind``, ``page``, ``pos``, ``href``, ``text``) -> listings of every kind.

    Project pages go before parsing, each href is kept where first seen, and rows promoted
    as new construction go after. ``kind`` is a partition column of the capture table, so
    each branch reads only its own partitions.
    """
    carry = carry or []
    wanted = cards.where(~F.col("href").contains(fv.PROJECT_PATH))
    wanted = first_seen(wanted, [*carry, "kind", "href"], ["page", "pos"])
    keep = [*carry, "kind", "page"]
    sold = parse_sold_cards(wanted.where(F.col("kind") == "sold"), site, keep)
    live = parse_onsale_cards(wanted.where(F.col("kind") != "sold"), site, keep).where(
        ~F.array_contains("promotions", "Nyproduktion")
    )
    both = sold.unionByName(live, allowMissingColumns=True)
    return (
        both.withColumnRenamed("kind", "status")
        .withColumnRenamed("page", "scraped_page")
        .withColumn("listing_id", tx.listing_id("href"))
    )
