"""Detail pages: page text, image list and JSON-LD -> typed facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions import text as tx


def label_values(body: Column | str, labels: list[str], cut_panel: bool = True) -> Column:
    """Label -> value map of a panel laid out as label line, value line.

    The value is the first non-blank of the three lines after the label; the first
    occurrence of a label that yields a value counts.
    """
    body = tx.col(body)
    if cut_panel:
        body = F.get(F.split(body, fv.PANEL_END, 2), F.lit(0))
    trimmed = F.transform(F.split(body, "\n"), tx.squash)

    def pairs_of(lines: Column) -> Column:
        def candidate(line: Column, i: Column) -> Column:
            following = F.slice(lines, i + 2, F.lit(fv.VALUE_LOOKAHEAD_LINES))
            value = F.get(F.filter(following, lambda v: v != ""), F.lit(0))
            return F.when(line.isin(labels), F.struct(line.alias("key"), value.alias("value")))

        return F.filter(F.transform(lines, candidate), lambda p: p["value"].isNotNull())

    def firsts(pairs: Column) -> Column:
        return tx.let(
            F.transform(pairs, lambda p: p["key"]),
            lambda keys: F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1),
        )

    return F.map_from_entries(tx.let(tx.let(trimmed, pairs_of), firsts))


def _value(raw: Column | str, label: str) -> Column:
    return F.try_element_at(tx.col(raw), F.lit(label))


def _is(c: Column, word: str) -> Column:
    """The trimmed text is the word, whatever its case. The words here have no letter that folds otherwise than it
    lowers (i and s would), and a regular expression is cheaper than lowering a text outside ASCII."""
    return F.regexp_like(tx.squash(c), F.lit(rf"(?iu)\A{word}\z"))


def _yes(c: Column) -> Column:
    return _is(c, "ja")


def typed_facts(raw: Column | str, kind: Column | str) -> dict[str, Column]:
    """Typed columns of the main panel map; ``kind`` says which label set applies."""
    sold = tx.col(kind) == "sold"

    def v(label: str) -> Column:
        return _value(raw, label)

    def only_sold(label: str) -> Column:
        return F.when(sold, v(label))

    def only_live(label: str) -> Column:
        return F.when(~sold, v(label))

    floor = v("Våning")
    floor_of = r"(?U)^\s*(\d+)\s*av\s*(\d+)"
    floor_tr = r"(?U)^\s*(\d+)\s*tr"
    development = only_sold("Prisutveckling")
    amount = r"(?U)([+\-−])\s*([\d ]+?)\s*kr".replace("[\\d ]", "[\\d" + tx.NBSP + " ]")
    percent = r"(?U)\(([+\-−±])\s*(\d+)\s*%\)"

    def signed(pattern: str, magnitude: Column) -> Column:
        minus = tx.capture(development, pattern, 1).isin("-", "−")
        return F.when(minus, -magnitude).otherwise(magnitude)

    asking = F.when(sold, v("Utgångspris")).otherwise(F.replace(v("Utgångspris"), F.lit("kr"), F.lit("")))
    per_m2 = F.when(sold, v("Pris per kvadratmeter")).otherwise(
        F.replace(v("Pris/m²"), F.lit("kr/m²"), F.lit(""))
    )
    return {
        "detail_price_kr": tx.detail_integer(only_sold("Slutpris")),
        "detail_kr_per_m2": tx.detail_integer(per_m2),
        "asking_price_kr": tx.detail_integer(asking),
        "asking_diff_kr": signed(amount, tx.detail_integer(tx.capture(development, amount, 2))),
        "asking_diff_pct": signed(percent, tx.capture(development, percent, 2).try_cast("int")),
        "bostadstyp": v("Bostadstyp"),
        "upplatelseform": v("Upplåtelseform"),
        "forening": only_live("Förening"),
        "detail_rooms": tx.detail_decimal(F.replace(v("Antal rum"), F.lit(" rum"), F.lit(""))),
        "boarea_m2": tx.detail_decimal(F.replace(v("Boarea"), F.lit(" m²"), F.lit(""))),
        "biarea_m2": tx.detail_decimal(F.replace(v("Biarea"), F.lit(" m²"), F.lit(""))),
        "byggar": tx.detail_integer(v("Byggår")).cast("int"),
        "vaning": F.coalesce(tx.capture(floor, floor_of, 1), tx.capture(floor, floor_tr, 1)).try_cast("int"),
        "vaning_total": tx.capture(floor, floor_of, 2).try_cast("int"),
        "hiss": F.lower(floor).contains("hiss finns"),
        "balkong": _yes(v("Balkong")),
        "uteplats": _yes(v("Uteplats")),
        "avgift_kr_mon": tx.detail_integer(F.replace(v("Avgift"), F.lit("kr/mån"), F.lit(""))),
        "drift_kr_year": tx.detail_integer(F.replace(v("Driftskostnad"), F.lit("kr/år"), F.lit(""))),
        "energiklass": v("Energiklass"),
        "antal_besok": tx.detail_integer(only_sold("Antal besök")),
    }


def association_facts(raw: Column | str) -> dict[str, Column]:
    """Association panel in either layout: explicit rows first, the legacy row second."""

    legacy = _value(raw, "Äkta förening")

    def number(label: str) -> Column:
        return tx.detail_integer(F.replace(_value(raw, label), F.lit("kr/m²"), F.lit(""))).cast("int")

    land, status = _value(raw, "Äger marken"), _value(raw, "Status")
    owns = F.when(_is(land, "ja"), True).when(_is(land, "nej"), False)
    owns_legacy = F.when(_is(legacy, "äger marken"), True).when(_is(legacy, "tomträtt"), False)
    genuine = F.when(F.regexp_like(status, F.lit("(?iu)oäkta")), False).when(F.regexp_like(status, F.lit("(?iu)äkta")), True)
    return {
        "brf_ager_marken": F.coalesce(owns, owns_legacy),
        "brf_akta": F.coalesce(genuine, F.when(legacy.isNotNull(), True)),
        "brf_marknad_raw": legacy,
        "brf_n_lgh": number("Antal lägenheter"),
        "brf_arsavgift_kr_m2": number("Årsavgift"),
        "brf_belaning_kr_m2": number("Belåning"),
    }


def ordered_photos(images: Column | str, host: str) -> Column:
    """Image URLs from one host: one per content hash, by "bild N", floor plans last."""
    shown = F.filter(tx.col(images), lambda i: i["src"].contains(host))
    keyed = F.transform(
        shown,
        lambda i, pos: F.struct(
            F.coalesce(tx.capture(i["src"], fv.PHOTO_HASH), i["src"]).alias("hash"),
            pos.alias("pos"),
            i["src"].alias("src"),
            F.lower(F.coalesce(i["alt"], F.lit(""))).alias("alt"),
        ),
    )
    once = tx.let(
        keyed,
        lambda items: tx.let(
            F.transform(items, lambda i: i["hash"]),
            lambda hashes: F.filter(items, lambda i, pos: F.array_position(hashes, i["hash"]) == pos + 1),
        ),
    )

    def rank(i: Column) -> Column:
        plan = i["alt"].contains("ritning")
        number = F.coalesce(
            F.regexp_extract(i["alt"], fv.PHOTO_ORDER, 1).try_cast("int"), F.lit(fv.PHOTO_ORDER_DEFAULT)
        )
        return F.struct(
            plan.cast("int").alias("plan"),
            F.when(plan, 0).otherwise(number).alias("number"),
            i["pos"].alias("pos"),
            i["src"].alias("src"),
        )

    return F.transform(F.array_sort(F.transform(once, rank)), lambda i: i["src"])


def published_on(blocks: Column | str) -> Column:
    """Date of the first JSON-LD block (or array element) whose offer has a textual
    ``validFrom`` of ten characters or more; unreadable JSON is skipped."""

    def elements(block: Column) -> Column:
        value = F.try_parse_json(block)
        listed = F.try_variant_get(value, "$", "array<variant>")
        return F.coalesce(listed, F.array(value))

    def valid_from(value: Column) -> Column:
        found = F.try_variant_get(value, "$.offers.validFrom", "variant")
        text = F.try_variant_get(found, "$", "string")
        return F.when((F.schema_of_variant(found) == "STRING") & (F.length(text) >= 10), F.substring(text, 1, 10))

    every = F.flatten(F.transform(tx.col(blocks), elements))
    dates = F.filter(F.transform(every, valid_from), lambda d: d.isNotNull())
    return F.get(dates, F.lit(0))


def inferred_type(url: Column | str, description: Column | str) -> Column:
    """Property type named in the description, else in the URL path."""
    description = tx.col(description)
    named = F.lit(None).cast("string")
    for pattern, label in reversed(fv.TYPE_PATTERNS):
        named = F.when(F.regexp_like(description, F.lit(pattern)), label).otherwise(named)
    hints = F.create_map(*[F.lit(x) for pair in fv.TYPE_URL_HINTS.items() for x in pair])
    hint = tx.capture(F.coalesce(tx.col(url), F.lit("")), "/bostad/([a-z]+)-")
    return F.coalesce(named, F.try_element_at(hints, hint))


def parse_detail_pages(pages: DataFrame, photo_host: str) -> DataFrame:
    """Captured detail pages (``kind``, ``body``, ``jsonld``, ``imgs``) -> typed facts."""
    sold = F.col("kind") == "sold"
    raw = pages.withColumn(
        "panel",
        F.when(sold, label_values("body", fv.LABELS_SOLD)).otherwise(label_values("body", fv.LABELS_ONSALE)),
    ).withColumn("association", label_values("body", fv.LABELS_ASSOCIATION, cut_panel=False))
    facts = {**typed_facts("panel", "kind"), **association_facts("association")}
    keep = [c for c in pages.columns if c not in ("body", "jsonld", "imgs", *facts)]
    return raw.select(
        *keep,
        *[c.alias(name) for name, c in facts.items()],
        ordered_photos("imgs", photo_host).alias("photos"),
        published_on("jsonld").try_cast("date").alias("published_at"),
    )
