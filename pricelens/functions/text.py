"""Text functions: numbers, ids, districts, addresses, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens import fixed_values as fv

NBSP = " "


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def squash(c: Column | str) -> Column:
    """Trim every kind of white space (plain ``trim`` only takes spaces)."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def capture(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Regex group, null (not the empty string) when the pattern or group is absent."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def let(value: Column, body) -> Column:
    """Bind a value for use inside lambdas. An outer expression named in a lambda is
    evaluated again for every element; a bound one is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- numbers ---------------------------------------------------------------

def list_number(c: Column | str) -> Column:
    """Number on a list card: ``1 650`` -> 1650, ``2,5`` -> 2.5, ``60+10`` -> 60."""
    plain = squash(F.split_part(F.translate(col(c), f",{NBSP} ", "."), F.lit("+"), F.lit(1)))
    return F.when(F.regexp_like(plain, F.lit(r"^-?(\d+\.?\d*|\.\d+)$")), plain.try_cast("double"))


def list_integer(c: Column | str) -> Column:
    return list_number(c).cast("bigint")


def _leading_number(c: Column, comma: str) -> Column:
    plain = F.translate(c, f",{NBSP} ", comma)
    return F.nullif(F.regexp_extract(plain, r"^-?\d+(?:\.\d+)?", 0), F.lit(""))


def detail_decimal(c: Column | str) -> Column:
    """Number on a detail page where the comma is a decimal sign."""
    return _leading_number(col(c), ".").try_cast("double")


def detail_integer(c: Column | str) -> Column:
    """Number on a detail page without decimals: commas are dropped, ``.`` truncates."""
    return F.split_part(_leading_number(col(c), ""), F.lit("."), F.lit(1)).try_cast("bigint")


def signed_percent(c: Column | str) -> Column:
    """``+6`` -> 6, ``- 5`` -> -5, ``±0`` -> 0; null when unreadable."""
    plain = F.regexp_replace(col(c), r"(?U)[\s±]", "")
    return F.when(plain == "", F.lit(0)).otherwise(plain.try_cast("int"))


def iso_minutes(c: Column | str) -> Column:
    """ISO-8601 duration to minutes: ``PT1H5M`` -> 65, ``PT`` -> 0, no match -> null."""
    pattern = r"^PT(?:(\d+)H)?(?:(\d+)M)?"
    c = col(c)

    def part(group: int) -> Column:
        return F.coalesce(F.regexp_extract(c, pattern, group).try_cast("int"), F.lit(0))

    return F.when(c.startswith("PT"), part(1) * 60 + part(2))


# ---- ids -------------------------------------------------------------------

def short_sha1(c: Column | str) -> Column:
    return F.substring(F.sha1(col(c).cast("binary")), 1, 16)


def listing_id(url: Column | str) -> Column:
    """Trailing number of a listing URL, else a short hash of the URL."""
    url = F.coalesce(col(url), F.lit(""))
    return F.coalesce(capture(url, r"-(\d+)/?$"), short_sha1(url))


def kind_of(url: Column | str) -> Column:
    url = col(url)
    return (
        F.when(url.contains(fv.SOLD_PATH), "sold")
        .when(url.contains(fv.UPCOMING_PATH), "kommande")
        .otherwise("onsale")
    )


# ---- districts -------------------------------------------------------------

def _area_head(area: Column) -> Column:
    return squash(F.split_part(F.split_part(area, F.lit(","), F.lit(1)), F.lit("."), F.lit(1)))


def coarse_district(area: Column | str) -> Column:
    """Coarse district: first word, or two when the first is directional."""
    # One or two words up to the first comma, full stop, slash or dash.
    words = r"(?U)^\s*([^\s,./\-–]+)(?:\s+([^\s,./\-–]+))?"
    first = F.coalesce(F.regexp_extract(col(area), words, 1), F.lit(""))
    second = F.regexp_extract(col(area), words, 2)
    two = F.lower(first).isin(fv.DIRECTIONAL_WORDS) & (second != "")
    return (
        F.when(first == "", fv.UNKNOWN_DISTRICT)
        .when(two, F.concat_ws(" ", F.initcap(first), F.initcap(second)))
        .otherwise(F.initcap(first))
    )


def fine_district(area: Column | str) -> Column:
    """Fine district: everything before the comma, each word capitalised."""
    head = _area_head(col(area))
    words = F.initcap(F.regexp_replace(head, r"(?U)\s+", " "))
    return F.when(F.coalesce(head, F.lit("")) == "", fv.UNKNOWN_DISTRICT).otherwise(words)


def region_of_district(district: Column | str, inner: list[str] | None = None) -> Column:
    names = fv.INNER_DISTRICTS if inner is None else inner
    return F.when(col(district).isin(names), "inner").otherwise("outer")


def region_of(area: Column | str, inner: list[str] | None = None) -> Column:
    return region_of_district(coarse_district(area), inner)


# ---- addresses -------------------------------------------------------------

def clean_address(address: Column | str) -> Column:
    """Street address without floor, marketing and layout tails."""
    s = F.get(F.split(squash(address), r"(?U)\s+-\s+", 2), F.lit(0))
    for tail in (fv.FLOOR_TAIL, fv.SHOUTING_TAIL, fv.INCLUDED_TAIL, fv.LAYOUT_TAIL):
        s = F.regexp_replace(s, tail, "")
    return F.regexp_replace(squash(s), r",+$", "")


def city_of(area: Column | str, skip_first: bool = False) -> Column:
    """Municipality named in an area text, genitive -s stripped; null when none is."""
    parts = F.split(col(area), ",")
    if skip_first:
        parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    names = F.transform(parts, lambda p: F.regexp_extract(squash(p), fv.MUNICIPALITY, 1))
    return F.get(F.filter(names, lambda n: n != ""), F.lit(0))


def geocode_queries(address: Column | str, area: Column | str) -> Column:
    """Lookup texts for an address, most specific first; empty without an address."""
    address, area = col(address), col(area)
    street = clean_address(address)
    hood = squash(F.get(F.split(F.split_part(area, F.lit(","), F.lit(1)), "[/–]"), F.lit(0)))
    city = F.coalesce(city_of(area, skip_first=True), F.lit(fv.DEFAULT_CITY))
    place = F.when(area.contains("kommun"), F.concat(city, F.lit(" kommun"))).otherwise(city)
    no_letter = F.regexp_replace(street, r"(?U)(\b\d+)[A-Za-z]\b", "$1")
    queries = F.array(
        F.when(F.coalesce(hood, F.lit("")) != "", F.concat_ws(", ", street, hood, place)),
        F.concat_ws(", ", street, place),
        F.when(no_letter != street, F.concat_ws(", ", no_letter, place)),
    )
    return F.when(F.coalesce(address, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.array_compact(queries)
    )


def street_slug(address: Column | str) -> Column:
    """Street address as an ASCII slug, floor and flat numbers dropped; null when empty."""
    s = F.regexp_replace(F.split_part(col(address), F.lit(","), F.lit(1)), fv.SLUG_FLOOR, "")
    s = F.translate(F.lower(s), "åäöéü", "aaoeu")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.nullif(s, F.lit(""))


def mentions_any(c: Column | str, tokens: list[str]) -> Column:
    """True when the text contains one of the tokens; null text -> false."""
    c = F.coalesce(col(c), F.lit(""))
    hit = F.lit(False)
    for token in tokens:
        hit = hit | c.contains(token)
    return hit


# ---- dates -----------------------------------------------------------------

def _month_number(word: Column, months: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    return F.try_element_at(table, F.lower(word))


def removal_date(body: Column | str) -> Column:
    """``Borttagen den 18 maj 2026`` -> 2026-05-18; null when absent or not a real day."""
    body = col(body)
    day, word, year = (F.regexp_extract(body, fv.REMOVED_ON, g) for g in (1, 2, 3))
    text = F.format_string("%s-%02d-%s", year, _month_number(word, fv.MONTHS), F.lpad(day, 2, "0"))
    return F.when(_month_number(word, fv.MONTHS).isNotNull(), text.try_cast("date"))


def swedish_date(text: Column | str) -> Column:
    """``16 mar. 2026`` -> date; null when unreadable."""
    text = col(text)
    pattern = r"(?U)^\s*(\d{1,2})\s+(\w+)\.?\s+(\d{4})"
    day, word, year = (F.regexp_extract(text, pattern, g) for g in (1, 2, 3))
    iso = F.format_string("%s-%02d-%s", year, _month_number(word, fv.MONTHS), F.lpad(day, 2, "0"))
    return F.when(_month_number(word, fv.MONTHS).isNotNull(), iso.try_cast("date"))


def viewing_date(text: Column | str, snapshot_date: Column, view_date: Column) -> Column:
    """Day of a viewing: relative words count from the snapshot day; ``25 maj`` takes the
    view date's year, rolled forward when more than 180 days past."""
    trimmed = squash(text)
    relative = F.lit(None).cast("date")
    for word, days in reversed(list(fv.RELATIVE_DAYS.items())):
        relative = F.when(
            F.regexp_like(trimmed, F.lit(rf"(?iu)^{word}\b")), F.date_add(snapshot_date, days)
        ).otherwise(relative)
    pattern = r"(\d{1,2})\s+([a-zA-ZåäöÅÄÖ]+)"
    day = F.regexp_extract(trimmed, pattern, 1).try_cast("int")
    month = _month_number(F.substring(F.regexp_extract(trimmed, pattern, 2), 1, 3), fv.SHORT_MONTHS)

    def in_year(year: Column) -> Column:
        return F.date_add(F.make_date(year, month, F.lit(1)), day - 1)

    this_year = in_year(F.year(view_date))
    rolled = F.when(F.datediff(this_year, view_date) < -180, in_year(F.year(view_date) + 1))
    return F.coalesce(relative, rolled, this_year)


def viewing_label(text: Column | str, snapshot_date: Column, view_date: Column) -> Column:
    """Viewing text as shown on the view date; null once the day has passed."""
    text = col(text)
    day = viewing_date(text, snapshot_date, view_date)
    clock = squash(F.regexp_extract(text, r"(?i)kl\s+[\d:–\-\s]+", 0))
    return (
        F.when(day.isNull(), F.nullif(text, F.lit("")))
        .when(day < view_date, F.lit(None))
        .when(day == view_date, F.rtrim(F.concat(F.lit("Idag "), clock)))
        .when(day == F.date_add(view_date, 1), F.rtrim(F.concat(F.lit("Imorgon "), clock)))
        .otherwise(text)
    )
