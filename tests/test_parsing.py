from datetime import date

import pytest

from pricelens import fixed_values as fv
from pricelens.operators import association, cards, detail
from pyspark.sql import functions as F
from tests.rows import one

SOLD = """Maps Data: Google © 2026
Såld 16 mar. 2026
Anna / Berg
Sandhamnsgatan 75C
Östermalm - Gärdet, Stockholms kommun
76 m²
3 rum
6 181 kr/mån
Balkong
Hiss
Slutpris 6 900 000 kr
-5 %
90 789 kr/m²
Bergets Ro Fastighetsförmedling"""

ONSALE = """Sön 17 maj kl 13:00
Dannemoragatan 16A, 4 tr
Vasastan, Stockholms kommun
7 800 000 kr
71 m²
2,5 rum
vån 4/5
5 303 kr/mån
109 859 kr/m²
En mycket fin bostad med generös takhöjd och ljus i tre väderstreck, 71 m² stor
En mycket fin bostad med generös takhöjd och ljus i tre väderstreck, nära allt
En mycket fin bostad med generös takhöjd och ljus i tre väderstreck, nära buss
Premium
Balkong
Svensk Fastighetsförmedling"""

CARD = "kind string, page int, pos int, href string, text string"


def parse(spark, *rows):
    return cards.parse_cards(spark.createDataFrame(list(rows), CARD), "https://site.example")


def test_sold_card(spark):
    r = one(parse(spark, ("sold", 1, 0, "/salda/x-75c-2759425130997191301", SOLD)))
    assert (r["address"], r["area"]) == ("Sandhamnsgatan 75C", "Östermalm - Gärdet, Stockholms kommun")
    assert (r["m2"], r["rooms"], r["fee_kr"], r["price_kr"], r["kr_per_m2"], r["price_diff_pct"]) == (76, 3, 6181, 6900000, 90789, -5)
    assert r["tags"] == ["Balkong", "Hiss"] and r["agent"] == "Bergets Ro Fastighetsförmedling"
    assert r["sold_date"] == "16 mar. 2026" and r["sold_on"] == date(2026, 3, 16)
    assert r["href"] == "https://site.example/salda/x-75c-2759425130997191301" and r["listing_id"] == "2759425130997191301"


def test_onsale_card(spark):
    r = one(parse(spark, ("onsale", 1, 0, "/bostad/x-21721260", ONSALE)))
    assert (r["asking_price_kr"], r["m2"], r["rooms"], r["fee_kr"], r["kr_per_m2"]) == (7800000, 71, 2.5, 5303, 109859)
    assert (r["vaning"], r["vaning_total"], r["visning"]) == (4, 5, "Sön 17 maj kl 13:00")
    assert (r["promotions"], r["tags"], r["agent"]) == (["Premium"], ["Balkong"], "Svensk Fastighetsförmedling")
    # The first of two equally long free lines; the one with an area counts as structured.
    assert r["description"].endswith("nära allt") and r["status"] == "onsale"


def test_card_without_municipality_line(spark):
    r = one(parse(spark, ("onsale", 1, 0, "/bostad/x-1", "Vägen 1, 4 tr\n\n71 m²\nMäklare")))
    assert (r["address"], r["area"], r["vaning"], r["m2"], r["agent"]) == ("Vägen 1, 4 tr", None, 4, 71.0, "Mäklare")
    r = one(parse(spark, ("sold", 1, 0, "/salda/x-1", "Stockholms kommun\n±0 %")))
    assert (r["address"], r["area"], r["price_diff_pct"], r["sold_date"], r["tags"]) == ("Stockholms kommun", None, 0, None, [])


def test_first_floor_line_decides(spark):
    r = one(parse(spark, ("onsale", 1, 0, "/bostad/x-1", "Vägen 1, 2 tr\nX, Solna kommun\nvåningsplan\nvån 4/5")))
    assert (r["vaning"], r["vaning_total"]) == (2, None)


def test_dedupe_and_project_filters(spark):
    rows = [
        ("onsale", 1, 0, "/bostad/a-1", "A 1\nX, Solna kommun"),
        ("onsale", 2, 0, "/bostad/a-1", "A 2\nX, Solna kommun"),
        ("onsale", 1, 1, "/nybyggnadsprojekt/b-2", "B\nX, Solna kommun"),
        ("onsale", 1, 2, "/bostad/c-3", "C\nX, Solna kommun\nNyproduktion"),
    ]
    assert [r.address for r in parse(spark, *rows).collect()] == ["A 1"]


def test_detail_page(spark):
    body = "\n".join(
        ["Bostadstyp", "", "Lägenhet", "Antal rum", "2,5 rum", "Boarea", "71,5 m²", "Våning", "4 av 5, hiss finns", "Byggår", "1932", "Avgift", "5 303 kr/mån",
         "Balkong", "Ja", "Prisutveckling", "−300 000 kr (−6 %)", "Slutpris", "6 900 000 kr", "Utgångspris", "6 600 000 kr", "Energiklass", "", "", "", "C",
         "Visningstider", "Boarea", "99 m²", "Status", "Oäkta förening", "Äger marken", "Nej", "Antal lägenheter", "45", "Årsavgift", "458 kr/m²", "Belåning"]
    )
    img = lambda src, alt: (f"https://img.example/{src}", alt)
    page = spark.createDataFrame(
        [("1", "sold", body, ["{bad", '[{"offers":{"validFrom":5}},{"offers":{"validFrom":"2026-05-01T10:00"}}]'],
          [img("a" * 32 + ".jpg", "bild 2"), img("b" * 32 + ".jpg", "Bild 1"), img("big/" + "a" * 32 + ".jpg", "bild 0"), img("p", "planritning"), img("c", None), ("https://other.example/z", "bild 1")])],
        "listing_id string, kind string, body string, jsonld array<string>, imgs array<struct<src:string,alt:string>>",
    )
    r = one(detail.parse_detail_pages(page, "img.example"))
    assert (r["bostadstyp"], r["detail_rooms"], r["boarea_m2"], r["vaning"], r["vaning_total"], r["hiss"]) == ("Lägenhet", 2.5, 71.5, 4, 5, True)
    assert (r["byggar"], r["avgift_kr_mon"], r["balkong"], r["uteplats"], r["energiklass"]) == (1932, 5303, True, None, None)
    assert (r["detail_price_kr"], r["asking_price_kr"], r["asking_diff_kr"], r["asking_diff_pct"]) == (6900000, 6600000, -300000, -6)
    assert (r["brf_akta"], r["brf_ager_marken"], r["brf_n_lgh"], r["brf_arsavgift_kr_m2"], r["brf_belaning_kr_m2"]) == (False, False, 45, 458, None)
    assert [p.rsplit("/", 1)[1] for p in r["photos"]] == ["b" * 32 + ".jpg", "a" * 32 + ".jpg", "c", "p"]
    assert r["published_at"] == date(2026, 5, 1)


@pytest.mark.parametrize(
    "lines, akta, ager",
    [
        (["Äkta förening", "Tomträtt"], True, False),
        (["Äkta förening", "Äger marken"], True, True),
        (["Status", "Äkta förening", "Äger marken", "Ja"], True, True),
        (["Äger marken", "Kanske"], None, None),
    ],
)
def test_association_layouts(spark, lines, akta, ager):
    df = spark.createDataFrame([("\n".join(lines),)], "body string")
    raw = df.select(detail.label_values("body", fv.LABELS_ASSOCIATION, cut_panel=False).alias("raw"))
    f = detail.association_facts("raw")
    r = one(raw.select(f["brf_akta"].alias("akta"), f["brf_ager_marken"].alias("ager")))
    assert (r["akta"], r["ager"]) == (akta, ager)


def test_association_and_address_pages(spark):
    body = "En oäkta bostadsrättsförening med TOMTRÄTT. Antal lägenheter 45. Föreningen bildades år 1987. Årsavgift per m² (2024) är 1 012 kr. Hus: Åsögatan 12B-14, Kungsvägen 3, Åsögatan 12B-14."
    r = one(association.association_page_facts(spark.createDataFrame([("b", "u", body, " Brf B ")], "brf_slug string, url string, body string, heading string")))
    assert (r["brf_akta"], r["brf_ager_marken"], r["brf_n_lgh"], r["brf_byggar"], r["brf_arsavgift_kr_m2"], r["brf_arsavgift_kr_m2_year"]) == (False, False, 45, 1987, 1012, 2024)
    assert r["addresses"] == ["Kungsvägen 3", "Åsögatan 12B-14"] and r["forening"] == "Brf B"
    rows = [
        ("gatan-1", "x" * 300 + " organisationsnummer: 716416-1234", ["https://a.example/gatan-1/ekonomi", "https://a.example/brf-x/styrelse", "https://a.example/brf-y/ekonomi"]),
        ("gatan-2", "404 saknas", ["https://a.example/brf-x/styrelse"]),
        ("gatan-3", "x", ["https://a.example/brf-x/annat"]),
    ]
    got = association.resolve_address_pages(spark.createDataFrame(rows, "addr_slug string, body string, hrefs array<string>"), "a.example")
    assert [(r.brf_slug, r.orgnr) for r in got.orderBy("addr_slug").collect()] == [("brf-x", "716416-1234"), (None, None), (None, None)]


def test_probe_signals(spark):
    rows = [
        ("1", date(2026, 5, 20), "https://s/salda/1", "x", None, "Slutpris\n5 100 000 kr"),
        ("2", date(2026, 5, 20), "https://s/bostad/2", "har sålts. Borttagen den 18 maj 2026", "https://s/salda/2", "inget"),
        ("3", date(2026, 5, 20), "https://s/bostad/3", "Slutpris 4 200 000 kr", None, None),
        ("4", date(2026, 5, 20), "https://s/bostad/4", "Borttagen den 18 maj 2026", None, None),
        ("5", date(2026, 5, 20), "https://s/bostad/5", None, None, None),
    ]
    got = association.probe_signals(spark.createDataFrame(rows, "id string, probe_date date, final_url string, body string, salda_url string, salda_body string"))
    assert [tuple(r)[2:] for r in got.orderBy("id").collect()] == [
        ("sold", None, "https://s/salda/1", 5100000), ("sold", date(2026, 5, 18), "https://s/salda/2", None),
        ("sold", None, None, 4200000), ("withdrawn", date(2026, 5, 18), None, None), (None, None, None, None),
    ]


def test_type_inference(spark):
    rows = [("/bostad/lagenhet-2", "fin PARVILLA"), ("/bostad/lagenhet-2", "radhuset"), ("/x", None), ("/bostad/villa-1", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u string, d string").orderBy("i")
    assert [r[0] for r in df.select(detail.inferred_type("u", "d")).collect()] == ["Parhus", "Lägenhet", None, "Villa"]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_card_texts_are_searched_once(spark):
    """A number names its text several times; the lines are searched for it once."""
    df = spark.createDataFrame([("/salda/x-1", "Gatan 1\nSöder, Solna \u212aOMMUN\n44 m²\n2 rum\nVÅN 2/3")], "href string, text string")
    for parse, pattern in ((cards.parse_sold_cards, fv.AREA_M2), (cards.parse_onsale_cards, fv.ASKING_PRICE)):
        parsed = parse(df)
        assert optimized(parsed).count(f"regexp_extract(filter(body") <= 7 and optimized(parsed).count(pattern) <= 2
        assert one(parsed)["area"] == "Söder, Solna \u212aOMMUN" and one(parsed)["m2"] == 44.0


def test_association_words_in_any_case(spark):
    cases = [("JA", "OÄKTA förening", True, False), (" nEj\u2003", "en Äkta", False, True), ("ja!", "okänd", None, None), ("ja\n", "oäktä", True, None)]
    rows = [(i, {"Äger marken": own, "Status": status}) for i, (own, status, _, _) in enumerate(cases)]
    facts = detail.association_facts("raw")
    df = spark.createDataFrame(rows, "i int, raw map<string,string>").select("i", *[facts[c].alias(c) for c in ("brf_ager_marken", "brf_akta")])
    assert {r.i: (r.brf_ager_marken, r.brf_akta) for r in df.collect()} == {i: c[2:] for i, c in enumerate(cases)}
    assert "lower(" not in optimized(df)  # lowering a text outside ASCII is dear
