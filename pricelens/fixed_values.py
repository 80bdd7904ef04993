"""Word lists, lookup tables, constants and text patterns that define the results."""

# ---- Fixed values: they must not change, or results change with them -------

# List cards
PROJECT_PATH = "/nybyggnadsprojekt/"
PROMOTION_TAGS = ["Premium", "Plus", "Premium Plus", "Nyproduktion", "Energieffektiv"]
FEATURE_TAGS = ["Balkong", "Uteplats", "Hiss", "Tomt", "Tomträtt"]
VIEWING_LINE = r"(?U)^(Idag|Imorgon|Mån|Tis|Ons|Tors|Fre|Lör|Sön|Budgivning)\b"
SOLD_LINE = r"(?U)^Såld\s+(.+)"
AREA_M2 = r"(?U)^([\d,\s+]+)\s*m²"
ROOMS = r"(?U)^([\d,\s]+)\s*rum"
MONTHLY_FEE = r"(?U)^([\d\s]+)\s*kr/mån"
FINAL_PRICE = r"(?U)Slutpris\s+([\d\s]+)\s*kr"
PRICE_PER_M2 = r"(?U)^([\d\s]+)\s*kr/m²"
PRICE_DIFF = r"(?U)^([+\-±]\s?\d+|±\s?0)\s*%"
ASKING_PRICE = r"(?U)^([\d\s]+)\s*kr\s*$"
FLOOR_OF = r"(?U)vån\s*(\d+)\s*/\s*(\d+)"
FLOOR_SUFFIX = r"(?U),\s*(\d+)\s*tr\s*$"
STRUCTURED_LINE = r"(?U)kr/m|kr$|(?<![\w²])m²(?![\w²])|\brum\b|\bvån\b"
MIN_DESCRIPTION_CHARS = 60

# Detail pages
PANEL_END = "All information om bostaden|Räkna på ditt nya boende|Visningstider"
LABELS_SOLD = [
    "Slutpris", "Pris per kvadratmeter", "Utgångspris", "Prisutveckling",
    "Bostadstyp", "Upplåtelseform", "Antal rum", "Boarea", "Biarea",
    "Balkong", "Uteplats", "Våning", "Byggår", "Avgift", "Driftskostnad",
    "Energiklass", "Antal besök",
]
LABELS_ONSALE = [
    "Bostadstyp", "Upplåtelseform", "Antal rum", "Boarea", "Biarea",
    "Balkong", "Uteplats", "Våning", "Byggår", "Avgift", "Driftskostnad",
    "Energiklass", "Förening", "Pris/m²", "Utgångspris",
]
LABELS_ASSOCIATION = [
    "Status", "Äkta förening", "Äger marken", "Antal lägenheter", "Årsavgift", "Belåning",
]
VALUE_LOOKAHEAD_LINES = 3
TYPE_PATTERNS = [
    (r"(?iU)\b(parvilla|parhus)\b", "Parhus"),
    (r"(?iU)\b(kedjehus|kedjevilla)\b", "Kedjehus"),
    (r"(?iU)\b(gavelradhus|radhus)\b", "Radhus"),
    (r"(?iU)\bvilla\b", "Villa"),
    (r"(?iU)\b(lägenhet|lägenheten)\b", "Lägenhet"),
]
TYPE_URL_HINTS = {
    "lagenhet": "Lägenhet", "villa": "Villa", "radhus": "Radhus",
    "parhus": "Parhus", "kedjehus": "Kedjehus",
}
PHOTO_HASH = r"([0-9a-f]{32})\.jpg"
PHOTO_ORDER = r"bild\s+(\d+)"
PHOTO_ORDER_DEFAULT = 999

# Association pages
ASSOCIATION_TABS = "ekonomi|info_bilder|forsaljningar|lagenheter|omradet|styrelse|dokument"
PAGE_NOT_FOUND = "Sidan du letade efter kunde inte hittas"
ORG_NUMBER = r"(?iU)\borganisationsnummer\s*[:\-]?\s*(\d{6}-\d{4})"
GENUINE_TEXT = r"(?iU)\bäkta bostadsrätt"
NON_GENUINE_TEXT = r"(?iU)\boäkta bostadsrätt"
APARTMENT_COUNT = r"(?iU)Antal\s+lägenheter\s+(\d+)"
FOUNDED_YEAR = r"(?iU)bildades\s+(?:år\s+)?(\d{4})"
FEE_PER_M2 = r"(?iU)Årsavgift per m²\s*\(\s*(\d{4})\s*\)\s*[^\d]+([\d\s]+)"
STREET_ADDRESS = (
    r"(?U)\b([A-ZÅÄÖ][a-zA-ZåäöéÉ\-]+(?:vägen|gatan|gränd|stigen|backen|torget|plan|hamnen"
    r"|allén?|gången|kajen|udden))\s+(\d+(?:[A-Z])?(?:-\d+(?:[A-Z])?)?)"
)
CATCHMENT_TOKENS = [
    "Stockholms kommun", "Danderyds kommun", "Lidingö kommun",
    "Nacka kommun", "Sundbybergs kommun", "Solna kommun",
]
REGION_TOKENS = [
    "Stockholms kommun", "Danderyds kommun", "Lidingö kommun",
    "Nacka kommun", "Sundbybergs kommun", "Solna kommun",
    "Huddinge kommun", "Järfälla kommun",
]
FAR_AWAY_SLUG = (
    r"-(falun|filipstad|tierp|are|nykoping|lund|ramundberget|bruksvallarna"
    r"|malmo|goteborg|uppsala|orebro|umea|gavle|sundsvall|linkoping|jonkoping"
    r"|halmstad|karlstad|vasteras|borlange)\b"
)
BACKFILL_FIELDS = [
    "brf_akta", "brf_ager_marken", "brf_n_lgh",
    "brf_arsavgift_kr_m2", "brf_belaning_kr_m2",
]

# Geocoding: municipality -> (min_lat, min_lon, max_lat, max_lon)
MUNICIPALITY_BOXES = {
    "Stockholm": (59.22, 17.82, 59.43, 18.20),
    "Danderyd": (59.39, 18.00, 59.46, 18.14),
    "Lidingö": (59.34, 18.10, 59.40, 18.27),
    "Nacka": (59.26, 18.10, 59.36, 18.42),
    "Solna": (59.34, 17.92, 59.40, 18.05),
    "Sundbyberg": (59.35, 17.92, 59.41, 18.02),
}
DEFAULT_CITY = "Stockholm"
FLOOR_TAIL = r"(?iU)(?:,\s*(?:vån\s*\d+(?:/\d+)?|\d+\s*vån|\d+(?:\s*\d/\d)?\s*tr\.?)\s*)+$"
SHOUTING_TAIL = r"(?U),\s*[A-ZÅÄÖ][A-ZÅÄÖ !.]+!?$"
INCLUDED_TAIL = r"(?iU),\s*ink\.\s.*$"
LAYOUT_TAIL = (
    r"(?iU),\s*(etage|h(?:ö|o)rnl(?:ä|a)ge|toppv(?:å|a)ning|gathus|g(?:å|a)rdshus"
    r"|gavel(?:l(?:ä|a)genhet)?)\s*$"
)
SLUG_FLOOR = r"(?iU)\b(lgh|våning|vån)\s*\d+"
MUNICIPALITY = r"(?U)^([\wåäöÅÄÖ\-]+?)s?\s+kommun"

# Districts
DIRECTIONAL_WORDS = [
    "lilla", "stora", "västra", "östra", "norra", "norr", "södra", "söder",
    "gamla", "centrala", "nedre", "övre",
]
INNER_DISTRICTS = [
    "Södermalm", "Kungsholmen", "Vasastan", "Östermalm", "Norrmalm",
    "Gamla Stan", "Hagastaden", "Birkastan", "Gärdet", "Hjorthagen",
    "Stadshagen", "Marieberg", "Västra Kungsholmen", "Fredhäll", "Fridhemsplan",
    "Hornsbergs", "Lindhagen", "Thorildsplan", "Norr Mälarstrand",
    "Norra Djurgårdsstaden", "Nedre Gärdet",
    "Sofia", "Hornstull", "Katarina", "Maria", "Skanstull", "Högalid", "Reimersholme",
]
UNKNOWN_DISTRICT = "Unknown"
OTHER_DISTRICT = "Other"
RARE_LEVEL_MIN = 4
FINE_LEVEL_MIN = 8

# Hedonic model
NUMERIC_FEATURES = [
    "log_m2", "byggar_decade", "vaning_eff", "hiss_int", "log_avgift",
    "is_tomratt", "is_aganderatt", "is_andel",
]
BASELINE_FEATURES = ["log_m2", "byggar_decade", "vaning_eff", "hiss_int", "log_avgift"]
OWNERSHIP_FEATURES = BASELINE_FEATURES + ["is_house", "is_tomratt", "is_aganderatt", "is_andel"]
ASSOCIATION_FEATURES = OWNERSHIP_FEATURES + ["is_oakta", "log_belaning"]
HOUSE_TYPES = ["Villa", "Radhus", "Parhus", "Kedjehus", "Par-/kedje-/radhus"]
APARTMENT_TYPES = ["Lägenhet"]
VILLA_TYPES = ["Villa"]
ROW_TYPES = ["Radhus", "Parhus", "Kedjehus", "Par-/kedje-/radhus"]
DEFAULT_BUILD_YEAR = 1970
DEFAULT_FLOOR = 2
DEFAULT_FEE = 4500.0
DEFAULT_DEBT = 5000.0
NEIGHBOURS = 5
KM_PER_LAT_DEGREE = 111.0
KM_PER_LON_DEGREE = 55.0

# Ledger
WITHDRAW_AFTER_DAYS = 14
SNAPSHOT_FIELDS = [
    "address", "area", "lat", "lon", "bostadstyp",
    "m2", "rooms", "kr_per_m2", "byggar", "vaning", "vaning_total", "hiss",
    "forening", "predicted_price_kr", "stadsdel_liquidity",
    "brf_akta", "brf_ager_marken", "brf_n_lgh",
    "brf_arsavgift_kr_m2", "brf_belaning_kr_m2",
    "min_to_odenplan", "published_at", "tags", "is_tomratt",
]
SOLD_PATH = "/salda/"
UPCOMING_PATH = "/kommande/"
PROBE_FINAL_PRICE = r"(?U)Slutpris\s*([\d\s]+?)\s*kr"
REMOVED_ON = r"(?U)Borttagen den\s+(\d{1,2})\s+(\w+)\s+(\d{4})"
MONTHS = {
    "jan": 1, "januari": 1, "feb": 2, "februari": 2,
    "mar": 3, "mars": 3, "apr": 4, "april": 4,
    "maj": 5, "jun": 6, "juni": 6, "jul": 7, "juli": 7,
    "aug": 8, "augusti": 8, "sep": 9, "september": 9,
    "okt": 10, "oktober": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
SHORT_MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "maj": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "dec": 12,
}
RELATIVE_DAYS = {"idag": 0, "imorgon": 1, "i morgon": 1, "igår": -1, "i går": -1}
CACHE_TTL_HOURS = {"sold": None, "onsale": 18, "kommande": 18}

# Views
VIEW_FIELDS = [
    "href", "address", "area", "asking_price_kr", "m2", "rooms", "kr_per_m2", "byggar",
    "vaning", "vaning_total", "hiss", "forening", "photos", "lat", "lon", "visning",
    "predicted_price_kr", "deal_pct", "stadsdel_liquidity", "bostadstyp", "status",
    "min_to_odenplan", "published_at", "region", "tags", "is_tomratt",
    "brf_akta", "brf_ager_marken", "brf_n_lgh", "brf_arsavgift_kr_m2",
    "brf_belaning_kr_m2", "sold_price_kr", "sold_date", "sold_url",
    "realized_deal_pct", "first_seen", "last_seen", "asking_history",
]
TYPE_GROUPS = {"apt": APARTMENT_TYPES, "villa": VILLA_TYPES, "row": ROW_TYPES}
MUNICIPALITY_SEGMENTS = {
    "Danderyd": "Danderyds kommun", "Lidingö": "Lidingö kommun", "Nacka": "Nacka kommun",
    "Solna": "Solna kommun", "Sundbyberg": "Sundbybergs kommun",
}
STATUS_RANK = {"onsale": 0, "kommande": 0, "sold": 1, "withdrawn": 2}
DEFAULT_STATUSES = ["onsale", "kommande"]
# metric -> (lower threshold, upper threshold)
METRIC_THRESHOLDS = {"belaning": (3400, 9700), "arsavgift": (711, 930), "nlgh": (65, 233)}

# Points of interest
FERRY_SKIP_OPERATORS = [
    "Strömma Kanalbolaget", "Viking Line", "Tallink Silja", "Birka Cruises", "Trafikverket",
]
FERRY_SKIP_NAMES = [
    "Viking Line", "Tallink", "Birka,", "Birka ", "Mälarlunch",
    "Mälarparty", "Hop-on", "skoltrafik",
]
FERRY_FAST_MINUTES = 20
FERRY_MEDIUM_MINUTES = 30
FERRY_RADIUS_M = 600.0
# ---- End of fixed values ----------------------------------------------------
