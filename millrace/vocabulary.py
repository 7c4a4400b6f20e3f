"""Names, words, codes and patterns that results depend on."""

from __future__ import annotations

# --- fixed values: names of grains, each with its aliases ---
COMMODITY_ALIASES = {
    "CORN": ["corn", "yellow corn", "#2 yellow corn", "no 2 yellow corn", "#2 corn", "no 2 corn", "yc", "corn 2 yellow", "us #2 corn", "#2 yellow", "yellow"],
    "WHITE_CORN": ["white corn", "#2 white corn"],
    "SOYBEANS": ["soybeans", "soybean", "beans", "#1 soybeans", "no 1 soybeans", "#2 soybeans", "yellow soybeans", "sb", "syb", "soy"],
    "WHEAT_SRW": ["srw wheat", "soft red winter wheat", "soft red wheat", "sr winter wheat", "#2 srw", "chicago wheat", "srw"],
    "WHEAT_HRW": ["hrw wheat", "hard red winter wheat", "hard red wheat", "#1 hrw", "kc wheat", "kansas city wheat", "hrw"],
    "WHEAT_HRS": ["hrs wheat", "hard red spring wheat", "spring wheat", "dns wheat", "dark northern spring", "14% spring wheat", "mpls wheat", "hrs"],
    "WHEAT": ["wheat", "#2 wheat", "winter wheat"],
    "OATS": ["oats", "#2 oats", "white oats"],
    "SORGHUM": ["sorghum", "milo", "grain sorghum", "#2 milo", "#2 sorghum"],
    "BARLEY": ["barley", "feed barley", "malting barley"],
    "RYE": ["rye"],
    "CANOLA": ["canola", "rapeseed"],
    "SUNFLOWERS": ["sunflowers", "sunflower", "sunflower seeds", "nusun", "oil sunflowers"],
}
# --- fixed values: column roles, each with its header texts ---
HEADER_SYNONYMS = {
    "commodity": ["commodity", "commodities", "grain", "product", "crop"],
    "delivery_period": ["delivery", "delivery period", "delivery date", "delivery month", "delivery start", "delivery end", "del period", "del", "period", "shipment", "ship period", "time frame", "delivery window"],
    "cash_price": ["cash bid", "cash bids", "cash price", "cash", "bid", "bids", "price", "local price", "net price", "posted price", "spot", "spot price", "flat price", "today's bid", "todays bid", "current bid", "your price", "cash bid price", "bid price"],
    "basis": ["basis", "basis level", "basis price", "basis bid", "local basis"],
    "futures_price": ["futures", "futures price", "future", "board", "board price", "settlement", "settle", "settlement price", "cbot", "cme", "futures quote", "market price", "futures settle", "futures close"],
    "futures_month": ["futures month", "futures contract", "board month", "future month", "fut month", "futures symbol"],
    "change": ["change", "chg", "chng", "+/-", "net change", "price change", "move", "chg.", "cash change", "basis change"],
    "last_updated": ["last trade", "last updated", "as of", "updated", "date", "quote time", "last", "trade date", "quote date", "last update"],
    "location": ["location", "elevator", "facility", "branch", "terminal", "delivery point", "station", "city", "site"],
    "notes": ["notes", "comments", "remarks", "info"],
}
AMBIGUOUS_HEADER_WORDS = ["month", "date", "symbol", "price", "contract", "time", "name", "last", "close", "board"]
ROLES = list(HEADER_SYNONYMS)

# --- fixed values: calendar ---
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
MONTH_CODES = "FGHJKMNQUVXZ"  # January to December
LAST_DAY = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]  # 29 February is looked up as such; in other years there is no such date
#: First and last month and day of new-crop delivery.
NEW_CROP = {
    "CORN": (10, 1, 11, 30), "WHITE_CORN": (10, 1, 11, 30), "SOYBEANS": (10, 1, 11, 30),
    "WHEAT": (6, 15, 7, 31), "WHEAT_SRW": (6, 15, 7, 31), "WHEAT_HRW": (6, 15, 7, 31), "WHEAT_HRS": (8, 1, 9, 15),
}
NEW_CROP_OTHER = (10, 1, 11, 30)

# --- fixed values: shapes of cells (anchored at the start; search where used with rlike alone) ---
MONTH_WORD = "(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)"
PRICE = r"^\$?\d{1,2}\.\d{2,4}$"
PRICE_CENTS = r"^\d{3,4}(\.\d{1,2})?$"
BASIS = r"^[+-]\s?\d{0,2}\.\d{2,4}$|^[+-]\s?\d{1,3}$"
EIGHTHS = r"^\d{3,4}-[0-7]s?$"
CHANGE_8THS = r"^[+-]\d+-[0-7]$"
DATE_MDY = r"^\d{1,2}/\d{1,2}/\d{2,4}$"
FUT_MONTH = r"(?i)^(?:\b" + MONTH_WORD + r"[a-z]*\.?\s*'?\d{2}\b|\b[A-Z]{1,3}\s?[FGHJKMNQUVXZ]\d{1,2}\b)"
DATE_RANGE = r"(?i)^\b" + MONTH_WORD + r"[a-z]*\.?\s+\d{1,2}\s*[-–]"
COMMODITY_WORD = r"(?i)\b(corn|soybean|beans|wheat|oats|milo|sorghum|barley|canola|rye|sunflower)"
#: Shapes that a cell can have; how many cells of a column have which says what the column is.
SHAPES = {
    "price": PRICE, "price_cents": PRICE_CENTS, "basis": BASIS, "eighths": EIGHTHS, "change_8ths": CHANGE_8THS, "mdy": DATE_MDY,
    "fut_month": FUT_MONTH, "date_range": DATE_RANGE, "commodity": "(?i)^" + COMMODITY_WORD.removeprefix("(?i)"),
    "month": r"(?i)^\b" + MONTH_WORD, "month_in": r"(?i)\b" + MONTH_WORD,
}

# --- fixed values: words in links, vendors' marks, probing ---
STRONG_LINK = ["cashbid", "cash-bid", "cash_bid", "cashbids"]
WEAK_LINK = ["grain", "markets", "market", "prices", "quotes", "locations", "elevator"]
PENALTY_LINK = ["news", "weather", "agronomy", "careers", "career", "about", "contact", "login", "admin", "blog", "feed", "energy", "fuel", "privacy", "terms", "photo", "gallery", "event", "history", "safety", "employment"]
VENDOR_MARKS = {
    "cloudflare": ["just a moment", "cf-chl", "_cf_chl_opt", "challenge-platform"],
    "barchart": ["websol.barchart.com", "agricharts.com", "barchart.com/ondemand", "bc-cash-bids", "bc-datatable", "acappinstance", "barchart-"],
    "dtn": ["hosted.dtn.com", "dtn.cashbids", "createcashbidstablewidget", "dtn-cash"],
    "bushel_ssr": ["sevencolumnsbigfirst", "cbcommodity", "provided by bushel", "/ws/ws.asmx"],
}
SCRIPTED_VENDORS = ["cloudflare", "barchart", "dtn"]
CHALLENGE_MARKS = ["just a moment", "cf-chl", "challenge-platform"]
PROBE_WORDS = {"corn": "Corn", "soybean": "Soybeans", "beans": "Soybeans", "wheat": "Wheat", "oats": "Oats", "milo": "Milo", "sorghum": "Sorghum", "barley": "Barley", "canola": "Canola", "rye": "Rye", "sunflower": "Sunflowers"}
DIRECTORY_DOMAINS = [
    "facebook.com", "linkedin.com", "instagram.com", "x.com", "twitter.com", "yelp.com", "yellowpages.com", "mapquest.com", "dnb.com", "zoominfo.com",
    "bloomberg.com", "indeed.com", "glassdoor.com", "wikipedia.org", "barchart.com", "agweb.com", "agriculture.com", "farmbucks.com", "agsist.com", "dtnpf.com",
    "youtube.com", "apps.apple.com", "play.google.com", "duckduckgo.com", "bing.com", "microsoft.com", "buzzfile.com", "manta.com", "bizapedia.com", "opencorporates.com",
]

# --- fixed values: texts of notes ---
NOTE_TEXTS = {
    "year_inferred": "delivery year assumed from page date",
    "unit_assumed_cents": "converted from cents",
    "newcrop_window_assumed": "new-crop window estimated",
    "commodity_unrecognized": "commodity name not recognized",
    "delivery_unparsed": "delivery period couldn't be read",
    "basis_out_of_range": "basis value looked off",
}
# --- own wording: what reports say; nothing is compared with it ---
FLAG_NOTICES = {
    "LOW_CONFIDENCE_EXTRACTION": "This table may have been misread.",
    "PARTIAL_COLUMNS": "No column is surely the price.",
    "LAYOUT_CHANGED": "The page is built differently than at earlier scans.",
    "AMBIGUOUS_COLUMNS": "Two columns are too alike to be named.",
    "ARITHMETIC_MISMATCH": "Cash, futures and basis do not agree.",
}
HEALTH_TEXTS = {
    "stale": "No change since {}; the page may be left alone.",
    "stale_hint": "Ask the elevator, or give a newer page.",
    "aging": "Last dated {} days ago; weekends and holidays do that.",
    "flag_hint": "Hold a row against the source page.",
    "fine": "No findings.",
}
LINK_REASONS = {
    "strong": "address or text says cash bids", "mid": "address says bids", "weak": "words of grain markets", "said": "anchor says cash bids",
    "sibling": "sibling of a known bid page", "bad": "words of other matters",
}
NAME_EVIDENCE = {
    "listed": "a directory or social network", "alike": "domain and name are alike", "titled": "title and name are alike",
    "bid": "text says cash bids", "straight": "address is that of a bid page", "section": "homepage links to bids",
}

# --- fixed values: patterns of dates and delivery periods ---
MDY_AT_START = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})"
LONG_DATE = r"(?i)([a-z]+)\s+(\d{1,2}),?\s+(\d{4})"
DATE_TO_DATE = r"(\d{1,2}/\d{1,2}/\d{2,4})\s*[-–]\s*(\d{1,2}/\d{1,2}/\d{2,4})"
DAY_TO_DAY_OF_MONTHS = r"(?i)([a-z]+)\.?\s+(\d{1,2})\s*[-–]\s*([a-z]+)\.?\s+(\d{1,2})(?:\s*,?\s*(\d{4}))?"
DAY_TO_DAY = r"(?i)([a-z]+)\.?\s+(\d{1,2})\s*[-–]\s*(\d{1,2})(?:\s*,?\s*(\d{4}))?"
MONTH_AND_YEAR = r"(?i)^([a-z]+)\.?\s*(\d{4})$"
MONTH_OR_MONTH = r"(?i)^([a-z]+)\s*/\s*([a-z]+)$"

# --- fixed values: patterns of numbers, eighths of a cent and grades ---
EIGHTHS_PARTS = r"^([+-]?)(\d{1,4})-([0-7])(s)?$"
NUMBER = r"[-+]?\d*\.?\d+"
GRADE = r"(?i)^\s*(us\s+)?(#|no\.?\s*)\d\s*"
