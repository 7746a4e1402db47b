"""Fixed values shared by the Spark operators and the SQL oracles.

Everything under "FIXED VALUES" must equal the behaviour being reproduced
(vocabulary of the listing generator, request-parser keywords, phrases and
message texts).  They are stated plainly, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — listing vocabulary (generator)
# ---------------------------------------------------------------------------

# property type -> (min_bedrooms, max_bedrooms, min_sqft, max_sqft)
PROPERTY_TYPES = [
    ("apartment", 1, 4, 500, 2000),
    ("house", 2, 6, 1000, 4000),
    ("condo", 1, 3, 600, 1800),
    ("townhouse", 2, 4, 1200, 2500),
    ("studio", 0, 1, 300, 700),
]

# city -> (state, rent multiplier x10, first zip code; five consecutive zips)
CITIES = [
    ("Mumbai", "MH", 32, 400001),
    ("Delhi", "DL", 28, 110001),
    ("Bangalore", "KA", 25, 560001),
    ("Hyderabad", "TG", 20, 500001),
    ("Chennai", "TN", 22, 600001),
    ("Pune", "MH", 21, 411001),
    ("Kolkata", "WB", 20, 700001),
    ("Ahmedabad", "GJ", 18, 380001),
    ("Jaipur", "RJ", 16, 302001),
    ("Lucknow", "UP", 15, 226001),
]

AMENITIES = [
    "Lift", "Power Backup", "Reserved Parking", "Security Guard", "Modular Kitchen",
    "24x7 Water Supply", "Gated Society", "CCTV Surveillance", "Piped Gas",
    "Vaastu Compliant", "Club House", "Children's Play Area", "Intercom Facility",
    "Gymnasium", "Swimming Pool", "Community Hall", "Rain Water Harvesting",
    "Maintenance Staff", "Visitor Parking", "Shopping Centre", "Park View",
    "Furnished", "Semi-Furnished", "Unfurnished", "RO Water System",
]

LEASE_TERMS = [6, 12, 18, 24]

# description openers; {t} = property type, {c} = city
DESCRIPTION_OPENERS = [
    "Beautiful {t} in the heart of {c}",
    "Modern {t} with stunning city views",
    "Spacious {t} perfect for urban living",
    "Newly renovated {t} in prime location",
    "Luxury {t} with premium amenities",
]

# boolean listing flag -> amenity name whose exact presence sets it
FLAG_AMENITY = [
    ("pet_friendly", "Pet Friendly"),
    ("parking_available", "Parking"),
    ("furnished", "Furnished"),
    ("utilities_included", "Utilities Included"),
]
FLAG_COLUMNS = [f for f, _ in FLAG_AMENITY]

# ---------------------------------------------------------------------------
# FIXED VALUES — request handling
# ---------------------------------------------------------------------------

# query enhancement: (trigger substrings, appended phrase), applied in order
ENHANCE_RULES = [
    (["cheap", "affordable", "budget"], " low cost economical"),
    (["luxury", "upscale", "premium"], " high-end expensive luxury amenities"),
    (["family"], " spacious multiple bedrooms safe neighborhood"),
    (["young professional", "professional"], " modern amenities downtown urban"),
]

PRICE_KEYWORDS = ["under", "below", "less than", "max", "maximum"]

# UI-mode bedroom patterns, first hit wins
UI_BEDROOM_PATTERNS = [
    ("studio", 0), ("1 bedroom", 1), ("2 bedroom", 2), ("3 bedroom", 3),
    ("4 bedroom", 4), ("5 bedroom", 5),
]

PROPERTY_TYPE_KEYWORDS = ["apartment", "house", "condo", "townhouse", "studio"]

# request keyword -> amenity constraint name, in order
AMENITY_KEYWORDS = [
    ("pet", "pet_friendly"),
    ("parking", "parking_available"),
    ("furnished", "furnished"),
    ("utilities", "utilities_included"),
    ("pool", "pool"),
    ("gym", "gym"),
]

NO_MATCH_UI = "No matches found. Try a different query."
UI_MAX_CARDS = 5

DEFAULT_K = 10

# ---------------------------------------------------------------------------
# Our own deterministic constants (test-data derivation, not reference values)
# ---------------------------------------------------------------------------

# Per-column multipliers of the integer hash r(k) = ((id+1) * P[k] mod M) div 128
HASH_MODULUS = 2147483647
HASH_MULTIPLIERS = [742938285, 950706376, 1226874159, 62089911, 1343714438,
                    630360016, 1583458089, 784588716, 1103515245]
AMENITY_STRIDE = 7
BASE_DATE = "2024-01-01"
BASE_TS = "2024-01-01 00:00:00"

# Python's str.split() whitespace set, written for Java regex and RE2 alike
WS_CLASS = ("[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}"
            "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")

# Python int() literal syntax, ASCII digits
INT_LITERAL = "^[+-]?[0-9]+(_[0-9]+)*$"

LONG_MAX = 9223372036854775807
LONG_MIN = -9223372036854775808

# Golden requests (README examples, sample queries, UI placeholder, then
# one per parser trap).  qid -(g+1) in the request log, vector vec_id = g.
GOLDEN_MESSAGES = [
    "2 BHK in Mumbai under ₹30000",
    "furnished flat with parking in Delhi",
    "studio in Pune with gym",
    "luxury apartment in Bangalore",
    "2 BHK flat in Bangalore with lift and CCTV",
    "Furnished apartment in Mumbai under ₹30,000",
    "Studio in Pune near park",
    "Vaastu compliant flat in Chennai with power backup",
    "Furnished 2BHK office in Gurgaon under ₹1L",
    "2 bedroom apartment under $30,000",
    "townhouse below 5000",
    "house for less than 6000",
    "more than 2 baths less than 30000",
    "maximum 4000 condo",
    "thunder max 3500 condo",
    "under budget below 7000",
    "studio apartment with pool",
    "unfurnished 11 bedroom house",
    "3   bhk carpet under 30_000",
    "cheap family house for a young professional with pool and gym under 9000",
    "flat under",
    "condo under 12.5 max 4500",
    "",
]
