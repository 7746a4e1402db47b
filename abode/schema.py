"""Explicit schemas (no inference at scale)."""

from pyspark.sql import types as T

LISTING_FIELDS = [
    ("listing_id", T.StringType()),
    ("property_type", T.StringType()),
    ("title", T.StringType()),
    ("description", T.StringType()),
    ("monthly_rent", T.LongType()),
    ("bedrooms", T.IntegerType()),
    ("bathrooms", T.IntegerType()),
    ("sqft", T.IntegerType()),
    ("street_address", T.StringType()),
    ("city", T.StringType()),
    ("state", T.StringType()),
    ("zip_code", T.StringType()),
    ("available_date", T.DateType()),
    ("lease_term_months", T.IntegerType()),
    ("amenities", T.ArrayType(T.StringType())),
    ("pet_friendly", T.BooleanType()),
    ("parking_available", T.BooleanType()),
    ("furnished", T.BooleanType()),
    ("utilities_included", T.BooleanType()),
    ("created_at", T.TimestampType()),
    ("contact_email", T.StringType()),
    ("contact_phone", T.StringType()),
    ("price_per_sqft", T.DoubleType()),
    ("full_address", T.StringType()),
]

# Logical listing row, as read from JSON / parquet.  `id` is our internal
# BIGINT key (listing_id may repeat); it is optional in files.
LISTING = T.StructType([T.StructField("id", T.LongType())]
                       + [T.StructField(n, t) for n, t in LISTING_FIELDS])

LISTING_COLUMNS = [n for n, _ in LISTING_FIELDS]

# CSV cannot hold arrays: amenities travel as JSON text
LISTING_CSV = T.StructType([
    T.StructField(f.name, T.StringType() if f.name == "amenities" else f.dataType)
    for f in LISTING.fields
])

VECTORS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

# API response projection (declared result model)
RESPONSE_FIELDS = [
    "listing_id", "title", "description", "monthly_rent", "bedrooms", "bathrooms",
    "sqft", "city", "state", "property_type", "amenities", "similarity_score",
    "full_address", "available_date", "contact_email", "contact_phone",
]
