"""Listing generator: golden row and golden aggregates (sf0.01, 2,000 rows)."""
import datetime as dt

from pyspark.sql import functions as F

from abode.plans import registry as RG
from conftest import SF01


def test_golden_row(spark):
    r = RG.listings(spark, SF01).filter("id = 0").collect()[0]
    assert r.listing_id == "SP100000" and r.property_type == "apartment"
    assert (r.bedrooms, r.bathrooms, r.sqft, r.monthly_rent) == (3, 3, 1776, 4294)
    assert (r.city, r.state, r.zip_code, r.lease_term_months) == ("Hyderabad", "TG", "500002", 24)
    assert r.available_date == dt.date(2024, 1, 22)
    assert r.amenities == ["Intercom Facility", "Shopping Centre", "Power Backup", "Piped Gas",
                           "Community Hall", "Semi-Furnished", "Modular Kitchen"]
    assert not any([r.pet_friendly, r.parking_available, r.furnished, r.utilities_included])
    assert r.title == "3 bedroom, 3 bathroom Apartment in Hyderabad"
    assert abs(r.price_per_sqft - 2.417793) < 1e-6
    assert r.full_address == "1 Main Street, Hyderabad, TG 500002"
    assert r.description.startswith("Newly renovated apartment in prime location. 3 bedroom, 3 bathroom "
                                     "spanning 1776 sq ft. Features include: Intercom Facility, ")


def test_golden_aggregates(spark):
    lst = RG.listings(spark, SF01)
    assert lst.count() == 2000
    cities = {r.city: r["count"] for r in lst.groupBy("city").count().collect()}
    assert cities == {"Ahmedabad": 199, "Bangalore": 200, "Chennai": 204, "Delhi": 197, "Hyderabad": 200,
                      "Jaipur": 202, "Kolkata": 199, "Lucknow": 201, "Mumbai": 199, "Pune": 199}
    beds = {r.bedrooms: r["count"] for r in lst.groupBy("bedrooms").count().collect()}
    assert beds == {0: 191, 1: 407, 2: 455, 3: 438, 4: 319, 5: 97, 6: 93}
    flags = lst.agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in
                      ["pet_friendly", "parking_available", "furnished", "utilities_included"]]).collect()[0]
    assert tuple(flags) == (0, 0, 443, 0)
    rng = {r.property_type: (r.lo, r.hi) for r in
           lst.groupBy("property_type").agg(F.min("monthly_rent").alias("lo"),
                                            F.max("monthly_rent").alias("hi")).collect()}
    assert rng == {"apartment": (1086, 10773), "condo": (1230, 9557), "house": (2154, 22570),
                   "studio": (590, 3437), "townhouse": (2448, 13205)}


def test_amenities_distinct_and_sized(spark):
    lst = RG.listings(spark, SF01)
    bad = lst.filter((F.size("amenities") < 3) | (F.size("amenities") > 8)
                     | (F.size(F.array_distinct("amenities")) != F.size("amenities"))).count()
    assert bad == 0
