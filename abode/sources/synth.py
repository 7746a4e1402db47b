"""Deterministic, distributed listing generator.

Each listing is a pure function of its integer key (``part.p_partkey``): a
per-column integer hash picks type, city, sizes, rent and amenities through
constant arrays, so generation is one narrow projection — no join, no
shuffle, no Python — and scales with the key table.  The expressions are
Spark SQL text built from the constants (parsed once on the JVM).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from abode.constants import (AMENITIES, AMENITY_STRIDE, BASE_DATE, BASE_TS, CITIES,
                             DESCRIPTION_OPENERS, FLAG_AMENITY, HASH_MODULUS, HASH_MULTIPLIERS,
                             LEASE_TERMS, PROPERTY_TYPES)
from abode.schema import LISTING


def _q(s: str) -> str:
    """Spark SQL string literal (backslash escapes)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _arr(vals) -> str:
    return "array(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in vals) + ")"


def key_hash_sql(key: str, k: int) -> str:
    """r(k) = (((key + 1) mod M) * P[k] mod M) div 128 — never overflows BIGINT."""
    return f"(pmod(pmod({key} + 1, {HASH_MODULUS}) * {HASH_MULTIPLIERS[k]}, {HASH_MODULUS}) div 128)"


def _pick(vals, idx: str) -> str:
    return f"element_at({_arr(vals)}, CAST({idx} AS INT) + 1)"


def _opener_sql() -> str:
    parts = []
    for tpl in DESCRIPTION_OPENERS:
        pieces, rest = [], tpl
        while rest:
            cands = [p for p in (rest.find("{t}"), rest.find("{c}")) if p >= 0]
            if not cands:
                pieces.append(_q(rest))
                break
            j = min(cands)
            if j:
                pieces.append(_q(rest[:j]))
            pieces.append("property_type" if rest[j:j + 3] == "{t}" else "city")
            rest = rest[j + 3:]
        parts.append("concat(" + ", ".join(pieces) + ")")
    return f"element_at(array({', '.join(parts)}), CAST(pmod(__r1, 5) AS INT) + 1)"


def _stage_sql():
    t = [p[0] for p in PROPERTY_TYPES]
    bmin, bmax = [p[1] for p in PROPERTY_TYPES], [p[2] for p in PROPERTY_TYPES]
    smin, smax = [p[3] for p in PROPERTY_TYPES], [p[4] for p in PROPERTY_TYPES]
    s1 = ["__k"] + [f"{key_hash_sql('__k', i)} AS __r{i}" for i in range(9)]
    s2 = ["*",
          f"{_pick(t, 'pmod(__r0, 5)')} AS property_type",
          f"{_pick([c[0] for c in CITIES], 'pmod(__r1, 10)')} AS city",
          f"{_pick([c[1] for c in CITIES], 'pmod(__r1, 10)')} AS state",
          f"{_pick([c[2] for c in CITIES], 'pmod(__r1, 10)')} AS __mult",
          f"{_pick([c[3] for c in CITIES], 'pmod(__r1, 10)')} AS __zip0",
          f"CAST({_pick(bmin, 'pmod(__r0, 5)')} + pmod(__r2, {_pick(bmax, 'pmod(__r0, 5)')} - "
          f"{_pick(bmin, 'pmod(__r0, 5)')} + 1) AS INT) AS bedrooms",
          f"CAST({_pick(smin, 'pmod(__r0, 5)')} + pmod(__r4, {_pick(smax, 'pmod(__r0, 5)')} - "
          f"{_pick(smin, 'pmod(__r0, 5)')} + 1) AS INT) AS sqft",
          f"transform(sequence(0, CAST(2 + pmod(__r8, 6) AS INT)), j -> element_at({_arr(AMENITIES)}, "
          f"CAST(pmod(__r8 + {AMENITY_STRIDE} * j, {len(AMENITIES)}) AS INT) + 1)) AS amenities"]
    s3 = ["*",
          "CAST(greatest(1, bedrooms + CAST(pmod(__r3, 3) AS INT) - 1) AS INT) AS bathrooms",
          "(CAST(sqft AS BIGINT) * 15 * __mult * (800 + pmod(__r5, 401))) div 100000 AS monthly_rent",
          "CAST(__zip0 + pmod(__r6, 5) AS STRING) AS zip_code",
          f"CAST({_pick(LEASE_TERMS, 'pmod(__r7, 4)')} AS INT) AS lease_term_months",
          f"date_add(DATE '{BASE_DATE}', CAST(pmod(__r7, 91) AS INT)) AS available_date"]
    btext = ("CASE WHEN bedrooms > 0 THEN concat(CAST(bedrooms AS STRING), ' bedroom, ', "
             "CAST(bathrooms AS STRING), ' bathroom') ELSE 'Studio' END")
    s4 = ["*", f"{btext} AS __btext",
          "concat(CAST(pmod(__k, 999) + 1 AS STRING), ' Main Street') AS street_address"]
    flags = [f"array_contains(amenities, {_q(a)}) AS {f}" for f, a in FLAG_AMENITY]
    s5 = ["__k AS id",
          "concat('SP', CAST(__k + 100000 AS STRING)) AS listing_id",
          "property_type",
          "concat(__btext, ' ', initcap(property_type), ' in ', city) AS title",
          f"concat({_opener_sql()}, '. ', __btext, ' spanning ', CAST(sqft AS STRING), "
          "' sq ft. Features include: ', array_join(slice(amenities, 1, 3), ', '), '.') AS description",
          "monthly_rent", "bedrooms", "bathrooms", "sqft", "street_address", "city", "state", "zip_code",
          "available_date", "lease_term_months", "amenities", *flags,
          f"TIMESTAMP '{BASE_TS}' AS created_at",
          "concat('owner', CAST(__k AS STRING), '@example.com') AS contact_email",
          "concat('+91', CAST(__k + 9000000000 AS STRING)) AS contact_phone",
          "try_divide(CAST(monthly_rent AS DOUBLE), CAST(sqft AS DOUBLE)) AS price_per_sqft",
          "concat(street_address, ', ', city, ', ', state, ' ', zip_code) AS full_address"]
    return s1, s2, s3, s4, s5


_STAGES = _stage_sql()


def synth_listings(keys: DataFrame, key_col: str = "p_partkey") -> DataFrame:
    """Listings for every key row, with the full logical schema."""
    df = keys.selectExpr(f"CAST({key_col} AS BIGINT) AS __k")
    for stage in _STAGES:
        df = df.selectExpr(*stage)
    return df.select(*[f.name for f in LISTING.fields])


# keys of a partition, above which a key table is dealt anew
PIECE_ROWS = 50_000


def dealt(keys: DataFrame) -> DataFrame:
    """A key table of more than ``PIECE_ROWS`` rows as partitions of about that
    many, at least one a core: a key is 8 bytes and its listing several hundred, so
    files whose splits suit their size (or that are one row group) would leave
    all listings to a few tasks.  Smaller tables keep their splits."""
    n = keys.count()
    if n <= PIECE_ROWS:
        return keys
    return keys.repartition(max(keys.sparkSession.sparkContext.defaultParallelism, math.ceil(n / PIECE_ROWS)))
