"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes (spark, sf_dir) and returns a DataFrame over the whole
input tables.  Arrays are emitted as joined strings, dates/timestamps as
text and floating scores rounded to 6 digits, so both engines hash alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.constants import FLAG_COLUMNS
from abode.functions import derive, parse, predicates
from abode.operators import partials, search, stats
from abode.operators.encode import coverage
from abode.operators.matches import matching_counts
from abode.operators.topk import inner_product, join_ranked
from abode.plans import oracle as O
from abode.schema import LISTING_COLUMNS, RESPONSE_FIELDS
from abode.session import fresh_path
from abode.sources import files
from abode.sources.requests import request_log, validate_k, vector_count
from abode.sources.synth import dealt, synth_listings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ANSWERED_AT = "2024-01-01 00:00:00"


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# inputs
# ---------------------------------------------------------------------------

_SCHEMAS: dict[str, object] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; the footer schema is discovered once per path and then
    passed explicitly (plain Python StructType, valid across sessions)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        df = spark.read.parquet(path)
        _SCHEMAS[path] = df.schema
        return df
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def listings(spark, sf_dir) -> DataFrame:
    return synth_listings(dealt(read(spark, sf_dir, "part").select("p_partkey")))


def embeddings(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def requests(spark, sf_dir, golden: bool = True) -> DataFrame:
    ev = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return request_log(spark, ev, vector_count(read(spark, sf_dir, "embeddings").select("vec_id")),
                       include_golden=golden)


def parsed(spark, sf_dir, mode="api") -> DataFrame:
    return parse.parse_request(validate_k(requests(spark, sf_dir)), mode=mode)


def _r6(c) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def _j(c, sep=",") -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


def _listing_out(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "listing_id", "property_type", "title", "description", "monthly_rent", "bedrooms",
        "bathrooms", "sqft", "street_address", "city", "state", "zip_code",
        F.date_format("available_date", "yyyy-MM-dd").alias("available_date"), "lease_term_months",
        _j("amenities", "|").alias("amenities"), *FLAG_COLUMNS,
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "contact_email", "contact_phone", _r6("price_per_sqft").alias("price_per_sqft"), "full_address")


LISTING_OUT_SQL = """SELECT id, listing_id, property_type, title, description, monthly_rent, bedrooms, bathrooms, sqft,
  street_address, city, state, zip_code, strftime(available_date, '%Y-%m-%d') AS available_date, lease_term_months,
  array_to_string(amenities, '|') AS amenities, pet_friendly, parking_available, furnished, utilities_included,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, contact_email, contact_phone,
  round(price_per_sqft, 6) AS price_per_sqft, full_address FROM """

L = O.listings_cte()
R = O.requests_cte(True)
PA = O.parsed_cte("api")
PU = O.parsed_cte("ui")

# ---------------------------------------------------------------------------
# S: sources / generator
# ---------------------------------------------------------------------------


@register("synth_listings", O.with_(L) + "\n" + LISTING_OUT_SQL + "listings")
def q_synth_listings(spark, sf_dir):
    return _listing_out(listings(spark, sf_dir))


@register("load_json", O.with_(L) + "\n" + LISTING_OUT_SQL + "listings")
def q_load_json(spark, sf_dir):
    """Write the listings as JSON lines to the shared folder, read them back."""
    path = files.save_listings_json(listings(spark, sf_dir), fresh_path(spark, "listings-json"))
    return _listing_out(files.load_listings(spark, path, "json"))


@register("load_csv", O.with_(L) + "\n" + LISTING_OUT_SQL + "listings")
def q_load_csv(spark, sf_dir):
    """CSV round trip: amenities travel as JSON text and are parsed back."""
    path = files.save_listings_csv(listings(spark, sf_dir), fresh_path(spark, "listings-csv"))
    return _listing_out(files.load_listings(spark, path, "csv"))


@register("load_json_array", O.with_(L) + "\n" + LISTING_OUT_SQL + "listings")
def q_load_json_array(spark, sf_dir):
    """JSON array documents of bounded size, read back whole."""
    path = files.save_listings_array(listings(spark, sf_dir), fresh_path(spark, "listings-array"))
    return _listing_out(files.load_listings(spark, path, "json"))


@register("load_json_text_amenities", O.with_(L) + "\n" + LISTING_OUT_SQL + "listings")
def q_load_json_text_amenities(spark, sf_dir):
    """JSON lines whose amenities are JSON text and whose numbers are text."""
    l = listings(spark, sf_dir).withColumn("amenities", F.to_json("amenities")).withColumns(
        {c: F.col(c).cast("string") for c in ("id", "monthly_rent", "bedrooms", "sqft")})
    return _listing_out(files.load_listings(spark, files.save_listings_json(l, fresh_path(spark, "listings-text")), "json"))


@register("load_csv_floats", O.with_(L) + "\n" + LISTING_OUT_SQL + "listings")
def q_load_csv_floats(spark, sf_dir):
    """CSV whose whole numbers are written as decimals ("25000.0")."""
    l = listings(spark, sf_dir).withColumns(
        {c: F.concat(F.col(c).cast("string"), F.lit(".0")) for c in ("id", "monthly_rent", "bedrooms", "bathrooms", "sqft", "lease_term_months")})
    return _listing_out(files.load_listings(spark, files.save_listings_csv(l, fresh_path(spark, "listings-floats")), "csv"))


@register("coerce_amenities", O.with_(L) + """
SELECT id, array_to_string(amenities, '|') AS amenities_json, '' AS amenities_repr, 0 AS repr_len FROM listings""")
def q_coerce_amenities(spark, sf_dir):
    """JSON text parses to the list; Python-repr text (single quotes) -> []."""
    l = listings(spark, sf_dir)
    t = l.select("id", F.to_json("amenities").alias("j"), files.python_repr_list(F.col("amenities")).alias("p"))
    return t.select("id", _j(files.coerce_amenities(F.col("j")), "|").alias("amenities_json"),
                    _j(files.coerce_amenities(F.col("p")), "|").alias("amenities_repr"),
                    F.size(files.coerce_amenities(F.col("p"))).alias("repr_len"))


@register("corpus_roundtrip", O.with_(L) + """
SELECT l.id, l.listing_id, len(e.embedding)::INTEGER AS dim FROM listings l JOIN embeddings e ON e.vec_id = l.id""")
def q_corpus_roundtrip(spark, sf_dir):
    """Build-or-load the persisted corpus (listings + vectors as parquet)."""
    out = fresh_path(spark, "corpus")
    vec = search.vector_corpus(listings(spark, sf_dir), embeddings(spark, sf_dir))
    lst, v = files.prepare_corpus(spark, listings(spark, sf_dir), vec, out)
    lst2, v2 = files.load_corpus(spark, out)  # second call: load path
    return lst2.join(v2, "id").select("id", "listing_id", F.size("embedding").alias("dim"))


# ---------------------------------------------------------------------------
# P: derived columns
# ---------------------------------------------------------------------------

@register("price_per_sqft", O.with_(L) + "\nSELECT id, monthly_rent, sqft, round(price_per_sqft, 6) AS price_per_sqft FROM listings")
def q_price_per_sqft(spark, sf_dir):
    l = listings(spark, sf_dir)
    return l.select("id", "monthly_rent", "sqft",
                    _r6(derive.price_per_sqft(F.col("monthly_rent"), F.col("sqft"))).alias("price_per_sqft"))


@register("full_address", O.with_(L) + "\nSELECT id, full_address FROM listings")
def q_full_address(spark, sf_dir):
    l = listings(spark, sf_dir)
    return l.select("id", derive.full_address(F.col("street_address"), F.col("city"), F.col("state"),
                                              F.col("zip_code")).alias("full_address"))


@register("bedroom_text", O.with_(L) + """
SELECT id, CASE WHEN bedrooms > 0 THEN bedrooms::VARCHAR || ' bedroom, ' || bathrooms::VARCHAR || ' bathroom'
  ELSE 'Studio' END AS bedroom_text FROM listings""")
def q_bedroom_text(spark, sf_dir):
    l = listings(spark, sf_dir)
    return l.select("id", derive.bedroom_text(F.col("bedrooms"), F.col("bathrooms")).alias("bedroom_text"))


@register("listing_title", O.with_(L) + "\nSELECT id, title FROM listings")
def q_listing_title(spark, sf_dir):
    return listings(spark, sf_dir).select("id", "title")


@register("listing_description", O.with_(L) + "\nSELECT id, description FROM listings")
def q_listing_description(spark, sf_dir):
    return listings(spark, sf_dir).select("id", "description")


@register("listing_flags", O.with_(L) + "\nSELECT id, " + ", ".join(FLAG_COLUMNS) + " FROM listings")
def q_listing_flags(spark, sf_dir):
    return listings(spark, sf_dir).select("id", *derive.listing_flags(F.col("amenities")))


@register("rent_model", O.with_(L) + "\nSELECT id, city, property_type, sqft, monthly_rent FROM listings")
def q_rent_model(spark, sf_dir):
    return listings(spark, sf_dir).select("id", "city", "property_type", "sqft", "monthly_rent")


@register("profile_text", O.with_(L) + f"\nSELECT id, {O.profile_sql()} AS profile_text FROM listings")
def q_profile_text(spark, sf_dir):
    return listings(spark, sf_dir).select("id", derive.profile_text().alias("profile_text"))


@register("numeric_coerce", O.with_(L) + """
SELECT id, TRY_CAST(monthly_rent::VARCHAR AS DOUBLE) AS rent_num, TRY_CAST(sqft::VARCHAR AS DOUBLE) AS sqft_num,
  TRY_CAST(zip_code AS DOUBLE) AS zip_num, TRY_CAST(street_address AS DOUBLE) AS street_num FROM listings""")
def q_numeric_coerce(spark, sf_dir):
    l = listings(spark, sf_dir)
    return l.select("id", derive.numeric_coerce(F.col("monthly_rent")).alias("rent_num"),
                    derive.numeric_coerce(F.col("sqft")).alias("sqft_num"),
                    derive.numeric_coerce(F.col("zip_code")).alias("zip_num"),
                    derive.numeric_coerce(F.col("street_address")).alias("street_num"))


# ---------------------------------------------------------------------------
# Q: request parsing
# ---------------------------------------------------------------------------

def _parse_sql(select: str, mode="api") -> str:
    return O.with_(R, O.parsed_cte(mode)) + "\n" + select + " FROM parsed"


@register("enhance_query", _parse_sql("SELECT qid, enhanced"))
def q_enhance_query(spark, sf_dir):
    return parsed(spark, sf_dir).select("qid", "enhanced")


@register("parse_max_price", _parse_sql("SELECT qid, max_price"))
def q_parse_max_price(spark, sf_dir):
    return parsed(spark, sf_dir).select("qid", "max_price")


@register("parse_bedrooms", _parse_sql("SELECT qid, want_bedrooms AS bedrooms"))
def q_parse_bedrooms(spark, sf_dir):
    return parsed(spark, sf_dir).select("qid", F.col("want_bedrooms").alias("bedrooms"))


@register("parse_bedrooms_ui", _parse_sql("SELECT qid, want_bedrooms AS bedrooms", "ui"))
def q_parse_bedrooms_ui(spark, sf_dir):
    return parsed(spark, sf_dir, "ui").select("qid", F.col("want_bedrooms").alias("bedrooms"))


@register("parse_property_type", _parse_sql("SELECT qid, want_type AS property_type"))
def q_parse_property_type(spark, sf_dir):
    return parsed(spark, sf_dir).select("qid", F.col("want_type").alias("property_type"))


@register("parse_amenities", _parse_sql("SELECT qid, array_to_string(want_amenities, ',') AS amenities"))
def q_parse_amenities(spark, sf_dir):
    return parsed(spark, sf_dir).select("qid", _j("want_amenities").alias("amenities"))


@register("parse_request", O.with_(R, PA, O.parsed_cte("ui", "parsed_ui")) + """
SELECT p.qid, p.enhanced, p.max_price, p.want_bedrooms AS bedrooms, u.want_bedrooms AS bedrooms_ui,
  p.want_type AS property_type, array_to_string(p.want_amenities, ',') AS amenities
FROM parsed p JOIN parsed_ui u ON u.qid = p.qid""")
def q_parse_request(spark, sf_dir):
    p = parsed(spark, sf_dir)
    ui = parse.parse_bedrooms_ui("coalesce(msg, '')")
    return p.select("qid", "enhanced", "max_price", F.col("want_bedrooms").alias("bedrooms"),
                    ui.alias("bedrooms_ui"), F.col("want_type").alias("property_type"),
                    _j("want_amenities").alias("amenities"))


# ---------------------------------------------------------------------------
# F: post-filters over the ranked hits (the reference filters top-k results)
# ---------------------------------------------------------------------------

def _hits_joined(spark, sf_dir, mode="api"):
    p = parsed(spark, sf_dir, mode)
    l = listings(spark, sf_dir).select("id", *search.FILTER_FIELDS)
    # listing attributes ride on the per-key ranking, before expansion to requests
    hits = search.vector_hits(p, l, embeddings(spark, sf_dir), carry=search.CONSTRAINT_COLS,
                              with_listings=True)
    return search.attach(hits, p, l)


def _filter_sql(pred: str, mode="api") -> str:
    return (O.with_(L, R, O.parsed_cte(mode), O.vector_hits_cte(), O.joined_cte())
            + f"\nSELECT qid, id, search_rank FROM joined WHERE {pred}")


def _filter_query(name, pred_spark, pred_sql, mode="api"):
    @register(name, _filter_sql(pred_sql, mode))
    def q(spark, sf_dir):
        return _hits_joined(spark, sf_dir, mode).filter(pred_spark()).select("qid", "id", "search_rank")
    q.__name__ = f"q_{name}"
    return q


_filter_query("filter_max_price", lambda: predicates.price_ok(F.col("max_price"), F.col("monthly_rent")),
              O.pred_price())
_filter_query("filter_bedrooms", lambda: predicates.bedrooms_ok(F.col("want_bedrooms"), F.col("bedrooms")),
              O.pred_bedrooms())
_filter_query("filter_property_type", lambda: predicates.type_ok(F.col("want_type"), F.col("property_type")),
              O.pred_type())
_filter_query("filter_flags", lambda: predicates.flags_ok(F.col("want_amenities")), O.pred_flags())
_filter_query("filter_amenity_contains",
              lambda: (predicates.amenity_contains_ok(F.col("want_amenities"), "pool")
                       & predicates.amenity_contains_ok(F.col("want_amenities"), "gym")),
              O.pred_amenity("pool", "api") + " AND " + O.pred_amenity("gym", "api"))
_filter_query("filter_amenity_exact",
              lambda: (predicates.amenity_exact_ok(F.col("want_amenities"), "pool")
                       & predicates.amenity_exact_ok(F.col("want_amenities"), "gym")),
              O.pred_amenity("pool", "ui") + " AND " + O.pred_amenity("gym", "ui"), "ui")
_filter_query("filter_all", lambda: predicates.all_ok("api"), O.pred_all("api"))


def _matches_sql(mode: str) -> str:
    return f"""(SELECT c.k, count(l.id) AS n FROM (SELECT DISTINCT {_CONSTRAINTS}, {_CONSTRAINT_KEY} AS k FROM parsed_{mode}) c
  LEFT JOIN listings l ON {O.pred_all(mode)} GROUP BY c.k)"""


_CONSTRAINTS = "max_price, want_bedrooms, want_type, want_amenities"
_CONSTRAINT_KEY = "concat_ws('|', coalesce(max_price::VARCHAR, '-'), coalesce(want_bedrooms::VARCHAR, '-'), coalesce(want_type, '-'), want_amenities::VARCHAR)"


@register("filter_counts", O.with_(L, R, O.parsed_cte("api", "parsed_api"), O.parsed_cte("ui", "parsed_ui")) + f"""
SELECT a.qid, x.n AS matches_api, y.n AS matches_ui FROM (SELECT qid, {_CONSTRAINT_KEY} AS k FROM parsed_api) a
JOIN {_matches_sql("api")} x ON x.k = a.k JOIN (SELECT qid, {_CONSTRAINT_KEY} AS k FROM parsed_ui) u ON u.qid = a.qid
JOIN {_matches_sql("ui")} y ON y.k = u.k""")
def q_filter_counts(spark, sf_dir):
    """Listings of the whole table that meet all constraints of each request, by both rule sets."""
    l = listings(spark, sf_dir)
    api, ui = (matching_counts(parsed(spark, sf_dir, m), l, m).withColumnRenamed("matches", f"matches_{m}") for m in ("api", "ui"))
    return api.join(ui, "qid")


# ---------------------------------------------------------------------------
# V: vectors and ranking
# ---------------------------------------------------------------------------

@register("vector_check", O.with_(L) + """
SELECT e.vec_id AS id, len(e.embedding)::INTEGER AS dim,
  abs(sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) - 1) < 1e-5 AS unit_norm
FROM embeddings e WHERE e.vec_id IN (SELECT id FROM listings)""")
def q_vector_check(spark, sf_dir):
    v = search.vector_corpus(listings(spark, sf_dir), embeddings(spark, sf_dir))
    return v.select("id", F.size("embedding").alias("dim"),
                    (F.abs(F.sqrt(inner_product("embedding", "embedding")) - 1) < 1e-5)
                    .alias("unit_norm"))


@register("vector_coverage", O.with_(L, R) + """,
v AS (SELECT vec_id, len(embedding) AS d, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT (SELECT count(*) FROM listings) AS listings,
  (SELECT count(*) FROM listings WHERE id NOT IN (SELECT vec_id FROM v)) AS listings_without_vector,
  (SELECT count(*) FROM requests) AS requests,
  (SELECT count(*) FROM requests WHERE vec_id IS NULL OR vec_id NOT IN (SELECT vec_id FROM v)) AS requests_without_vector,
  (SELECT count(*) FROM v) AS vectors, (SELECT count(DISTINCT d) FROM v) AS dimensions,
  (SELECT count(*) FROM v WHERE NOT abs(n - 1) < 1e-5) AS norm_breaches""")
def q_vector_coverage(spark, sf_dir):
    """What the vector ranking can't see: listings and requests without a
    vector, and vectors that break the index's dimension or norm."""
    return coverage(requests(spark, sf_dir), listings(spark, sf_dir), embeddings(spark, sf_dir))


@register("topk_batch", O.with_(L, R, PA, O.vector_hits_cte()) + """
SELECT h.qid, h.id, l.listing_id, round(h.similarity_score, 6) AS similarity_score, h.search_rank
FROM hits h JOIN listings l ON l.id = h.id""")
def q_topk_batch(spark, sf_dir):
    p = parsed(spark, sf_dir)
    l = listings(spark, sf_dir).select("id", "listing_id")
    h = search.vector_hits(p, l, embeddings(spark, sf_dir), with_listings=True)
    return h.select("qid", "id", "listing_id", _r6("similarity_score").alias("similarity_score"), "search_rank")


@register("vector_score", O.with_(L, R, PA, O.vector_hits_cte()) + """
SELECT h.qid, h.id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
FROM hits h JOIN parsed p ON p.qid = h.qid JOIN embeddings q ON q.vec_id = p.vec_id
JOIN embeddings c ON c.vec_id = h.id""")
def q_vector_score(spark, sf_dir):
    """JVM-only inner product (higher-order functions) for every ranked pair —
    cross-checks the Arrow matrix kernel; only the ranked pairs are scored."""
    p = parsed(spark, sf_dir)
    e = embeddings(spark, sf_dir)
    ranked, bound = search.rank_vectors(p, listings(spark, sf_dir), e)
    # score each ranked (key, listing) pair once, then expand to the requests
    qv = e.select("vec_id", F.col("embedding").alias("qe"))
    cv = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("ce"))
    scored = (ranked.join(qv, "vec_id").join(cv, "id")
                    .select("vec_id", "id", "search_rank", inner_product("qe", "ce").alias("score")))
    h = (join_ranked(p.select("qid", "vec_id", "max_results"), scored, bound, "vec_id")
         .filter(F.col("search_rank") <= F.col("max_results")))
    return h.select("qid", "id", _r6("score").alias("score"))


@register("topk_single", O.with_(L) + """,
corpus AS (SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id IN (SELECT id FROM listings)),
scored AS (SELECT c.id, list_inner_product((SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[],
  c.embedding::DOUBLE[]) AS s FROM corpus c)
SELECT id, round(s, 6) AS similarity_score, (row_number() OVER (ORDER BY s DESC, id))::INTEGER AS search_rank
FROM scored QUALIFY search_rank <= 10""")
def q_topk_single(spark, sf_dir):
    """One query vector (vec_id 0) against the whole corpus: a scalar
    subquery supplies the vector, TakeOrderedAndProject keeps the top 10."""
    e = embeddings(spark, sf_dir)
    corpus = search.vector_corpus(listings(spark, sf_dir), e)
    qvec = e.where(F.col("vec_id") == 0).select("embedding").scalar()
    # the scalar is evaluated once; HOFs may not contain subqueries, so project it first
    scored = (corpus.select("id", "embedding", qvec.alias("qe"))
                    .select("id", inner_product("qe", "embedding").alias("s")))
    top = scored.orderBy(F.desc("s"), F.asc("id")).limit(10)
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("s"), F.asc("id"))
    return top.select("id", _r6("s").alias("similarity_score"),
                      F.row_number().over(w).cast("int").alias("search_rank"))


@register("topk_all_pairs", O.with_(L) + """,
corpus AS (SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id IN (SELECT id FROM listings)),
scored AS (SELECT q.id AS q_id, c.id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s
  FROM corpus q, corpus c)
SELECT q_id, id, round(s, 6) AS similarity_score,
  (row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id))::INTEGER AS search_rank
FROM scored QUALIFY search_rank <= 10""")
def q_topk_all_pairs(spark, sf_dir):
    """Every indexed vector as a query against the whole index, top 10 (the
    """
    corpus = search.vector_corpus(listings(spark, sf_dir), embeddings(spark, sf_dir))
    q = corpus.select(F.col("id").alias("q_id"), "embedding", F.lit(10).alias("k"))
    from abode.operators.topk import exact_topk
    h = exact_topk(q, corpus, qkey="q_id", qcol="embedding", kcol="k", ckey="id", ccol="embedding",
                   score_col="similarity_score", rank_col="search_rank")
    return h.select("q_id", "id", _r6("similarity_score").alias("similarity_score"), "search_rank")


@register("topk_tied_listings", O.with_(L) + """,
corpus AS (SELECT l.id, e.embedding FROM listings l JOIN embeddings e ON e.vec_id = l.id % (SELECT count(*) FROM embeddings)),
scored AS (SELECT q.vec_id, c.id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s
  FROM embeddings q, corpus c)
SELECT vec_id, id, round(s, 6) AS similarity_score,
  (row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, id))::INTEGER AS search_rank
FROM scored QUALIFY search_rank <= 25""")
def q_topk_tied_listings(spark, sf_dir):
    """Every vector against an index of all listings, each with the vector that
    its id is dealt to: where listings outnumber vectors, several share one and
    ties go by key in any block layout."""
    from abode.operators.topk import exact_topk_of_members
    e = embeddings(spark, sf_dir).select("vec_id", "embedding")
    n = e.agg(F.count("*").alias("n")).scalar()
    members = listings(spark, sf_dir).select("id", n.alias("n")).select("id", F.pmod("id", "n").alias("vec_id"))
    h = exact_topk_of_members(e.withColumn("k", F.lit(25)), e, members, qkey="vec_id", qcol="embedding", kcol="k", vkey="vec_id",
                              vcol="embedding", ckey="id", score_col="similarity_score", rank_col="search_rank")
    return h.select("vec_id", "id", _r6("similarity_score").alias("similarity_score"), "search_rank")


@register("topk_cells", """
WITH scored AS (SELECT q.vec_id, c.vec_id AS hit_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s
  FROM embeddings q, embeddings c)
SELECT vec_id, hit_id, round(s, 6) AS similarity_score,
  (row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, hit_id))::INTEGER AS search_rank
FROM scored QUALIFY search_rank <= 10""")
def q_topk_cells(spark, sf_dir):
    """Every vector against the whole vector table, by cells that can hold a hit."""
    from abode.operators.cells import cell_topk
    e = embeddings(spark, sf_dir).select("vec_id", "embedding")
    h = cell_topk(e.withColumn("k", F.lit(10)), e.withColumnRenamed("vec_id", "hit_id"), qkey="vec_id", qcol="embedding", kcol="k",
                  ckey="hit_id", ccol="embedding", score_col="similarity_score", rank_col="search_rank")
    return h.select("vec_id", "hit_id", _r6("similarity_score").alias("similarity_score"), "search_rank")


@register("search_hits", O.with_(L, R, PA, O.vector_hits_cte()) + """
SELECT h.qid, h.search_rank, l.listing_id, l.title, l.city, l.monthly_rent,
  round(h.similarity_score, 6) AS similarity_score FROM hits h JOIN listings l ON l.id = h.id""")
def q_search_hits(spark, sf_dir):
    p = parsed(spark, sf_dir)
    l = listings(spark, sf_dir).select("id", "listing_id", "title", "city", "monthly_rent")
    h = search.vector_hits(p, l, embeddings(spark, sf_dir), with_listings=True)
    return h.select("qid", "search_rank", "listing_id", "title", "city", "monthly_rent",
                    _r6("similarity_score").alias("similarity_score"))


@register("lexical_topk", O.with_(L, R, PA, O.lexical_hits_cte()) + """
SELECT qid, id, round(similarity_score, 6) AS similarity_score, search_rank FROM hits""")
def q_lexical_topk(spark, sf_dir):
    p = parsed(spark, sf_dir)
    h = search.lexical_hits(p, listings(spark, sf_dir))
    return h.select("qid", "id", _r6("similarity_score").alias("similarity_score"), "search_rank")


@register("encode_terms", O.with_(L, O.terms_cte()) + """,
ids AS (SELECT tok, row_number() OVER (ORDER BY tok) - 1 AS term_id, df, idf FROM vocab)
SELECT dt.id, ids.term_id, dt.tok AS term, ids.df, dt.w AS weight FROM dt JOIN ids ON ids.tok = dt.tok""")
def q_encode_terms(spark, sf_dir):
    """Every listing profile as the (term, weight) pairs of its own terms."""
    from abode.operators.terms import term_weights, vocabulary
    texts = search.profile_texts(listings(spark, sf_dir))
    words = vocabulary(texts)
    pairs = term_weights(texts, words).select("id", F.explode(F.arrays_zip("embedding.terms", "embedding.weights")).alias("p"))
    pairs = pairs.select("id", F.col("p.terms").alias("term_id"), F.col("p.weights").alias("weight"))
    return pairs.join(words.select("term_id", "term", "df"), "term_id").select("id", "term_id", "term", "df", "weight")


@register("encode_profiles", O.with_(L) + """
SELECT id, 1024 AS dim, true AS unit_norm FROM listings""")
def q_encode_profiles(spark, sf_dir):
    """Every listing profile encoded (default 1,024 hashed TF-IDF features)
    to one L2-normalised vector.  The oracle checks the contract (one vector
    per listing, dimension, unit norm); the hashed values themselves are
    checked against a numpy brute force in tests/test_encoder.py."""
    from abode.operators.encode import encode_profiles, measured
    _, enc = encode_profiles(listings(spark, sf_dir))
    return enc.select("id", measured("embedding").alias("m")).select("id", "m.dim", (F.abs(F.col("m.norm") - 1) < 1e-5).alias("unit_norm"))


# ---------------------------------------------------------------------------
# A: statistics
# ---------------------------------------------------------------------------

@register("stats_overview", O.with_(L) + """
SELECT count(*) AS total_properties, count(DISTINCT city::VARCHAR) AS cities,
  round(avg(TRY_CAST(monthly_rent::VARCHAR AS DOUBLE)), 6) AS avg_rent,
  min(TRY_CAST(monthly_rent::VARCHAR AS DOUBLE)) AS min_rent, max(TRY_CAST(monthly_rent::VARCHAR AS DOUBLE)) AS max_rent,
  round(avg(TRY_CAST(sqft::VARCHAR AS DOUBLE)), 6) AS avg_sqft,
  CASE WHEN count(*) = 0 THEN 'No data loaded' END AS error FROM listings""")
def q_stats_overview(spark, sf_dir):
    s = stats.stats_overview(listings(spark, sf_dir))
    return s.select("total_properties", "cities", _r6("avg_rent").alias("avg_rent"), "min_rent", "max_rent",
                    _r6("avg_sqft").alias("avg_sqft"), "error")


_KEPT = O.with_(L) + """
SELECT count(*) AS total_properties, count(DISTINCT city::VARCHAR) AS cities,
  round(avg(TRY_CAST(monthly_rent::VARCHAR AS DOUBLE)), 6) AS avg_rent,
  min(TRY_CAST(monthly_rent::VARCHAR AS DOUBLE)) AS min_rent, max(TRY_CAST(monthly_rent::VARCHAR AS DOUBLE)) AS max_rent,
  round(avg(TRY_CAST(sqft::VARCHAR AS DOUBLE)), 6) AS avg_sqft,
  CASE WHEN count(*) = 0 THEN 'No data loaded' END AS error FROM listings"""


def _kept_statistics(spark, sf_dir):
    """States of three deliveries that together are all listings: the small, the large, and those without a size."""
    l, out, rooms = listings(spark, sf_dir), fresh_path(spark, "statistics"), F.col("bedrooms")
    partials.add_all({"small": l.where(rooms < 2), "large": l.where(rooms >= 2), "unknown": l.where(rooms.isNull())}, out)
    return out


@register("stats_kept", _KEPT)
def q_stats_kept(spark, sf_dir):
    """The overview of all deliveries from their kept states."""
    s = partials.overview(partials.merged(spark, _kept_statistics(spark, sf_dir)))
    return s.select("total_properties", "cities", _r6("avg_rent").alias("avg_rent"), "min_rent", "max_rent",
                    _r6("avg_sqft").alias("avg_sqft"), "error")


@register("stats_kept_counts", O.with_(L) + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS measure, {c}::VARCHAR AS value, count(*) AS count FROM listings WHERE {c} IS NOT NULL GROUP BY ALL" for c in partials.VALUES)
    + " UNION ALL SELECT 'amenity', a, count(*) FROM (SELECT unnest(amenities) AS a FROM listings) WHERE a IS NOT NULL GROUP BY ALL")
def q_stats_kept_counts(spark, sf_dir):
    """Every value count of all deliveries from their kept states."""
    state = partials.merged(spark, _kept_statistics(spark, sf_dir))
    return state.where(F.col("measure").isin(*partials.VALUES, "amenity")).select("measure", F.col("key").alias("value"), F.col("n").alias("count"))


@register("amenity_heavy_hitters", O.with_(L) + """
SELECT amenity, count(*) AS count FROM (SELECT unnest(amenities) AS amenity FROM listings)
GROUP BY 1 ORDER BY count DESC, amenity LIMIT 10""")
def q_amenity_heavy_hitters(spark, sf_dir):
    """The ten most frequent amenities by the united sketches of all deliveries."""
    return partials.heavy_hitters(spark, _kept_statistics(spark, sf_dir))


@register("stats_public", O.with_(L) + """
SELECT count(*) AS total_properties, count(DISTINCT city::VARCHAR) AS cities FROM listings""")
def q_stats_public(spark, sf_dir):
    return stats.stats_public(listings(spark, sf_dir))


@register("stats_by_type", O.with_(L) + "\nSELECT property_type, count(*) AS count FROM listings WHERE property_type IS NOT NULL GROUP BY 1")
def q_stats_by_type(spark, sf_dir):
    return stats.value_counts(listings(spark, sf_dir), "property_type")


@register("stats_index", O.with_(L) + """
SELECT count(embedding) AS index_size, max(len(embedding))::INTEGER AS embedding_dimension
FROM embeddings WHERE vec_id IN (SELECT id FROM listings)""")
def q_stats_index(spark, sf_dir):
    return stats.stats_index(search.vector_corpus(listings(spark, sf_dir), embeddings(spark, sf_dir)))


@register("distinct_values", O.with_(L) + """
SELECT DISTINCT 'city' AS field, city AS value FROM listings WHERE city IS NOT NULL
UNION SELECT DISTINCT 'property_type', property_type FROM listings WHERE property_type IS NOT NULL""")
def q_distinct_values(spark, sf_dir):
    return stats.distinct_values(listings(spark, sf_dir))


@register("bedroom_histogram", O.with_(L) + "\nSELECT bedrooms, count(*) AS count FROM listings GROUP BY 1")
def q_bedroom_histogram(spark, sf_dir):
    return stats.bedroom_histogram(listings(spark, sf_dir))


@register("top_amenities", O.with_(L) + """
SELECT amenity, count(*) AS count FROM (SELECT unnest(amenities) AS amenity FROM listings)
GROUP BY 1 ORDER BY count DESC, amenity LIMIT 10""")
def q_top_amenities(spark, sf_dir):
    return stats.top_amenities(listings(spark, sf_dir))


@register("preview", O.with_(L) + "\nSELECT id, listing_id, city FROM listings ORDER BY id LIMIT 3")
def q_preview(spark, sf_dir):
    return stats.preview(listings(spark, sf_dir))


@register("column_profile", O.with_(L) + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, {i} AS position, count({c}) AS non_null FROM listings"
    for i, c in enumerate(["id"] + LISTING_COLUMNS)))
def q_column_profile(spark, sf_dir):
    return stats.column_profile(listings(spark, sf_dir))


@register("city_counts", O.with_(L) + "\nSELECT city, count(*) AS count FROM listings WHERE city IS NOT NULL GROUP BY 1")
def q_city_counts(spark, sf_dir):
    return stats.city_counts(listings(spark, sf_dir))


# ---------------------------------------------------------------------------
# C: request pipelines
# ---------------------------------------------------------------------------

def _chat_out(resp: DataFrame) -> DataFrame:
    return resp.selectExpr(
        "qid", "message", "total_found", "query_processed",
        "array_join(properties.listing_id, ',') AS hit_ids",
        "array_join(transform(properties, x -> CAST(x.search_rank AS STRING)), ',') AS hit_ranks")


def _chat(spark, sf_dir, mode="api", ranking="vector", golden=True, fields=("listing_id",), cards=False):
    """Responses carrying only the listing fields the query outputs."""
    return search.chat_batch(requests(spark, sf_dir, golden), listings(spark, sf_dir),
                             embeddings(spark, sf_dir), mode=mode, ranking=ranking,
                             answered_at=F.lit(ANSWERED_AT).cast("timestamp"), fields=fields, cards=cards)


@register("chat_batch", O.chat_sql("vector"))
def q_chat_batch(spark, sf_dir):
    return _chat_out(_chat(spark, sf_dir))


@register("response_message", f"SELECT qid, message FROM ({O.chat_sql('vector')})")
def q_response_message(spark, sf_dir):
    return _chat(spark, sf_dir).select("qid", "message")


@register("chat_lexical", O.chat_sql("lexical"))
def q_chat_lexical(spark, sf_dir):
    return _chat_out(_chat(spark, sf_dir, ranking="lexical"))


@register("chat_conversations", O.chat_sql("lexical", requests=O.conversation_requests_cte()))
def q_chat_conversations(spark, sf_dir):
    """User turns of ``conversations`` answered as requests: whole
    multilingual message texts, parsed, ranked by lexical cosine against the
    listing profiles, post-filtered and summarised."""
    from abode.sources.requests import requests_from_conversations
    reqs = requests_from_conversations(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    resp = search.chat_batch(reqs, listings(spark, sf_dir), embeddings(spark, sf_dir), ranking="lexical",
                             answered_at=F.lit(ANSWERED_AT).cast("timestamp"), fields=("listing_id",))
    return _chat_out(resp)


@register("chat_encoded", O.chat_sql("encoded"))
def q_chat_encoded(spark, sf_dir):
    """The reproduced service's flow end to end: enhanced request text and
    listing profiles through one encoder (weights of real terms, fitted on the
    profiles), exact top-k by cosine, post-filter, responses."""
    return _chat_out(_chat(spark, sf_dir, ranking="encoded"))


_CARD_SQL = ("'\U0001f3e0 ' || title || ' — ₹' || monthly_rent::VARCHAR || '/mo in ' || city || ', ' || state || chr(10) "
             "|| description || chr(10) || 'Contact: ' || contact_email")


@register("chat_ui", O.with_(L, R, PU, O.vector_hits_cte(), O.kept_cte("ui")) + f""",
cards AS (SELECT qid, count(*) AS total_found, string_agg(listing_id, ',' ORDER BY search_rank) AS hit_ids,
  string_agg(CASE WHEN rn <= 5 THEN {_CARD_SQL} END, chr(10) || chr(10) ORDER BY search_rank) AS display
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY search_rank) AS rn FROM kept) GROUP BY qid)
SELECT p.qid, coalesce(c.total_found, 0)::INTEGER AS total_found, coalesce(c.hit_ids, '') AS hit_ids,
  coalesce(c.display, 'No matches found. Try a different query.') AS display
FROM parsed p LEFT JOIN cards c ON c.qid = p.qid""")
def q_chat_ui(spark, sf_dir):
    resp = _chat(spark, sf_dir, mode="ui", cards=True)
    return resp.selectExpr("qid", "total_found", "array_join(properties.listing_id, ',') AS hit_ids", "display")


@register("display_cards", O.with_(L, R, PU, O.vector_hits_cte(), O.kept_cte("ui")) + f""",
cards AS (SELECT qid, string_agg({_CARD_SQL}, chr(10) || chr(10) ORDER BY search_rank) AS display
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY search_rank) AS rn FROM kept) WHERE rn <= 5 GROUP BY qid)
SELECT p.qid, coalesce(c.display, 'No matches found. Try a different query.') AS display
FROM parsed p LEFT JOIN cards c ON c.qid = p.qid""")
def q_display_cards(spark, sf_dir):
    return _chat(spark, sf_dir, mode="ui", cards=True).select("qid", "display")


@register("response_projection", O.with_(L, R, PA, O.vector_hits_cte(), O.kept_cte("api")) + """
SELECT qid, search_rank, listing_id, title, description, monthly_rent, bedrooms, bathrooms, sqft, city, state,
  property_type, array_to_string(amenities, '|') AS amenities, round(similarity_score, 6) AS similarity_score,
  full_address, strftime(available_date, '%Y-%m-%d') AS available_date, contact_email, contact_phone FROM kept""")
def q_response_projection(spark, sf_dir):
    resp = _chat(spark, sf_dir, fields=tuple(RESPONSE_FIELDS))
    x = resp.select("qid", F.explode("properties").alias("p")).select("qid", "p.*")
    return x.select("qid", "search_rank", *[
        _j("amenities", "|").alias("amenities") if c == "amenities"
        else _r6("similarity_score").alias("similarity_score") if c == "similarity_score"
        else F.date_format("available_date", "yyyy-MM-dd").alias("available_date") if c == "available_date"
        else F.col(c) for c in RESPONSE_FIELDS])


@register("chat_stream", O.chat_sql("vector", golden=False))
def q_chat_stream(spark, sf_dir):
    """The request log read as a stream (file source, availableNow), each
    micro-batch answered against the static corpus; returns the sink."""
    from abode.streaming.chat_stream import run_chat_stream
    sink = run_chat_stream(spark, sf_dir, listings(spark, sf_dir), embeddings(spark, sf_dir),
                           answered_at=ANSWERED_AT)
    return _chat_out(sink)


@register("chat_stream_requests", O.chat_sql("lexical", requests=O.conversation_requests_cte()))
def q_chat_stream_requests(spark, sf_dir):
    """Free-text requests (the user turns of ``conversations``) arriving as
    files, streamed and answered by lexical ranking; equals the batch answer."""
    from abode.session import fresh_path
    from abode.sources.requests import requests_from_conversations
    from abode.streaming.chat_stream import run_chat_stream
    src = fresh_path(spark, "requests")
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    requests_from_conversations(conversations).select("qid", "msg", "max_results").write.parquet(src)
    return _chat_out(run_chat_stream(spark, src, listings(spark, sf_dir), embeddings(spark, sf_dir),
                                     answered_at=ANSWERED_AT, glob="*.parquet", ranking="lexical"))
