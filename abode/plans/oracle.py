"""Independent DuckDB SQL for every registered query.

Only the base tables are registered in the oracle, so each statement
rebuilds the listing and request tables with CTEs from the same integer
rules.  The SQL is written from the query semantics, not from the Spark
plan, so agreement is evidence of correctness.
"""

from __future__ import annotations

from abode.constants import (AMENITIES, AMENITY_KEYWORDS, AMENITY_STRIDE, BASE_DATE, BASE_TS,
                             CITIES, DEFAULT_K, DESCRIPTION_OPENERS, ENHANCE_RULES, FLAG_AMENITY,
                             GOLDEN_MESSAGES, HASH_MODULUS, HASH_MULTIPLIERS, INT_LITERAL,
                             LEASE_TERMS, LONG_MAX, PRICE_KEYWORDS, PROPERTY_TYPE_KEYWORDS,
                             PROPERTY_TYPES, UI_BEDROOM_PATTERNS, WS_CLASS)

LONG_MIN_SQL = f"(-{LONG_MAX}::BIGINT - 1)"
LEXICAL_SPLIT = "[^a-z0-9]+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(vals) -> str:
    return "[" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in vals) + "]"


def _r(k: int) -> str:
    return f"((((p_partkey::BIGINT + 1) % {HASH_MODULUS}) * {HASH_MULTIPLIERS[k]}) % {HASH_MODULUS}) // 128"


def _opener() -> str:
    whens = []
    for i, tpl in enumerate(DESCRIPTION_OPENERS):
        parts, rest = [], tpl
        while rest:
            cands = [p for p in (rest.find("{t}"), rest.find("{c}")) if p >= 0]
            if not cands:
                parts.append(lit(rest))
                break
            j = min(cands)
            if j:
                parts.append(lit(rest[:j]))
            parts.append("property_type" if rest[j:j + 3] == "{t}" else "city")
            rest = rest[j + 3:]
        whens.append(f"WHEN {i} THEN " + " || ".join(parts))
    return "(CASE r1 % 5 " + " ".join(whens) + " END)"


def listings_cte() -> str:
    t = [p[0] for p in PROPERTY_TYPES]
    flags = ",\n    ".join(f"list_contains(amenities, {lit(a)}) AS {f}" for f, a in FLAG_AMENITY)
    return f"""
l0 AS (SELECT p_partkey::BIGINT AS id, {", ".join(f"{_r(k)} AS r{k}" for k in range(9))} FROM part),
l1 AS (SELECT *, r0 % {len(PROPERTY_TYPES)} AS t, r1 % {len(CITIES)} AS c FROM l0),
l2 AS (SELECT *, {lst(t)}[t + 1] AS property_type, {lst([x[0] for x in CITIES])}[c + 1] AS city,
    {lst([x[1] for x in CITIES])}[c + 1] AS state,
    ({lst([p[1] for p in PROPERTY_TYPES])}[t + 1] + r2 % ({lst([p[2] for p in PROPERTY_TYPES])}[t + 1]
       - {lst([p[1] for p in PROPERTY_TYPES])}[t + 1] + 1))::INTEGER AS bedrooms,
    ({lst([p[3] for p in PROPERTY_TYPES])}[t + 1] + r4 % ({lst([p[4] for p in PROPERTY_TYPES])}[t + 1]
       - {lst([p[3] for p in PROPERTY_TYPES])}[t + 1] + 1))::INTEGER AS sqft FROM l1),
l3 AS (SELECT *, greatest(1, bedrooms + (r3 % 3)::INTEGER - 1)::INTEGER AS bathrooms,
    ((sqft::BIGINT * 15 * {lst([x[2] for x in CITIES])}[c + 1] * (800 + r5 % 401)) // 100000)::BIGINT AS monthly_rent,
    ({lst([x[3] for x in CITIES])}[c + 1] + r6 % 5)::VARCHAR AS zip_code,
    {lst(LEASE_TERMS)}[(r7 % 4) + 1]::INTEGER AS lease_term_months,
    DATE '{BASE_DATE}' + (r7 % 91)::INTEGER AS available_date,
    list_transform(range(3 + r8 % 6), lambda j: {lst(AMENITIES)}[((r8 + {AMENITY_STRIDE} * j) % {len(AMENITIES)}) + 1]) AS amenities
    FROM l2),
l4 AS (SELECT *, CASE WHEN bedrooms > 0 THEN bedrooms::VARCHAR || ' bedroom, ' || bathrooms::VARCHAR || ' bathroom'
    ELSE 'Studio' END AS btext, ((id % 999) + 1)::VARCHAR || ' Main Street' AS street_address FROM l3),
listings AS (SELECT id, 'SP' || (id + 100000)::VARCHAR AS listing_id, property_type,
    btext || ' ' || upper(left(property_type, 1)) || substr(property_type, 2) || ' in ' || city AS title,
    {_opener()} || '. ' || btext || ' spanning ' || sqft::VARCHAR || ' sq ft. Features include: '
      || array_to_string(amenities[1:3], ', ') || '.' AS description,
    monthly_rent, bedrooms, bathrooms, sqft, street_address, city, state, zip_code, available_date,
    lease_term_months, amenities,
    {flags},
    TIMESTAMP '{BASE_TS}' AS created_at,
    'owner' || id::VARCHAR || '@example.com' AS contact_email,
    '+91' || (id + 9000000000)::VARCHAR AS contact_phone,
    CASE WHEN sqft = 0 THEN NULL ELSE monthly_rent::DOUBLE / sqft::DOUBLE END AS price_per_sqft,
    street_address || ', ' || city || ', ' || state || ' ' || zip_code AS full_address
  FROM l4)"""


def requests_cte(include_golden: bool = True) -> str:
    e = "event_id"
    msg = (f"CASE {e} % 5 "
           f"WHEN 0 THEN (1 + {e} % 4)::VARCHAR || ' bhk in Mumbai under ' || (3000 + ({e} % 9) * 1000)::VARCHAR "
           f"WHEN 1 THEN 'furnished ' || ['apartment', 'condo', 'house'][({e} % 3) + 1] || ' below $' "
           f"|| (4000 + ({e} % 7) * 500)::VARCHAR "
           f"WHEN 2 THEN 'studio with gym' "
           f"WHEN 3 THEN 'affordable family house with pool' "
           f"ELSE (1 + {e} % 5)::VARCHAR || ' bedroom flat less than ' || (5000 + ({e} % 11) * 700)::VARCHAR END")
    sql = (f"SELECT {e}::BIGINT AS qid, user_id::BIGINT AS user_id, ts, {msg} AS msg, "
           f"(CASE WHEN {e} % 4 = 0 THEN {DEFAULT_K} ELSE 5 + {e} % 20 END)::INTEGER AS max_results, "
           f"({e} % (SELECT count(*) FROM embeddings))::BIGINT AS vec_id FROM events")
    if include_golden:
        vals = ", ".join(f"({-(g + 1)}, {lit(m)}, {g})" for g, m in enumerate(GOLDEN_MESSAGES))
        sql += (f" UNION ALL SELECT g.gid::BIGINT, NULL::BIGINT, TIMESTAMP '{BASE_TS}', g.gmsg::VARCHAR, "
                f"{DEFAULT_K}::INTEGER, g.gvec::BIGINT FROM (VALUES {vals}) g(gid, gmsg, gvec)")
    return f"requests AS ({sql})"


def _pyint(t: str) -> str:
    return (f"(CASE WHEN regexp_matches({t}, {lit(INT_LITERAL)}) THEN coalesce(TRY_CAST(replace({t}, '_', '') AS BIGINT), "
            f"CASE WHEN starts_with({t}, '-') THEN {LONG_MIN_SQL} ELSE {LONG_MAX}::BIGINT END) END)")


def _contains_any(words) -> str:
    return "(" + " OR ".join(f"contains(q, {lit(w)})" for w in words) + ")"


def parse_exprs(mode: str = "api") -> dict[str, str]:
    enh = "coalesce(msg, '')" + "".join(
        f" || CASE WHEN {_contains_any(ws)} THEN {lit(ph)} ELSE '' END" for ws, ph in ENHANCE_RULES)
    branches = []
    for kw in PRICE_KEYWORDS:
        last = kw.split()[-1]
        pos = f"coalesce(list_position(toks, {lit(last)}), 0)"
        tok = f"replace(replace(toks[{pos} + 1], '$', ''), ',', '')"
        branches.append(f"CASE WHEN contains(q, {lit(kw)}) AND {pos} > 0 THEN {_pyint(tok)} END")
    price = "coalesce(" + ", ".join(branches) + ")"
    if mode == "api":
        d = f"regexp_extract(q, {lit('([0-9]+)' + WS_CLASS + '*(bhk|bedroom)')}, 1)"
        beds = (f"CASE WHEN contains(q, 'studio') THEN 0::BIGINT WHEN {d} <> '' THEN "
                f"coalesce(TRY_CAST({d} AS BIGINT), {LONG_MAX}::BIGINT) END")
    else:
        beds = "CASE " + " ".join(f"WHEN contains(q, {lit(p)}) THEN {v}::BIGINT" for p, v in UI_BEDROOM_PATTERNS) + " END"
    ptype = "CASE " + " ".join(f"WHEN contains(q, {lit(p)}) THEN {lit(p)}" for p in PROPERTY_TYPE_KEYWORDS) + " END"
    amen = ("list_filter([" + ", ".join(f"CASE WHEN contains(q, {lit(k)}) THEN {lit(n)} END" for k, n in AMENITY_KEYWORDS)
            + "], lambda x: x IS NOT NULL)")
    return {"enhanced": enh, "max_price": price, "want_bedrooms": beds, "want_type": ptype,
            "want_amenities": amen}


def parsed_cte(mode: str = "api", name: str = "parsed", src: str = "requests") -> str:
    ex = parse_exprs(mode)
    cols = ", ".join(f"{v} AS {k}" for k, v in ex.items())
    return (f"{name} AS (SELECT qid, msg, coalesce(max_results, {DEFAULT_K}) AS max_results, vec_id, {cols} FROM "
            f"(SELECT *, lower(coalesce(msg, '')) AS q, "
            f"list_filter(regexp_split_to_array(lower(coalesce(msg, '')), {lit(WS_CLASS + '+')}), lambda x: x <> '') AS toks "
            f"FROM {src}))")


# -- predicates (on a row holding both request and listing columns) ---------

def pred_price() -> str:
    return "(max_price IS NULL OR coalesce(monthly_rent, 0) <= max_price)"


def pred_bedrooms() -> str:
    return "(want_bedrooms IS NULL OR coalesce(bedrooms, 0)::BIGINT = want_bedrooms)"


def pred_type() -> str:
    return "(want_type IS NULL OR lower(coalesce(property_type, '')) = want_type)"


def pred_flags() -> str:
    return "(" + " AND ".join(f"(NOT list_contains(want_amenities, {lit(f)}) OR coalesce({f}, false))"
                              for f, _ in FLAG_AMENITY) + ")"


def pred_amenity(name: str, mode: str) -> str:
    a = "coalesce(amenities, []::VARCHAR[])"
    if mode == "api":
        hit = f"len(list_filter({a}, lambda x: contains(lower(x), {lit(name)}))) > 0"
    else:
        hit = f"list_contains(list_transform({a}, lambda x: lower(x)), {lit(name)})"
    return f"(NOT list_contains(want_amenities, {lit(name)}) OR {hit})"


def pred_all(mode: str) -> str:
    return " AND ".join([pred_price(), pred_bedrooms(), pred_type(), pred_flags(),
                         pred_amenity("pool", mode), pred_amenity("gym", mode)])


# -- ranking ----------------------------------------------------------------

def vector_hits_cte(parsed: str = "parsed") -> str:
    return f"""
corpus AS (SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id IN (SELECT id FROM listings)),
qkeys AS (SELECT vec_id, max(max_results) AS kq FROM {parsed} GROUP BY vec_id),
qv AS (SELECT q.vec_id, q.kq, e.embedding FROM qkeys q JOIN embeddings e ON e.vec_id = q.vec_id),
scored AS (SELECT qv.vec_id, c.id,
    list_inner_product(qv.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS similarity_score FROM qv, corpus c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity_score DESC, id) AS search_rank FROM scored),
hits AS (SELECT p.qid, r.id, r.similarity_score, r.search_rank::INTEGER AS search_rank
    FROM {parsed} p JOIN ranked r ON r.vec_id = p.vec_id WHERE r.search_rank <= p.max_results)"""


def profile_sql() -> str:
    n = lambda c: f"coalesce({c}::VARCHAR, 'None')"
    feats = ("concat_ws(', ', CASE WHEN pet_friendly THEN 'pet-friendly' END, CASE WHEN parking_available THEN "
             "'parking available' END, CASE WHEN furnished THEN 'furnished' END, CASE WHEN utilities_included THEN "
             "'utilities included' END)")
    return (f"coalesce(bedrooms::VARCHAR, '0') || ' BHK ' || {n('property_type')} || ' in ' || {n('city')} || ', ' || "
            f"{n('state')} || ' ' || {n('zip_code')} || ' with ' || {n('sqft')} || ' sqft, ₹' || {n('monthly_rent')} || "
            f"' monthly, ' || {n('bathrooms')} || ' bathrooms, amenities: ' || "
            f"coalesce(nullif(array_to_string(coalesce(amenities, []::VARCHAR[]), ', '), ''), 'basic amenities') || "
            f"', features: ' || coalesce(nullif({feats}, ''), 'standard features') || '. ' || "
            f"coalesce(description, '') || ' ' || coalesce(title, '')")


def _tok(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({expr}, '')), {lit(LEXICAL_SPLIT)}), lambda x: x <> '')"


def lexical_hits_cte(parsed: str = "parsed") -> str:
    return f"""
lq AS (SELECT coalesce(enhanced, '') AS qtext, max(max_results) AS kq FROM {parsed} GROUP BY 1),
qt AS (SELECT qtext, tok, count(*) AS tf FROM (SELECT qtext, unnest({_tok('qtext')}) AS tok FROM lq) GROUP BY 1, 2),
qn AS (SELECT qtext, sqrt(sum(tf * tf)::DOUBLE) AS n FROM qt GROUP BY 1),
dt AS (SELECT id, tok, count(*) AS tf FROM (SELECT id, unnest({_tok(profile_sql())}) AS tok FROM listings) GROUP BY 1, 2),
dn AS (SELECT id, sqrt(sum(tf * tf)::DOUBLE) AS n FROM dt GROUP BY 1),
dots AS (SELECT qt.qtext, dt.id, sum(qt.tf * dt.tf) AS dot FROM qt JOIN dt ON qt.tok = dt.tok GROUP BY 1, 2),
lscored AS (SELECT d.qtext, d.id, d.dot::DOUBLE / (qn.n * dn.n) AS similarity_score
    FROM dots d JOIN qn ON qn.qtext = d.qtext JOIN dn ON dn.id = d.id),
lranked AS (SELECT *, row_number() OVER (PARTITION BY qtext ORDER BY similarity_score DESC, id) AS search_rank FROM lscored),
hits AS (SELECT p.qid, r.id, r.similarity_score, r.search_rank::INTEGER AS search_rank
    FROM {parsed} p JOIN lranked r ON r.qtext = coalesce(p.enhanced, '') WHERE r.search_rank <= p.max_results)"""


def terms_cte() -> str:
    """Terms of the listing profiles with their weights, and each profile's (id, tok, w)."""
    return f"""
dtf AS (SELECT id, tok, count(*) AS tf FROM (SELECT id, unnest({_tok(profile_sql())}) AS tok FROM listings) GROUP BY 1, 2),
vocab AS (SELECT tok, count(*) AS df, round(1000 * ln(((SELECT count(*) FROM listings) + 1.0) / (count(*) + 1.0)))::BIGINT AS idf
    FROM dtf GROUP BY 1),
dt AS (SELECT id, dtf.tok, tf * idf AS w FROM dtf JOIN vocab ON vocab.tok = dtf.tok WHERE idf > 0)"""


def terms_hits_cte(parsed: str = "parsed") -> str:
    return terms_cte() + f""",
lq AS (SELECT coalesce(enhanced, '') AS qtext, max(max_results) AS kq FROM {parsed} GROUP BY 1),
qtf AS (SELECT qtext, tok, count(*) AS tf FROM (SELECT qtext, unnest({_tok('qtext')}) AS tok FROM lq) GROUP BY 1, 2),
qt AS (SELECT qtext, qtf.tok, tf * idf AS w FROM qtf JOIN vocab ON vocab.tok = qtf.tok WHERE idf > 0),
qn AS (SELECT qtext, sqrt(sum(w * w)::DOUBLE) AS n FROM qt GROUP BY 1),
dn AS (SELECT id, sqrt(sum(w * w)::DOUBLE) AS n FROM dt GROUP BY 1),
dots AS (SELECT qt.qtext, dt.id, sum(qt.w * dt.w) AS dot FROM qt JOIN dt ON qt.tok = dt.tok GROUP BY 1, 2),
lscored AS (SELECT d.qtext, d.id, d.dot::DOUBLE / (qn.n * dn.n) AS similarity_score
    FROM dots d JOIN qn ON qn.qtext = d.qtext JOIN dn ON dn.id = d.id),
lranked AS (SELECT *, row_number() OVER (PARTITION BY qtext ORDER BY similarity_score DESC, id) AS search_rank FROM lscored),
hits AS (SELECT p.qid, r.id, r.similarity_score, r.search_rank::INTEGER AS search_rank
    FROM {parsed} p JOIN lranked r ON r.qtext = coalesce(p.enhanced, '') WHERE r.search_rank <= p.max_results)"""


def joined_cte(parsed: str = "parsed") -> str:
    """Ranked hits with the request constraints and the listing row."""
    return f"""
joined AS (SELECT h.qid, h.similarity_score, h.search_rank, p.max_price, p.want_bedrooms, p.want_type,
    p.want_amenities, l.* FROM hits h JOIN {parsed} p ON p.qid = h.qid JOIN listings l ON l.id = h.id)"""


def kept_cte(mode: str, parsed: str = "parsed") -> str:
    return joined_cte(parsed) + f""",
kept AS (SELECT * FROM joined WHERE {pred_all(mode)})"""


def fmt_thousands(x: str) -> str:
    return f"format('{{:,}}', {x})"


def conversation_requests_cte() -> str:
    return (f"requests AS (SELECT (conv_id * 1000000 + turn)::BIGINT AS qid, conv_id::BIGINT AS user_id, "
            f"TIMESTAMP '{BASE_TS}' AS ts, text AS msg, {DEFAULT_K}::INTEGER AS max_results, "
            f"NULL::BIGINT AS vec_id FROM conversations WHERE role = 'user')")


def chat_sql(ranking: str = "vector", golden: bool = True, mode: str = "api", requests: str | None = None) -> str:
    """Whole request pipeline: requests, parse, brute-force ranking,
    post-filter, one response per request."""
    hits = {"vector": vector_hits_cte, "lexical": lexical_hits_cte, "encoded": terms_hits_cte}[ranking]()
    return (with_(listings_cte(), requests or requests_cte(golden), parsed_cte(mode), hits, kept_cte(mode),
                  response_agg_cte())
            + "\n" + response_body())


def response_agg_cte() -> str:
    return """
agg AS (SELECT qid, count(*) AS total_found,
    array_to_string(list_sort(list_distinct(list(property_type))), ', ') AS types,
    array_to_string(list_sort(list_distinct(list(city))), ', ') AS cities,
    min(monthly_rent) AS lo, max(monthly_rent) AS hi,
    string_agg(listing_id, ',' ORDER BY search_rank) AS hit_ids,
    string_agg(search_rank::VARCHAR, ',' ORDER BY search_rank) AS hit_ranks
  FROM kept GROUP BY qid)"""


def response_body(parsed: str = "parsed") -> str:
    return f"""
SELECT p.qid,
  CASE WHEN coalesce(a.total_found, 0) = 0
    THEN 'No properties matched your search for ''' || coalesce(p.msg, '') || '''. Try adjusting your filters.'
    ELSE 'Found ' || a.total_found::VARCHAR || ' ' || a.types || ' in ' || a.cities || ' from ₹' ||
      {fmt_thousands('a.lo')} || ' to ₹' || {fmt_thousands('a.hi')} || '/month.' END AS message,
  coalesce(a.total_found, 0)::INTEGER AS total_found, p.enhanced AS query_processed,
  coalesce(a.hit_ids, '') AS hit_ids, coalesce(a.hit_ranks, '') AS hit_ranks
FROM {parsed} p LEFT JOIN agg a ON a.qid = p.qid"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes if c.strip())
