"""Request pipeline: enhance -> rank -> parse -> post-filter -> summarise.

Requests and listings are tables; every step is a DataFrame operator.
Ranking is computed once per *distinct query key* (vector id, or enhanced
text for lexical and encoded search) with the largest k asked for that key,
so a popular request costs one ranking, however many users send it.

Two ways back to the requests:

* exploded hits (``vector_hits`` / ``lexical_hits``): one row per request
  and ranked listing, for the hit-level queries;
* per-request answers (``chat_batch``): each key's ranking becomes one
  array, joined to its requests one row each, then post-filtered and
  summarised inside the row; no requests x k rows and no shuffle on qid.

Either join broadcasts the ranking under its proven bound; otherwise it
shuffles on (key, salt), with hot keys salted (``topk.salted_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from abode.constants import FLAG_COLUMNS, NO_MATCH_UI, UI_MAX_CARDS
from abode.functions import predicates
from abode.functions.derive import profile_text
from abode.functions.parse import parse_request
from abode.operators.matches import offered_bits, wanted_bits
from abode.operators.topk import BROADCAST_BYTES_MAX, est_row_bytes, exact_topk, join_ranked, salted_join
from abode.schema import RESPONSE_FIELDS
from abode.session import shared_dir
from abode.sources.requests import validate_k

LEXICAL_SPLIT = "[^a-z0-9]+"


def text_tokens(text: Column) -> Column:
    """Lower-cased a-z0-9 runs of the whole text (one regex split, JVM-side)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), LEXICAL_SPLIT), "")


def vector_corpus(listings: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, embedding) for listings that have a vector (semi join: only keys move)."""
    e = embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return e.join(listings.select("id"), "id", "left_semi")


def rank_vectors(requests: DataFrame, listings: DataFrame, embeddings: DataFrame, **topk_opts):
    """Ranking per distinct request vector with the largest k asked for it:
    ((vec_id, id, similarity_score, search_rank), proven row bound)."""
    per_key = requests.groupBy("vec_id").agg(F.max("max_results").alias("kq"))
    qv = per_key.join(embeddings.select("vec_id", "embedding"), "vec_id")
    return exact_topk(qv, vector_corpus(listings, embeddings), qkey="vec_id", qcol="embedding",
                      kcol="kq", ckey="id", ccol="embedding", kind="dense",
                      score_col="similarity_score", rank_col="search_rank", with_bound=True,
                      **topk_opts)


def attach_listings(ranked: DataFrame, bound: int, listings: DataFrame) -> DataFrame:
    """Listing columns onto a per-key ranking (keys x k rows, before any
    expansion to requests).  When its proven bound times its row width fits
    the byte budget the ranking is broadcast and the listing table streams
    past it without a shuffle; otherwise both sides shuffle on the listing id."""
    small = bound * est_row_bytes(ranked.schema) <= BROADCAST_BYTES_MAX
    return listings.join(F.broadcast(ranked) if small else ranked, "id")


def vector_hits(requests: DataFrame, listings: DataFrame, embeddings: DataFrame,
                carry=(), with_listings: bool = False, **topk_opts) -> DataFrame:
    """(qid, id, similarity_score, search_rank, *carry) with rank <= max_results.

    The request vector is ``embeddings`` at the request's ``vec_id``; ``carry``
    request columns ride along so later steps need no join back on qid.
    ``with_listings`` attaches the listing row to the per-key ranking (keys x k
    rows) before it is expanded to requests (requests x k rows)."""
    ranked, bound = rank_vectors(requests, listings, embeddings, **topk_opts)
    if with_listings:
        ranked = attach_listings(ranked, bound, listings)
    return (join_ranked(requests.select("qid", "vec_id", "max_results", *carry), ranked, bound, "vec_id")
            .filter(F.col("search_rank") <= F.col("max_results"))
            .select("qid", "id", "similarity_score", "search_rank", *carry,
                    *([c for c in listings.columns if c != "id"] if with_listings else [])))


def profile_corpus(listings: DataFrame) -> DataFrame:
    """(id, terms) with the listing profile text tokenised."""
    return listings.select("id", text_tokens(profile_text()).alias("terms"))


def _qtext(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def text_key(text_col: str) -> Column:
    """Key of a request text: 32 characters however long the text is.  Blocks,
    rankings, merges, caches and joins carry it instead of the text."""
    return F.md5(_qtext(text_col))


def distinct_texts(requests: DataFrame, text_col: str) -> DataFrame:
    """(qkey, qtext, kq): each distinct request text with the largest k asked for it."""
    return (requests.groupBy(_qtext(text_col).alias("qtext")).agg(F.max("max_results").alias("kq"))
            .select(text_key("qtext").alias("qkey"), "qtext", "kq"))


def signatures(texts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qkey, kq, skey, terms) of the texts (qkey, kq, terms) that share a term
    with the corpus: texts with the same counts of such terms and the same
    length rank alike and get one ``skey``.

    ``terms`` is the struct <terms, weights> of those counts.  What the terms
    that no listing has add to the length (a whole number) follows as squares
    under names that no token has, so cosines are the same numbers."""
    counts = texts.select("qkey", "kq", F.explode("terms").alias("term")).groupBy("qkey", "kq", "term").agg(F.count(F.lit(1)).alias("tf"))
    held = corpus.select(F.explode("terms").alias("term")).distinct()
    known = counts.select("term").distinct().join(held, "term", "left_semi").withColumn("known", F.lit(True))
    pair = F.when(F.col("known"), F.struct("term", "tf"))
    rows = (counts.join(known, "term", "left").groupBy("qkey", "kq").agg(F.array_sort(F.collect_list(pair)).alias("t"), F.sum(F.expr("tf * tf")).alias("n"))
            .where(F.size("t") > 0))
    root = "CAST(floor(sqrt(a.r)) AS BIGINT)"
    rest = "n - aggregate(t, 0L, (a, x) -> a + x.tf * x.tf)"
    squares = (f"aggregate(sequence(1, 16), named_struct('r', {rest}, 'w', CAST(array() AS ARRAY<BIGINT>)), (a, i) -> named_struct("
               f"'r', a.r - {root} * {root}, 'w', IF(a.r > 0, concat(a.w, array({root})), a.w))).w")
    return rows.withColumn("w", F.expr(squares)).selectExpr(
        "qkey", "kq", "md5(to_json(struct(t, w))) AS skey",
        "struct(concat(t.term, transform(w, (x, i) -> concat(' ', CAST(i AS STRING)))) AS terms, concat(t.tf, w) AS weights) AS terms")


# distinct signatures to a tile: each block of them builds the listings' inverted lists once
SIGNATURE_BLOCK = 16384


def rank_texts(requests: DataFrame, listings: DataFrame, text_col: str = "enhanced", **topk_opts):
    """Lexical ranking per distinct request text: ((qkey, id, similarity_score,
    search_rank), proven row bound); ``qkey`` is the text's ``text_key``.  Texts
    that no listing can tell apart (``signatures``) are ranked once."""
    corpus = profile_corpus(listings)
    shared_dir(requests.sparkSession)
    texts = distinct_texts(requests, text_col).select("qkey", "kq", text_tokens(F.col("qtext")).alias("terms"))
    signed = signatures(texts, corpus).checkpoint(eager=True)
    size = signed.agg(F.count(F.lit(1)).alias("n"), F.max("kq").alias("k")).first()
    qv = signed.groupBy("skey").agg(F.max("kq").alias("kq"), F.any_value("terms").alias("terms"))
    ranked = exact_topk(qv, corpus, qkey="skey", qcol="terms", kcol="kq", ckey="id", ccol="terms", kind="lexical",
                        score_col="similarity_score", rank_col="search_rank", **({"block_q": SIGNATURE_BLOCK} | topk_opts))
    out = (signed.select("qkey", "kq", "skey").join(ranked, "skey").where("search_rank <= kq")
           .select("qkey", "id", "similarity_score", "search_rank"))
    return out, size["n"] * (size["k"] or 0)


def profile_texts(listings: DataFrame) -> DataFrame:
    return listings.select("id", profile_text().alias("text"))


def fitted_encoder(listings: DataFrame, encoder=None):
    """The encoder (default: ``terms.term_encoder``) fitted on the listing profile texts."""
    from abode.operators.terms import term_encoder
    return (encoder or term_encoder())(profile_texts(listings))


def rank_encoded(requests: DataFrame, listings: DataFrame, encoder=None, text_col: str = "enhanced",
                 **topk_opts):
    """The reproduced flow: listing profile texts and each distinct (enhanced)
    request text go through the same encoder, then exact inner-product top-k.
    ``encoder`` is ``fit(corpus_texts) -> encode`` (default: sparse weights of
    real terms, fitted on the profiles and ranked from inverted lists; encoders
    of dense vectors are ranked by inner product).  ((qkey, id, similarity_score,
    search_rank), proven row bound); ``qkey`` is the text's ``text_key``."""
    encode = fitted_encoder(listings, encoder)
    corpus = encode(profile_texts(listings), "text").select("id", "embedding")
    shared_dir(requests.sparkSession)
    # each distinct text once, small next to the log: the encoder's jobs don't read the log again
    qv = encode(distinct_texts(requests, text_col).checkpoint(eager=True), "qtext")
    return exact_topk(qv, corpus, qkey="qkey", qcol="embedding", kcol="kq", ckey="id", ccol="embedding",
                      kind="lexical" if isinstance(corpus.schema["embedding"].dataType, StructType) else "dense",
                      score_col="similarity_score", rank_col="search_rank", with_bound=True, **topk_opts)


def lexical_hits(requests: DataFrame, listings: DataFrame, text_col: str = "enhanced",
                 carry=(), with_listings: bool = False, **topk_opts) -> DataFrame:
    """Lexical cosine ranking of the (enhanced) request text against listing
    profile texts.  Listings sharing no term are never returned."""
    ranked, bound = rank_texts(requests, listings, text_col, **topk_opts)
    if with_listings:
        ranked = attach_listings(ranked, bound, listings)
    req = requests.select("qid", text_key(text_col).alias("qkey"), "max_results", *carry)
    return (join_ranked(req, ranked, bound, "qkey")
            .filter(F.col("search_rank") <= F.col("max_results"))
            .select("qid", "id", "similarity_score", "search_rank", *carry,
                    *([c for c in listings.columns if c != "id"] if with_listings else [])))


CONSTRAINT_COLS = ["max_price", "want_bedrooms", "want_type", "want_amenities"]
CARRY = ["msg", "enhanced"] + CONSTRAINT_COLS


def attach(hits: DataFrame, parsed: DataFrame, listings: DataFrame) -> DataFrame:
    """hits joined with the request constraints (unless carried) and the listing row."""
    if not all(c in hits.columns for c in CONSTRAINT_COLS):
        hits = hits.join(parsed.select("qid", *CONSTRAINT_COLS), "qid")
    if "monthly_rent" in hits.columns:  # listing row already attached per key
        return hits
    return hits.join(listings, "id")


def post_filter(hits: DataFrame, parsed: DataFrame, listings: DataFrame, mode: str = "api") -> DataFrame:
    """Constraints applied *after* ranking; ranks keep their gaps."""
    return attach(hits, parsed, listings).filter(predicates.all_ok(mode))


def _fmt(x: Column) -> Column:
    return F.format_number(x, 0)


def _card() -> Column:
    return F.concat(F.lit("\U0001f3e0 "), F.col("title"), F.lit(" — ₹"), F.col("monthly_rent").cast("string"),
                    F.lit("/mo in "), F.col("city"), F.lit(", "), F.col("state"), F.lit("\n"),
                    F.col("description"), F.lit("\nContact: "), F.col("contact_email"))


def summarise(kept: DataFrame, parsed: DataFrame, fields=tuple(RESPONSE_FIELDS), cards: bool = False) -> DataFrame:
    """Per-request aggregate of surviving hits, every request included.

    Surviving hits and one marker row per request are unioned and grouped
    once by qid (one shuffle; a group holds at most k + 1 rows) with a single
    ``collect_list`` of hit structs; count, distinct types and cities, the
    rent range and the first five UI cards are derived from that array.
    ``fields`` selects the listing fields returned in ``properties``."""
    need = ["property_type", "city", "monthly_rent"]
    inner = list(fields) + [c for c in need if c not in fields]
    parts = [F.col("search_rank")] + [F.col(c) for c in inner]
    if cards:
        parts.append(_card().alias("__card"))
    hit = kept.select("qid", "msg", "enhanced", F.struct(*parts).alias("__p"))
    mark = parsed.select("qid", "msg", "enhanced", F.lit(None).cast(hit.schema["__p"].dataType).alias("__p"))
    g = hit.unionByName(mark).groupBy("qid").agg(
        F.any_value("msg", True).alias("msg"),
        F.any_value("enhanced", True).alias("enhanced"),
        F.array_sort(F.collect_list("__p")).alias("__h"))
    return g.selectExpr(*_summary_exprs(fields, inner, cards))


def _summary_exprs(fields, inner, cards: bool) -> list[str]:
    """Count, distinct types and cities, rent range, properties and cards of
    the surviving hits ``__h`` (an array sorted by rank) of one request."""
    keep = ", ".join(["x.search_rank AS search_rank"] + [f"x.`{c}` AS `{c}`" for c in fields])
    out = [
        "qid", "msg", "enhanced",
        "CAST(size(__h) AS INT) AS total_found",
        "array_join(array_sort(array_distinct(array_compact(__h.property_type))), ', ') AS __types",
        "array_join(array_sort(array_distinct(array_compact(__h.city))), ', ') AS __cities",
        "array_min(__h.monthly_rent) AS __lo",
        "array_max(__h.monthly_rent) AS __hi",
        ("__h AS properties" if list(inner) == list(fields) and not cards
         else f"transform(__h, x -> struct({keep})) AS properties"),
    ]
    if cards:
        out.append(f"array_join(slice(__h, 1, {UI_MAX_CARDS}).__card, '\\n\\n') AS __cards")
    return out


def api_message(msg: Column, n: Column, types: Column, cities: Column, lo: Column, hi: Column) -> Column:
    """The API summary sentence, or the no-match text when nothing survived."""
    return (F.when(F.coalesce(n, F.lit(0)) == 0,
                   F.concat(F.lit("No properties matched your search for '"), F.coalesce(msg, F.lit("")),
                            F.lit("'. Try adjusting your filters.")))
            .otherwise(F.concat(F.lit("Found "), n.cast("string"), F.lit(" "), types, F.lit(" in "), cities,
                                F.lit(" from ₹"), _fmt(lo), F.lit(" to ₹"), _fmt(hi), F.lit("/month."))))


def respond(parsed: DataFrame, kept: DataFrame, answered_at: Column | None = None,
            fields=tuple(RESPONSE_FIELDS), cards: bool = False) -> DataFrame:
    """One response row per request from exploded surviving hits (requests
    with no hits included)."""
    return _finish(summarise(kept, parsed, fields, cards), answered_at, cards)


def _finish(r: DataFrame, answered_at: Column | None, cards: bool) -> DataFrame:
    ts = answered_at if answered_at is not None else F.current_timestamp()
    out = [
        "qid",
        api_message(F.col("msg"), F.col("total_found"), F.col("__types"), F.col("__cities"),
                    F.col("__lo"), F.col("__hi")).alias("message"),
        "properties",
        "total_found",
        F.col("enhanced").alias("query_processed"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    ]
    if cards:
        out.append(F.coalesce(F.nullif(F.col("__cards"), F.lit("")), F.lit(NO_MATCH_UI)).alias("display"))
    return r.select(*out)


# listing attributes the post-filter reads
FILTER_FIELDS = ["monthly_rent", "bedrooms", "property_type", "amenities", *FLAG_COLUMNS]


def offers(mode: str) -> list[Column]:
    """What the post-filter compares of a listing, missing values by their
    defaults: worked out once per ranked listing, not once per request."""
    return [F.coalesce("monthly_rent", F.lit(0)).alias("__rent"), F.coalesce("bedrooms", F.lit(0)).cast("bigint").alias("__beds"),
            F.lower(F.coalesce("property_type", F.lit(""))).alias("__kind"), offered_bits(mode).alias("__bits")]


# ``predicates.all_ok`` of a request row and an element ``x`` of its ranking
_ALL_OK = ("(max_price IS NULL OR x.__rent <= max_price) AND (want_bedrooms IS NULL OR x.__beds = want_bedrooms) "
           "AND (want_type IS NULL OR x.__kind = want_type) AND x.__bits & __want = __want")


def ranked_lists(ranked: DataFrame, bound: int, listings: DataFrame, key: str, payload,
                 cards: bool = False, mode: str = "api") -> DataFrame:
    """(key, __r): each key's ranking with its listing payload and ``offers`` as
    ONE array sorted by rank.  Only keys x k rows are shuffled (never requests x k).
    The listing table streams past a broadcast ranking when the ranking's
    proven bound is small; otherwise both sides shuffle on the listing id."""
    x = attach_listings(ranked, bound, listings)
    parts = [F.col("search_rank")] + [F.col(c) for c in payload] + offers(mode)
    if cards:
        parts.append(_card().alias("__card"))
    return x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("__r"))


def answer_requests(parsed: DataFrame, lists: DataFrame, key: str, req_key: Column, bound: int,
                    fields, inner, cards: bool) -> DataFrame:
    """One row per request: its key's ranked array, cut to the request's own
    k and post-filtered by its constraints inside the row (higher-order
    ``filter``), then summarised.  The request side is never multiplied by k
    and, with a broadcast ranking, never shuffled; otherwise it shuffles once
    on (key, salt), hot keys split over several tasks (``salted_join``)."""
    lt = lists.schema["__r"].dataType.simpleString()
    req = parsed.select("qid", "msg", "enhanced", req_key.alias("__key"), "max_results", *CONSTRAINT_COLS[:3], wanted_bits(F.col("want_amenities")).alias("__want"))
    lk = lists.withColumnRenamed(key, "__key")
    width = est_row_bytes(lists.schema["__r"].dataType.elementType) + est_row_bytes(lists.schema[key].dataType)
    if bound * width <= BROADCAST_BYTES_MAX:
        j = req.join(F.broadcast(lk), "__key", "left")
    else:
        j = salted_join(req, lk, "__key", "qid", "left")
    h = (f"filter(coalesce(__r, CAST(array() AS {lt})), "
         f"x -> x.search_rank <= max_results AND {_ALL_OK})")
    g = j.select("qid", "msg", "enhanced", F.expr(h).alias("__h"))
    return g.selectExpr(*_summary_exprs(fields, inner, cards))


def chat_batch(requests: DataFrame, listings: DataFrame, embeddings: DataFrame, mode: str = "api",
               answered_at: Column | None = None, ranking: str = "vector",
               fields=tuple(RESPONSE_FIELDS), cards: bool = False, encoder=None, **topk_opts) -> DataFrame:
    """Full request pipeline over a table of requests: one response row per
    request with message, properties (``fields`` of each surviving hit, in
    rank order), total_found, query_processed, timestamp (+ UI ``display``).

    ``ranking``: ``vector`` (request vector from ``embeddings`` by id),
    ``lexical`` (term-count cosine of the enhanced text) or ``encoded`` (the
    enhanced text through ``encoder``, as the reproduced service does).

    Plan: parse (one projection) -> rank once per distinct key -> per-key
    ranked arrays with listing payload -> join to requests on the key ->
    post-filter and summary inside each request row."""
    parsed = parse_request(validate_k(requests), mode=mode)
    if ranking == "vector":
        ranked, bound = rank_vectors(parsed, listings, embeddings, **topk_opts)
        key, req_key = "vec_id", F.col("vec_id")
    elif ranking == "lexical":
        ranked, bound = rank_texts(parsed, listings, **topk_opts)
        key, req_key = "qkey", text_key("enhanced")
    elif ranking == "encoded":
        ranked, bound = rank_encoded(parsed, listings, encoder, **topk_opts)
        key, req_key = "qkey", text_key("enhanced")
    else:
        raise ValueError(f"unknown ranking {ranking!r}")
    return respond_ranked(parsed, listings, ranked, bound, key, req_key, mode, answered_at, fields, cards)


def respond_ranked(parsed: DataFrame, listings: DataFrame, ranked: DataFrame, bound: int, key: str,
                   req_key: Column, mode: str = "api", answered_at: Column | None = None,
                   fields=tuple(RESPONSE_FIELDS), cards: bool = False) -> DataFrame:
    """Responses from a per-key ranking ``(key, id, similarity_score,
    search_rank)`` with at most ``bound`` rows (computed now or cached)."""
    need = ["property_type", "city", "monthly_rent"]
    inner = list(fields) + [c for c in need if c not in fields]
    lists = ranked_lists(ranked, bound, listings, key, inner, cards, mode)
    return _finish(answer_requests(parsed, lists, key, req_key, bound, fields, inner, cards), answered_at, cards)


def display_cards(kept: DataFrame, parsed: DataFrame) -> DataFrame:
    """UI text: first five surviving hits as cards, or the no-match text."""
    return respond(parsed, kept, F.lit(None).cast("timestamp"), fields=("listing_id",), cards=True) \
        .select("qid", "display")
