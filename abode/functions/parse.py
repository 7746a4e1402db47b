"""Natural-language request -> structured constraints, as SQL expressions.

Bug-compatible with the rule parser being reproduced: substring keyword
tests, first-token lookups, Python ``int()`` literal syntax, fixed keyword
order.  No Python UDF: everything fuses into one projection.  Each builder
takes the SQL text of the (lower-cased where noted) message and returns SQL
text; ``parse_request`` applies them with two ``selectExpr`` calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abode.constants import (AMENITY_KEYWORDS, ENHANCE_RULES, INT_LITERAL, LONG_MAX,
                             PRICE_KEYWORDS, PROPERTY_TYPE_KEYWORDS, UI_BEDROOM_PATTERNS, WS_CLASS)
from abode.functions.sqltext import q

LONG_MIN_SQL = f"({-LONG_MAX}L - 1L)"
LONG_MAX_SQL = f"{LONG_MAX}L"


def enhance_sql(msg: str) -> str:
    """Append fixed phrases when trigger substrings occur (case-insensitive)."""
    parts = [msg]
    for triggers, phrase in ENHANCE_RULES:
        hit = " OR ".join(f"contains(lower({msg}), {q(t)})" for t in triggers)
        parts.append(f"CASE WHEN {hit} THEN {q(phrase)} ELSE '' END")
    return "concat(" + ", ".join(parts) + ")"


def tokens_sql(lq: str) -> str:
    """Python ``str.split()``: whitespace runs folded to one space (pattern
    compiled once, one pass), trimmed, split on one character (no per-row regex)."""
    return f"array_remove(split(trim(regexp_replace({lq}, {q(WS_CLASS + '+')}, ' ')), ' '), '')"


def python_int_sql(t: str) -> str:
    """int(t) for Python literal syntax; null when it would raise.
    Out-of-range literals saturate to the BIGINT bounds (same filter result)."""
    return (f"CASE WHEN {t} RLIKE {q(INT_LITERAL)} THEN coalesce(try_cast(replace({t}, '_', '') AS BIGINT), "
            f"CASE WHEN startswith({t}, '-') THEN {LONG_MIN_SQL} ELSE {LONG_MAX_SQL} END) END")


def max_price_sql(lq: str, toks: str) -> str:
    """First keyword (in keyword order) whose substring occurs, whose last word
    is a token, and whose next token parses as an int after dropping '$' and ','."""
    branches = []
    for kw in PRICE_KEYWORDS:
        last = q(kw.split()[-1])
        pos = f"array_position({toks}, {last})"          # 1-based; 0 = absent
        nxt = f"get({toks}, CAST({pos} AS INT))"          # 0-based get => the next token
        price = python_int_sql(f"replace(replace({nxt}, '$', ''), ',', '')")
        branches.append(f"CASE WHEN contains({lq}, {q(kw)}) AND {pos} > 0 THEN {price} END")
    return "CAST(coalesce(" + ", ".join(branches) + ") AS BIGINT)"


def bedrooms_api_sql(lq: str) -> str:
    d = f"regexp_extract({lq}, {q('([0-9]+)' + WS_CLASS + '*(bhk|bedroom)')}, 1)"
    return (f"CASE WHEN contains({lq}, 'studio') THEN 0L WHEN {d} <> '' THEN "
            f"coalesce(try_cast({d} AS BIGINT), {LONG_MAX_SQL}) END")


def bedrooms_ui_sql(lq: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({lq}, {q(p)}) THEN {v}L" for p, v in UI_BEDROOM_PATTERNS) + " END"


def property_type_sql(lq: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({lq}, {q(t)}) THEN {q(t)}" for t in PROPERTY_TYPE_KEYWORDS) + " END"


def amenities_sql(lq: str) -> str:
    items = ", ".join(f"CASE WHEN contains({lq}, {q(k)}) THEN {q(n)} END" for k, n in AMENITY_KEYWORDS)
    return f"filter(array({items}), x -> x IS NOT NULL)"


MSG = "coalesce(msg, '')"
LQ = "lower(coalesce(msg, ''))"


def parse_exprs(mode: str, msg: str = MSG, lq: str = LQ, toks: str = "__toks") -> dict[str, str]:
    if mode not in ("api", "ui"):
        raise ValueError(f"mode must be 'api' or 'ui', got {mode!r}")
    return {
        "enhanced": enhance_sql(msg),
        "max_price": max_price_sql(lq, toks),
        "want_bedrooms": bedrooms_api_sql(lq) if mode == "api" else bedrooms_ui_sql(lq),
        "want_type": property_type_sql(lq),
        "want_amenities": amenities_sql(lq),
    }


def parse_request(df: DataFrame, msg_col: str = "msg", mode: str = "api") -> DataFrame:
    """Adds enhanced, max_price, want_bedrooms, want_type, want_amenities."""
    msg, lq = f"coalesce(`{msg_col}`, '')", f"lower(coalesce(`{msg_col}`, ''))"
    ex = parse_exprs(mode, msg, lq)
    # tokens once, in their own projection (not inlined into five branches)
    t = df.selectExpr("*", f"{tokens_sql(lq)} AS __toks")
    return t.selectExpr(*[f"`{c}`" for c in df.columns], *[f"{v} AS {k}" for k, v in ex.items()])


# Column forms, for use with DataFrame.select / withColumn

def enhance_query(msg: Column | str) -> Column:
    return F.expr(enhance_sql(_name(msg)))


def parse_bedrooms_ui(msg: Column | str) -> Column:
    return F.expr(bedrooms_ui_sql(f"lower({_name(msg)})"))


def _name(c) -> str:
    if isinstance(c, str):
        return c
    raise TypeError("pass the column as SQL text, e.g. \"coalesce(msg, '')\"")
