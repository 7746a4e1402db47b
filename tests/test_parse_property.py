"""Property test: on random messages built from the parser's keywords,
numbers in Python literal forms, currency marks and Unicode spaces, the
Spark parse equals the DuckDB oracle parse in both modes."""
import duckdb
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from abode.functions.parse import parse_request
from abode.plans import oracle as O

WORDS = ["under", "below", "less", "than", "max", "maximum", "studio", "bhk", "bedroom", "bedrooms",
         "apartment", "house", "condo", "townhouse", "pet", "parking", "furnished", "unfurnished",
         "utilities", "pool", "gym", "cheap", "affordable", "budget", "luxury", "upscale", "premium",
         "family", "professional", "carpet", "thunder", "in", "with", "Mumbai", "flat", "BHK", "Under"]
NUMBERS = ["30000", "$1,500", "+5", "-5", "30_000", "12.5", "1_", "₹300", "30k", "0", "007",
           "99999999999999999999", "-99999999999999999999", "2bhk", "3 bedroom", "11bedroom", "5 BHK",
           "$", ",", "4,000,000", "$$9"]
SEPS = [" ", " ", " ", "  ", "\t", "\n", "\u00a0", "\u2003", "\u3000"]

token = st.sampled_from(WORDS + NUMBERS)
message = st.builds(
    lambda toks, seps, lead: lead + "".join(t + s for t, s in zip(toks, seps)),
    st.lists(token, min_size=0, max_size=8),
    st.lists(st.sampled_from(SEPS), min_size=8, max_size=8),
    st.sampled_from(["", " ", "\t"]),
)


def _duck(msgs, mode):
    con = duckdb.connect()
    con.register("requests", pd.DataFrame({"qid": range(len(msgs)), "msg": msgs,
                                           "max_results": [None] * len(msgs), "vec_id": [0] * len(msgs)}))
    sql = (O.with_(O.parsed_cte(mode)) + "\nSELECT qid, enhanced, max_price, want_bedrooms, want_type, "
           "array_to_string(want_amenities, ',') AS amen FROM parsed ORDER BY qid")
    return [tuple(None if pd.isna(v) else v for v in r) for r in con.execute(sql).fetchall()]


def _spark(spark, msgs, mode):
    df = spark.createDataFrame([(i, m, None, 0) for i, m in enumerate(msgs)],
                               "qid bigint, msg string, max_results int, vec_id bigint")
    p = parse_request(df, mode=mode).selectExpr("qid", "enhanced", "max_price", "want_bedrooms", "want_type",
                                                "array_join(want_amenities, ',') AS amen")
    return [tuple(r) for r in p.orderBy("qid").collect()]


@pytest.mark.parametrize("mode", ["api", "ui"])
@settings(max_examples=12, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(msgs=st.lists(message, min_size=20, max_size=40))
def test_parse_agrees_with_oracle(spark, mode, msgs):
    assert _spark(spark, msgs, mode) == _duck(msgs, mode)
