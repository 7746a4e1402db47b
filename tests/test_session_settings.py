"""Answers do not depend on the caller's session: ANSI off and a non-UTC
time zone give the same rows as the DuckDB oracles."""
import pytest

import __spark_entry__ as E
from conftest import SF001
from oracle_check import compare, duck

NAMES = ["synth_listings", "load_csv", "parse_request", "numeric_coerce", "chat_batch", "stats_overview",
         "response_projection", "topk_single"]


@pytest.fixture()
def foreign_session(spark):
    conf = {"spark.sql.ansi.enabled": "false", "spark.sql.session.timeZone": "America/Los_Angeles"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", NAMES)
def test_same_answers_in_foreign_session(foreign_session, name):
    ok, info = compare(foreign_session, duck(SF001), name, E.queries()[name], E.oracle_sql()[name], SF001)
    assert ok, info
