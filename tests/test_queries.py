"""Registered queries against their oracles on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from inkfold.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SHOWN = ["detect_generic_phone", "detect_eu_vat", "detect_ua_ipn", "merged_spans", "policy_block", "provider_gate", "token_map", "tokenized_text", "audit_chain", "audit_tampered", "stats_totals", "stats_routing", "audit_page", "greedy_scores", "extract_texts", "flattened_messages", "server_sent_events"]
SHOWN += ["own_pack_spans", "audit_unlinked", "audit_streamed", "streamed_sessions", "streamed_events", "token_map_one_session", "spans_of_passes", "fidelity_run", "stored_tokens"]
SHOWN += ["normalized_texts", "anchored_values", "sanitized_requests", "sanitized_requests_restored", "blocked_requests", "provider_answers", "event_streams", "reported_entities", "policies_from_forms"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def values(df: pd.DataFrame) -> list[str]:
    one = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted(repr([one(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", SHOWN)
def test_query_equals_its_oracle(spark, sf, duck, name):
    got, expected = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and len(got) and values(got) == values(expected)


def test_registry(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(catalog.QUERIES) <= set(queries)
    assert __spark_entry__.entry(spark).columns == ["entity_type", "n"]
