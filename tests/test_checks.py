"""Every registered query against its SQL twin."""

import re

import pytest
from compare import difference, type_differences

import __spark_entry__ as entry

EXTRA = {*entry.LLM_QUERIES, *entry.PIPELINE}  # tested in tests/llm
QUERIES = {k: v for k, v in entry.queries().items() if k not in EXTRA}
TWINS = {k: v for k, v in entry.oracle_sql().items() if k not in EXTRA}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    if name in TWINS:
        assert type_differences(df, duck, TWINS[name]) == []
        assert difference(df, duck, TWINS[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)
    assert set(QUERIES) - set(TWINS) == {"chunk_checksum_crc"}


def test_players_meet_a_stored_title(spark, sf_dir):
    df = QUERIES["display_frames"](spark, sf_dir)
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    moved = [b for b in text.split("\n\n") if re.match(r"\(\d+\) Exchange", b.strip()) and "payload#" in b]
    assert len(moved) == 1  # smoothing is done; frames are dealt to the shares of players


@pytest.mark.parametrize("name", ["pending_items", "route_sessions", "seek_frame", "display_frames", "zone_colors", "batch_status"])
def test_no_cross_joins(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
