"""Frames are added up in their order, as the SQL does on a table of one row group: the sums are the same doubles."""

import datetime

import duckdb
import pytest

from stillwater.plans import registry

UP, DOWN = [0.1, 0.2, 0.3], [0.3, 0.2, 0.1]  # summed in these orders, two different doubles
KINDS = ("view", "click", "error", "purchase", "signup")


def both(spark, folder, query, views):
    """Rows of the query and of its SQL on events whose views are given by user, three in each kind."""
    start, events = datetime.datetime(2024, 1, 1), []
    for user, own in views.items():
        for kind in KINDS:
            for x in own if kind == "view" else [0.5] * 3:
                events.append((len(events) + 1, start + datetime.timedelta(seconds=len(events)), user, kind, 500 * x, "{}"))
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet/*.parquet')")
    got = registry.QUERIES[query](spark, str(folder))
    return sorted(map(tuple, got.collect())), sorted(con.execute(f"select {', '.join(got.columns)} from ({registry.ORACLE[query]})").fetchall())


@pytest.mark.parametrize("query", ["f2_operating_point", "agg_20"])
def test_videos_of_other_frame_orders_are_two_candidates(spark, tmp_path, query):
    got, want = both(spark, tmp_path, query, {0: UP, 6: DOWN})
    assert got == want
    assert {r[0]: r[-1] for r in got}["raw"] == 3


@pytest.mark.parametrize("query", ["sup_42", "win_07"])
def test_cases_of_other_frame_orders_are_told_apart(spark, tmp_path, query):
    got, want = both(spark, tmp_path, query, {0: DOWN, 1500: UP})
    assert got == want
    assert len(got) == 2 and {r[-1] for r in got if 0 in r} == {1}
