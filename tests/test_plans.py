"""Shape of the physical plans, with broadcasts off as for large tables."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest

from tests.builders import at, event, tables, user, visit
from wayfare.operators.gaps import early_events, event_gaps, product_time
from wayfare.operators.journeys import (
    JourneyOptions,
    journey_events,
    numbered_visits,
    page_counts,
    second_pages,
    session_summary,
)
from wayfare.plans import analyses, journeys
from wayfare.sources.schemas import TABLES
from wayfare.sources.tables import Tables

OPTIONS = JourneyOptions(as_of="2024-01-12")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    t = tables(spark, user_event=[event(1, at())], user=[user()], user_visit=[visit()])
    for name in TABLES:
        getattr(t, name).write.parquet(f"{root}/{name}")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    # Print scan filters in full.
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield Tables.from_parquet(spark, root)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def _plan(df, run: bool = False) -> str:
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"#\d+L?", "", text.split("== Initial Plan ==")[0])


def test_no_cross_joins_and_no_whole_table_tasks(stored):
    found = [
        journeys.user_journey(stored, OPTIONS),
        journeys.user_journey_detailed(stored, OPTIONS),
        journeys.user_page_steps(stored, "2024-01-12"),
        session_summary(stored, OPTIONS),
        journeys.summary_after_event(stored, JourneyOptions(as_of="2024-01-12", filter_visits=False)),
    ]
    for df in found:
        plan = _plan(df)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEval"):
            assert bad not in plan
        # One task gets no more than one row of each other: a total of their counts.
        lines = plan.split("\n")
        for below in (lines[i + 1] for i, line in enumerate(lines) if "SinglePartition" in line):
            assert re.search(r"HashAggregate\(keys=\[\], functions=\[partial_(count|sum)\(", below)


@pytest.mark.parametrize(
    "report, reads, exchanges",
    [
        (journeys.user_journey, 5, 30),
        (analyses.page_visit_report, 3, 21),
        (analyses.popular_interaction_report, 4, 27),
        (lambda t, o: journeys.journey_after_event(t, replace(o, filter_visits=False)), 3, 23),
    ],
)
def test_few_reads_and_shuffles(stored, report, reads, exchanges):
    plan = _plan(report(stored, OPTIONS))
    assert plan.count("user_event]") <= reads
    assert len(re.findall(r"Exchange (?:hash|range)partitioning", plan)) <= exchanges


def test_groupings_repeat_users_not_sessions(stored):
    plan = _plan(analyses.conversion_report_sets(stored, OPTIONS))
    # Read bottom up: sessions become rows per user and all keys, and these are repeated.
    below = plan[plan.index("Expand"):]
    reduced = r"HashAggregate\(keys=\[user_id, funnel_id, offer_category_id, session_number, screen_size[^\]]*\]"
    assert re.search(reduced, below) and not re.search(reduced, plan[: plan.index("Expand")])
    # The lines in between only pick columns.
    between = [line.split("- ")[-1] for line in below[: re.search(reduced, below).start()].split("\n")[1:]]
    assert all(re.match(r"(\*\(\d+\) )?(Project|Sort)?", line) for line in between)


def test_date_window_and_columns_reach_the_scan(stored):
    plan = _plan(journeys.user_journey(stored, OPTIONS))
    assert "GreaterThanOrEqual(created,2024-01-05" in plan
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    events = [s for s in scans if "user_visit_id" in s]
    # The visit list reads three of the eight columns.
    assert any(set(s.split(",")) == {"user_id:bigint", "created:timestamp_ntz", "user_visit_id:string"} for s in events)
    # Product time reads no page or reference.
    assert any({c.split(":")[0] for c in s.split(",")} == {"user_id", "created", "event"} for s in scans)


def test_idle_figures_are_pruned(stored):
    lean = session_summary(stored, OPTIONS, with_category=False).select("user_id", "session_number", "journey_len")
    plan = _plan(lean)
    assert "SortAggregate" not in plan and "collect_list" not in plan


def test_the_event_reduction_is_shared(stored):
    assert "ReusedExchange" in _plan(numbered_visits(stored, OPTIONS), run=True)


def test_slices_get_their_own_shuffle_after_user_joins(stored):
    early = early_events(stored.user_event, stored.user, as_of="2024-01-12")
    for df in (product_time(early), event_gaps(early)):
        assert re.search(r"Exchange hashpartitioning\(user_id, slice, \d+\), REPARTITION_BY_COL", _plan(df))


def test_second_pages_cut_before_the_shuffle(stored):
    rows = journey_events(stored, OPTIONS)
    plan = _plan(second_pages(rows, numbered_visits(stored, OPTIONS)))
    # Read bottom up: rows are cut per visit, shuffled, and cut again.
    final, partial = [m.start() for m in re.finditer(r"WindowGroupLimit \[user_id, visit_id\]", plan)]
    assert final < plan.index("Exchange hashpartitioning(user_id, visit_id", final) < partial
    # The event test, unlike a test on the page name, is left to the scan.
    assert "In(event, [route,user_visit])" in plan


def test_event_rows_join_a_plain_shuffle(stored):
    """The side they join must come straight from a shuffle for a busy visit to be split."""
    lines = _plan(journeys.user_journey(stored, OPTIONS)).split("\n")
    joins = [i for i, line in enumerate(lines) if "SortMergeJoin [user_id, visit_id]" in line and "Inner" in line]
    assert len(joins) == 1
    depth = re.search(r"[+:]-", lines[joins[0] + 1]).start()
    sides = [i for i, line in enumerate(lines) if i > joins[0] and line[depth:depth + 7] in (":- Sort", "+- Sort")][:2]
    assert len(sides) == 2
    assert all("Exchange hashpartitioning(user_id, visit_id" in lines[i + 1] for i in sides)


def test_offers_meet_distinct_references_not_events(stored):
    plan = _plan(journeys.user_journey(stored, OPTIONS))
    assert plan.count("Exchange hashpartitioning(offer_id,") == 2
    assert "Exchange hashpartitioning(user_id, visit_id, offer_id" in plan
    assert "EqualTo(event,redirected_to_offer)" in plan


def test_journey_strings_are_sorted_by_slice(stored):
    plan = _plan(journeys.user_journey(stored, OPTIONS))
    assert re.search(r"Exchange hashpartitioning\(user_id, session_number, _groupingexpression", plan)
    assert "WindowGroupLimit" in _plan(journeys.user_journey_first5(stored, journeys.FIRST_SESSIONS))


def test_page_counts_shuffle_counts_not_events(stored):
    rows = journey_events(stored, OPTIONS)
    plan = _plan(page_counts(rows, numbered_visits(stored, OPTIONS)))
    assert "partial_count" in plan
    assert "posexplode" not in plan
