"""Tables stored by day: the same reports as from events, days replaced, partitions pruned."""

from __future__ import annotations

import datetime as dt
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.builders import at, event, tables, user, visit
from wayfare.operators.daily import write_days
from wayfare.operators.journeys import JourneyOptions, session_summary
from wayfare.plans import analyses, journeys
from wayfare.sources.days import DaySettings

AS_OF = "2024-01-12"
OPTIONS = JourneyOptions(as_of=AS_OF, horizon_hours=72)
AFTER = replace(journeys.AFTER_EVENT, as_of=AS_OF, horizon_hours=72)
SETTINGS = DaySettings(horizon_hours=72)
FIRST, LAST = dt.date(2024, 1, 1), dt.date(2024, 1, 14)
PAGES = ["https://app.example.com/browse", "https://app.example.com/chats?id=7", "https://app.example.com/null/9", "https://a.io/b", None]


def _events(seed: int, n: int = 250) -> list[dict]:
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.choice(["route", "route", "route", "user_visit", "bnr_click", "redirected_to_offer", "user_afk", "chat_message_limit_reached"])
        owner = r.choice([1, 1, 1, 2, 3, None])
        more = {"attr_1": r.choice(["null", "3", "x1", None]), "attr_2": r.choice(["b2", "5"]), "user_id": owner}
        # Visits run over midnight; some events share a time.
        more["user_visit_id"] = f"V{r.randint(1, 6)}"
        out.append(event(i, at(r.randint(0, 40) * 9000, days=-4), kind, r.choice(PAGES), **more))
    return out


def _tables(spark, events):
    return tables(
        spark,
        user_event=events,
        user=[user(1, created=at(days=-4)), user(2, created=at(days=-3), conversion_funnel_id=1), user(3, device="desktop")],
        user_visit=[visit(f"v{i}", 1 + i % 2, at(3600 * (i // 2), days=-4)) for i in range(1, 7)],
        offer=[{"id": 3, "offer_category_id": 5, "conversion_type": "cpa"}],
    )


def _rows(df):
    return sorted(map(str, df.collect()))


def test_reports_equal_those_of_events(spark, tmp_path):
    t = _tables(spark, _events(1))
    stored = replace(t, user_event=None, days=write_days(t, str(tmp_path), FIRST, LAST, SETTINGS, detailed=True))
    for report, options in (
        (journeys.user_journey_detailed, OPTIONS),
        (session_summary, replace(OPTIONS, lookback_days=2, max_session=2)),
        (analyses.second_page_report, OPTIONS),
        (analyses.popular_interaction_report, OPTIONS),
    ):
        assert _rows(report(stored, options)) == _rows(report(t, options)), report
    turned = replace(t, user_event=None, days=write_days(t, str(tmp_path / "after"), FIRST, LAST, replace(SETTINGS, page_rule="inverted")))
    for report in (journeys.journey_after_event, analyses.last_page_after_event_report):
        made = _rows(report(turned, AFTER))
        assert made and made == _rows(report(t, AFTER))


def test_days_are_added_and_replaced(spark, tmp_path):
    events = _events(3)
    whole = _tables(spark, events)
    cut = at(days=-1).date()

    def part(test):
        return _tables(spark, [e for e in events if test(e["created"].date())])

    root = str(tmp_path)
    write_days(part(lambda day: day < cut), root, FIRST, cut - dt.timedelta(days=1), SETTINGS)
    days = write_days(part(lambda day: day >= cut), root, cut, LAST, SETTINGS)
    stored = replace(whole, user_event=None, days=days)
    expected = _rows(journeys.user_journey(whole, OPTIONS))
    assert _rows(journeys.user_journey(stored, OPTIONS)) == expected
    # The same day again changes nothing; the other days' events are not at hand then.
    write_days(part(lambda day: day == cut), root, cut, cut, SETTINGS)
    assert _rows(journeys.user_journey(stored, OPTIONS)) == expected
    # A day whose events are gone is empty afterwards, and still known as written.
    gone = part(lambda day: day != cut)
    write_days(gone, root, cut, cut, SETTINGS)
    assert _rows(journeys.user_journey(stored, OPTIONS)) == _rows(journeys.user_journey(gone, OPTIONS)) != expected
    assert days.written().count() == (LAST - FIRST).days + 1


def test_reports_read_the_days_they_cover_and_no_events(spark, tmp_path):
    t = _tables(spark, _events(4, 60))
    stored = replace(t, user_event=None, days=write_days(t, str(tmp_path), FIRST, LAST, SETTINGS))
    plan = analyses.popular_interaction_report(stored, OPTIONS)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet .*", plan)
    assert scans and all("PartitionFilters: [isnotnull(day" in s and "2024-01-05" in s for s in scans)
    assert "page_event" not in plan and "attr_1" not in plan
    read = stored.days.read("visits", AS_OF, 7)
    folders = {r[0].rsplit("/", 2)[1] for r in read.select(F.input_file_name()).distinct().collect()}
    assert folders == {f"day={FIRST + dt.timedelta(days=k)}" for k in range(4, 14)} & {f"day={e['created'].date()}" for e in _events(4, 60)}


def test_other_settings_are_refused(spark, tmp_path):
    t = _tables(spark, _events(5, 20))
    stored = replace(t, user_event=None, days=write_days(t, str(tmp_path), FIRST, LAST, SETTINGS))
    for options in (replace(OPTIONS, page_rule="inverted"), replace(OPTIONS, gap_cap_seconds=60), replace(OPTIONS, horizon_hours=1)):
        with pytest.raises(ValueError, match="stored by day"):
            journeys.user_journey(stored, options)
    with pytest.raises(ValueError, match="anchor_event"):
        journeys.session_anchors(stored, OPTIONS, "user_afk")
    with pytest.raises(ValueError, match="divide a day"):
        DaySettings(slice_seconds=1000)
