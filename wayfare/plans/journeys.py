"""Journey reports, with the settings each is defined by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.pages import page_name
from wayfare.functions.references import CHAT_LIMIT, ROUTE
from wayfare.functions.times import SLICE_SECONDS, AsOf
from wayfare.operators.journeys import (
    JourneyOptions,
    anchor_times,
    anchored_visits,
    numbered_visits,
    chunked_events,
    chunked_pages,
    journey_events,
    ordered_events,
    ordered_steps,
    recent_page_rows,
    recent_texts,
    roll_up_measures,
    roll_up_texts,
    rows_after_anchor,
    user_page_arrays,
    with_users,
)
from wayfare.sources.tables import Tables

# Lookback, page naming and session cap of each report.
JOURNEY = JourneyOptions(page_rule="bracketed", lookback_days=7)
FIRST_SESSIONS = JourneyOptions(page_rule="inverted", lookback_days=14, max_session=5)
BASIC = JourneyOptions(page_rule="with_visits", lookback_days=7)
DETAILED = JourneyOptions(page_rule="plain_id", lookback_days=7)
AFTER_EVENT = JourneyOptions(page_rule="inverted", lookback_days=7, filter_visits=False, max_session=5)

_HEAD = ["user_id", "session_number"]
_OFFER = ["offer_id", "offer_category_id", "os", "device_vendor", "funnel_id"]
_CLICKS = ["banner_clicks", "attr_clicks", "redirected"]


def user_journey(tables: Tables, options: JourneyOptions = JOURNEY) -> DataFrame:
    """One row per user and session: offer, device, screen, journey, clicks."""
    sessions = _sessions(tables, options, with_page_info=False, timed=True)
    return sessions.select(
        *_HEAD, "product_time", *_OFFER, "screen_size", "journey_len", "journey_pages", *_CLICKS
    )


def user_journey_first5(tables: Tables, options: JourneyOptions = FIRST_SESSIONS) -> DataFrame:
    """The journey of each user's first sessions."""
    return user_journey(tables, options)


def user_journey_basic(tables: Tables, options: JourneyOptions = BASIC) -> DataFrame:
    """The journey without product time and screen size."""
    sessions = _sessions(tables, options, with_page_info=False, timed=False)
    return sessions.select(*_HEAD, *_OFFER, "journey_len", "journey_pages", *_CLICKS)


def user_journey_detailed(tables: Tables, options: JourneyOptions = DETAILED) -> DataFrame:
    """The journey with an array of (event, page name, date) of all its events."""
    sessions = _sessions(tables, options, with_page_info=True, timed=True)
    return sessions.select(
        *_HEAD, "product_time", *_OFFER, "screen_size", "journey_len", "journey_pages", "page_info_array", *_CLICKS
    )


def journey_after_event(
    tables: Tables, options: JourneyOptions = AFTER_EVENT, anchor_event: str = CHAT_LIMIT
) -> DataFrame:
    """Route pages after a session's first anchor event, ordered by user and session."""
    rows = _after_anchor(tables, options, anchor_event)
    sessions = with_users(roll_up_texts(rows, slice_seconds=options.slice_seconds), tables)
    return sessions.select(*_HEAD, "funnel_id", "journey_pages").orderBy(*_HEAD)


def summary_after_event(
    tables: Tables, options: JourneyOptions = AFTER_EVENT, anchor_event: str = CHAT_LIMIT
) -> DataFrame:
    """The same sessions as fixed-size rows: funnel, length, first and last page."""
    rows = _after_anchor(tables, options, anchor_event)
    sessions = with_users(roll_up_measures(rows), tables)
    return sessions.select(*_HEAD, "funnel_id", "journey_len", "first_page", "last_page")


def session_anchors(
    tables: Tables, options: JourneyOptions = AFTER_EVENT, anchor_event: str = CHAT_LIMIT
) -> DataFrame:
    """First anchor event per session, with the user's funnel."""
    anchors = with_users(anchor_times(anchored_visits(tables, options, anchor_event)), tables)
    return anchors.select(*_HEAD, "funnel_id", "anchor_time")


def journey_steps(tables: Tables, options: JourneyOptions = JOURNEY) -> DataFrame:
    """The journey in row form: user, session, position, page name."""
    rows = recent_page_rows(tables, options).join(
        numbered_visits(tables, options), ["user_id", "visit_id"]
    )
    return ordered_steps(rows, _HEAD, slice_seconds=options.slice_seconds)


def journey_chunks(tables: Tables, options: JourneyOptions = JOURNEY, size: int = 1000) -> DataFrame:
    """The journey string in numbered pieces of ``size`` pages, for sessions whose string would not fit a cell."""
    return chunked_pages(journey_steps(tables, options), _HEAD, size)


def journey_event_rows(tables: Tables, options: JourneyOptions = DETAILED) -> DataFrame:
    """The array of the detailed journey in row form: user, session, position, event, page name, date."""
    rows = journey_events(tables, options).join(numbered_visits(tables, options), ["user_id", "visit_id"])
    return ordered_events(rows, _HEAD, slice_seconds=options.slice_seconds)


def journey_event_chunks(tables: Tables, options: JourneyOptions = DETAILED, size: int = 1000) -> DataFrame:
    """The same array in numbered pieces of ``size`` events."""
    return chunked_events(journey_event_rows(tables, options), _HEAD, size)


def user_pages_array(
    tables: Tables,
    as_of: AsOf = None,
    lookback_days: int = 14,
    funnel: int = 1,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Ordered page names of each user of one funnel, as an array."""
    rows = _user_pages(tables, as_of, lookback_days)
    pages = user_page_arrays(rows, _funnel_users(tables, funnel), slice_seconds)
    return pages.select("user_id", F.lit(funnel).alias("funnel_id"), "journey_pages")


def user_page_steps(
    tables: Tables,
    as_of: AsOf = None,
    lookback_days: int = 14,
    funnel: int = 1,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """The same pages in row form, for users whose array would not fit a row."""
    steps = ordered_steps(_user_pages(tables, as_of, lookback_days), ["user_id"], slice_seconds=slice_seconds)
    return steps.join(_funnel_users(tables, funnel), "user_id", "left_semi")


def _sessions(tables: Tables, options: JourneyOptions, with_page_info: bool, timed: bool) -> DataFrame:
    numbered = numbered_visits(tables, options, with_category=True)
    texts = recent_texts(tables, options, numbered, with_page_info)
    return with_users(texts, tables, options if timed else None)


def _after_anchor(tables: Tables, options: JourneyOptions, anchor_event: str) -> DataFrame:
    anchored = anchored_visits(tables, options, anchor_event)
    return rows_after_anchor(recent_page_rows(tables, options), anchored, ROUTE)


def _user_pages(tables: Tables, as_of: AsOf, lookback_days: int) -> DataFrame:
    return tables.events_since(as_of, lookback_days).select(
        "user_id", "created", "id", "event", page_name("generic").alias("page_name")
    )


def _funnel_users(tables: Tables, funnel: int) -> DataFrame:
    # A user's funnel is one value, so the test on its maximum is a test on the user.
    return tables.user.filter(F.col("conversion_funnel_id") == funnel).select(F.col("id").alias("user_id"))
