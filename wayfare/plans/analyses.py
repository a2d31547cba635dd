"""Analyses of sessions, from base tables to the final figures.

Each works on the fixed-size session rows and page counts that come straight
from events; no journey string is built on the way. For journey exports, use
``operators.exports`` to get the same inputs and call the operators directly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.references import CHAT_LIMIT
from wayfare.operators import conversion, groups, pages, patterns
from wayfare.operators.filters import MAIN_FUNNEL, SESSION_CAP, converted, fill_missing, not_converted, redirected
from wayfare.operators.journeys import (
    JourneyOptions,
    numbered_visits,
    recent_page_rows,
    recent_session_folds,
    second_pages,
    session_summary,
    shown_items,
    with_users,
)
from wayfare.operators.keys import SESSION
from wayfare.plans.journeys import AFTER_EVENT, JOURNEY, summary_after_event
from wayfare.sources.tables import Tables

# The six groupings conversion is reported by, each with its order.
GROUPINGS = {
    "funnel": (["funnel_id"], ["funnel_id"]),
    "category": (["offer_category_id"], ["offer_category_id"]),
    "session": (["session_number"], ["session_number"]),
    "funnel_session": (["funnel_id", "session_number"], ["funnel_id", "session_number"]),
    "screen": (["screen_size"], ["screen_size"]),
    "funnel_session_category": (
        ["funnel_id", "session_number", "offer_category_id"],
        ["funnel_id", "session_number", "total_user"],
    ),
}


def conversion_report(tables: Tables, grouping: str, options: JourneyOptions = JOURNEY) -> DataFrame:
    """Conversion statistics of converted sessions by one of ``GROUPINGS``."""
    keys, order = GROUPINGS[grouping]
    return conversion.conversion_stats(_converted_filled(tables, options), keys, order, ascending=True)


def conversion_report_sets(tables: Tables, options: JourneyOptions = JOURNEY) -> DataFrame:
    """All groupings at once; the sessions are computed one time."""
    key_sets: Sequence[Sequence[str]] = [keys for keys, _ in GROUPINGS.values()]
    return conversion.conversion_stats_sets(_converted_filled(tables, options), key_sets)


def second_page_report(tables: Tables, options: JourneyOptions = JOURNEY) -> DataFrame:
    """Second pages of converted sessions."""
    second = second_pages(recent_page_rows(tables, options), numbered_visits(tables, options))
    return pages.second_page_counts(_lean(tables, options).filter(converted()).join(second, SESSION))


def last_page_after_event_report(
    tables: Tables, options: JourneyOptions = AFTER_EVENT, anchor_event: str = CHAT_LIMIT
) -> DataFrame:
    """Last pages of sessions after their first anchor event."""
    return pages.last_page_counts(summary_after_event(tables, options, anchor_event))


def chat_ending_report(tables: Tables, options: JourneyOptions = JOURNEY) -> DataFrame:
    """Redirected sessions of the studied funnels that end in a chat."""
    return pages.ending_counts(_lean(tables, options).filter(redirected()))


def nonconverted_report(tables: Tables, options: JourneyOptions = JOURNEY) -> DataFrame:
    """Sessions of the main funnel without click or redirect, by user source; no source is ``'0'``."""
    sessions = fill_missing(_lean(tables, options))
    return conversion.nonconverted_by_source(sessions.filter(not_converted([MAIN_FUNNEL])))


def page_visit_report(tables: Tables, options: JourneyOptions = JOURNEY) -> DataFrame:
    """Visits per page over all sessions."""
    return pages.page_visits(recent_session_folds(tables, options, numbered_visits(tables, options)))


def popular_interaction_report(tables: Tables, options: JourneyOptions = JOURNEY) -> DataFrame:
    """Visits per page over early sessions without click or redirect."""
    return pages.popular_interactions(_idle_sessions(tables, options))


def average_page_report(tables: Tables, options: JourneyOptions = JOURNEY, page: str = "browse") -> DataFrame:
    """Visits of one page per user, over early sessions without click or redirect."""
    return pages.average_page_per_user(_idle_sessions(tables, options), page=page)


def all_page_report(tables: Tables, options: JourneyOptions = JOURNEY) -> DataFrame:
    """Pages of converted sessions, with and without ids."""
    return pages.all_pages(_sessions_with_pages(tables, options).filter(converted()))


def pattern_report(tables: Tables, options: JourneyOptions = JOURNEY, min_support: float = 0.01) -> DataFrame:
    """Page sets that occur together in early converted sessions of the main funnel."""
    wanted = _sessions_with_pages(tables, options).filter(converted([MAIN_FUNNEL], SESSION_CAP))
    blank = F.array(F.lit(""))
    baskets = wanted.select(F.when(F.size("shown") > 0, shown_items()).otherwise(blank).alias("items"))
    return patterns.frequent_itemsets(baskets, min_support)


def top_group_report(tables: Tables, options: JourneyOptions = JOURNEY) -> DataFrame:
    """Groups of sessions with most redirects."""
    return groups.top_groups(session_summary(tables, options))


def top_group_sessions(tables: Tables, options: JourneyOptions = JOURNEY, converted_only: bool = True) -> DataFrame:
    """Sessions of the top groups: the converted ones, or all."""
    sessions = groups.kept(session_summary(tables, options))
    return groups.rows_in_groups(sessions, groups.top_groups(sessions), converted_only=converted_only)


def top_group_page_report(tables: Tables, options: JourneyOptions = JOURNEY) -> DataFrame:
    """Visits per page over the converted sessions of the top groups."""
    sessions = groups.kept(_sessions_with_pages(tables, options, with_category=True))
    return pages.page_visits(groups.rows_in_groups(sessions, groups.top_groups(sessions)))


def other_sessions(tables: Tables, options: JourneyOptions = JOURNEY, empty: bool = False) -> DataFrame:
    """Sessions outside the top groups: without redirects, or with ``empty`` without pages."""
    sessions = groups.kept(session_summary(tables, options))
    outside = groups.rows_outside_groups(sessions, groups.top_groups(sessions))
    return outside.filter(F.col("journey_len") == 0 if empty else F.col("redirected") <= 0)


def single_session_report(tables: Tables, options: JourneyOptions = JOURNEY) -> DataFrame:
    """Converted first sessions of users who never came back."""
    return groups.single_session_converted(_lean(tables, options))


def _lean(tables: Tables, options: JourneyOptions) -> DataFrame:
    """The session summary for analyses that do not look at offers."""
    return session_summary(tables, options, with_category=False)


def _converted_filled(tables: Tables, options: JourneyOptions) -> DataFrame:
    return fill_missing(session_summary(tables, options)).filter(converted())


def _sessions_with_pages(tables: Tables, options: JourneyOptions, with_category: bool = False) -> DataFrame:
    """The session summary with the pages each session shows."""
    numbered = numbered_visits(tables, options, with_category)
    return with_users(recent_session_folds(tables, options, numbered), tables, options)


def _idle_sessions(tables: Tables, options: JourneyOptions) -> DataFrame:
    return _sessions_with_pages(tables, options).filter(not_converted(max_session=SESSION_CAP))
