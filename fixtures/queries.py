"""Every operator and report as a query over the driver's tables.

The synthetic events lie far apart, so the queries pass wider windows than
the reports' own defaults; see ``PROFILE``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures import adaptors
from wayfare.functions import pages as page_functions
from wayfare.functions import references
from wayfare.functions.times import interval_seconds, since
from wayfare.operators import banners, feedback
from wayfare.operators.gaps import early_events, event_gaps, product_time
from wayfare.operators.journeys import JourneyOptions, numbered_visits, recent_events, session_summary
from wayfare.operators.pages import most_visited
from wayfare.operators.visits import active_visits, session_bounds
from wayfare.plans import analyses, journeys
from wayfare.plans.feedback import feedback_report
from wayfare.sources.days import DaySettings
from wayfare.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-01-31"
IMAGES = "https://img.example.com/b/"
PROFILE = {"as_of": AS_OF, "lookback_days": 31, "horizon_hours": 744, "gap_cap_seconds": 86400}
OPTIONS = JourneyOptions(**PROFILE)
RECENT = replace(OPTIONS, lookback_days=7)


def _tables(query: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(adaptors.load(spark, sf_dir))


def _by_day(query: Callable[[Tables, JourneyOptions], DataFrame], options: JourneyOptions, detailed: bool = False) -> Query:
    """A report on the tables stored by day; it takes the same SQL as the one on events."""
    options = replace(options, **PROFILE)
    settings = DaySettings(options.page_rule, options.horizon_hours, options.gap_cap_seconds, options.slice_seconds)
    return lambda spark, sf_dir: query(adaptors.load_by_day(spark, sf_dir, settings, detailed), options)


def _banners(query: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(adaptors.load(spark, sf_dir, with_banners=True))


def _profile(options: JourneyOptions) -> JourneyOptions:
    return replace(options, **PROFILE)


def _stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({name: F.round(name, scale) for name, scale in digits.items()})


# --- events -----------------------------------------------------------------


def _lookback(t: Tables) -> DataFrame:
    return t.user_event.filter(since("created", AS_OF, 7)).select(F.col("id").alias("event_id"), "user_id", "event")


def _page_names(rule: str) -> Query:
    return _tables(
        lambda t: t.user_event.select(F.col("id").alias("event_id"), page_functions.page_name(rule).alias("page_name"))
    )


def _banner_refs(t: Tables) -> DataFrame:
    refs = t.user_event.select("id", "event", references.banner_ref().alias("banner_ref"))
    no = F.lit(False)
    return refs.select(
        F.col("id").alias("event_id"),
        "banner_ref",
        F.coalesce(references.is_banner_click("event", "banner_ref"), no).alias("is_banner_click"),
        F.coalesce(references.is_attribute_click("event", "banner_ref"), no).alias("is_attribute_click"),
    )


def _offer_refs(t: Tables) -> DataFrame:
    return t.user_event.select(F.col("id").alias("event_id"), references.offer_ref().alias("offer_id"))


def _screens(t: Tables) -> DataFrame:
    return t.user.select(F.col("id").alias("user_id"), references.screen_size().alias("screen_size"))


def _bounds(t: Tables) -> DataFrame:
    visits = t.user_visit.filter(since("session_start", AS_OF, OPTIONS.lookback_days))
    bounds = session_bounds(active_visits(recent_events(t, OPTIONS), t.user, visits))
    return bounds.select("owner_id", "session_number", _stamp("session_start"), _stamp("session_end"))


def _early(t: Tables) -> DataFrame:
    return early_events(
        t.user_event,
        t.user,
        as_of=AS_OF,
        lookback_days=OPTIONS.lookback_days,
        horizon_hours=OPTIONS.horizon_hours,
        device=OPTIONS.device,
    )


def _gaps(t: Tables) -> DataFrame:
    return event_gaps(_early(t)).select(
        F.col("id").alias("event_id"), "user_id", interval_seconds("gap").alias("gap_seconds")
    )


# --- journeys ---------------------------------------------------------------


def _lines(infos: str | Column) -> Column:
    return F.transform(
        infos,
        lambda i: F.concat_ws(
            "|", i["event"], F.coalesce(i["page_name"], F.lit("~")), i["created_date"].cast("string")
        ),
    )


def _event_rows(t: Tables) -> DataFrame:
    found = journeys.journey_event_rows(t, _profile(journeys.DETAILED))
    return found.withColumn("created_date", F.col("created_date").cast("string"))


def _event_chunks(t: Tables) -> DataFrame:
    found = journeys.journey_event_chunks(t, _profile(journeys.DETAILED), size=3)
    return found.select("user_id", "session_number", "chunk", F.array_join(_lines("page_info_array"), ";").alias("page_info"))


def _detailed(t: Tables, options: JourneyOptions | None = None) -> DataFrame:
    found = journeys.user_journey_detailed(t, options or _profile(journeys.DETAILED))
    return found.withColumn("page_info", F.array_join(_lines("page_info_array"), ";")).drop("page_info_array")


def _anchors(t: Tables) -> DataFrame:
    found = journeys.session_anchors(t, _profile(journeys.AFTER_EVENT))
    return found.select("user_id", "session_number", "funnel_id", _stamp("anchor_time"))


def _user_arrays(t: Tables) -> DataFrame:
    found = journeys.user_pages_array(t, AS_OF, OPTIONS.lookback_days)
    return found.select(
        "user_id",
        "funnel_id",
        F.array_join("journey_pages", "|").alias("journey_pages"),
        F.size("journey_pages").cast("bigint").alias("pages"),
    )


# --- analyses ---------------------------------------------------------------


def _itemsets(t: Tables, biggest: int | None = None) -> DataFrame:
    found = analyses.pattern_report(t, OPTIONS)
    if biggest is not None:
        found = found.filter(F.col("size") <= biggest)
    return _rounded(found.withColumn("items", F.array_join("items", "|")), support=9)


def _conversion(grouping: str) -> Query:
    return _tables(lambda t: analyses.conversion_report(t, grouping, OPTIONS))


def _sessions(analysis: Callable[[Tables], DataFrame]) -> Query:
    return _tables(lambda t: analysis(t).select("user_id", "session_number", "redirected"))


def _money(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("double") for name in ("revenue", "cpa_revenue")})


def _report(t: Tables) -> DataFrame:
    return banners.banner_report(t, IMAGES, AS_OF, OPTIONS.lookback_days)


def _click_pages(t: Tables) -> DataFrame:
    found = banners.click_pages(t, AS_OF, OPTIONS.lookback_days)
    return found.select("id", "user_id", "banner_id", "offer_id", "device", "placement", "page_name", "conversion_type")


def _clicks(fan_out: bool) -> Query:
    return _banners(lambda t: _money(banners.clicks(t, IMAGES, AS_OF, OPTIONS.lookback_days, fan_out)))


def _sentiment(build: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scores = feedback.polarity(
            adaptors.feedback(spark, sf_dir), adaptors.lexicon(spark), keys=["conv_id", "turn"]
        )
        return build(scores)

    return query


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "events_lookback": _tables(_lookback),
        **{f"page_name_{rule}": _page_names(rule) for rule in page_functions.PAGE_RULES},
        "banner_ref": _tables(_banner_refs),
        "offer_ref": _tables(_offer_refs),
        "banner_event_pages": _banners(lambda t: banners.banner_events(t, AS_OF, OPTIONS.lookback_days)),
        "session_number": _tables(lambda t: numbered_visits(t, OPTIONS).drop("offer_category_id")),
        "session_bounds": _tables(_bounds),
        "event_gaps": _tables(_gaps),
        "product_time": _tables(lambda t: product_time(_early(t), OPTIONS.gap_cap_seconds)),
        "screen_size": _tables(_screens),
        "user_journey": _tables(lambda t: journeys.user_journey(t, _profile(journeys.JOURNEY))),
        "user_journey_recent": _tables(lambda t: journeys.user_journey(t, RECENT)),
        "user_journey_first5": _tables(lambda t: journeys.user_journey_first5(t, _profile(journeys.FIRST_SESSIONS))),
        "user_journey_first2": _tables(
            lambda t: journeys.user_journey_first5(t, replace(_profile(journeys.FIRST_SESSIONS), max_session=2))
        ),
        "user_journey_basic": _tables(lambda t: journeys.user_journey_basic(t, _profile(journeys.BASIC))),
        "user_journey_detailed": _tables(_detailed),
        "session_summary": _tables(lambda t: session_summary(t, OPTIONS)),
        "journey_steps": _tables(lambda t: journeys.journey_steps(t, OPTIONS)),
        "journey_chunks": _tables(lambda t: journeys.journey_chunks(t, OPTIONS, size=2)),
        "journey_event_rows": _tables(_event_rows),
        "journey_event_chunks": _tables(_event_chunks),
        "anchor_times": _tables(_anchors),
        "journey_after_event": _tables(lambda t: journeys.journey_after_event(t, _profile(journeys.AFTER_EVENT))),
        "user_pages_array": _tables(_user_arrays),
        "user_page_steps": _tables(lambda t: journeys.user_page_steps(t, AS_OF, OPTIONS.lookback_days)),
        **{f"funnel_stats_by_{name}": _conversion(name) for name in analyses.GROUPINGS},
        "funnel_stats_grouping_sets": _tables(lambda t: analyses.conversion_report_sets(t, OPTIONS)),
        "second_page_counts": _tables(lambda t: analyses.second_page_report(t, OPTIONS)),
        "last_page_after_event": _tables(
            lambda t: analyses.last_page_after_event_report(t, _profile(journeys.AFTER_EVENT))
        ),
        "nonconverted_by_source": _tables(lambda t: analyses.nonconverted_report(t, OPTIONS)),
        "page_visits": _tables(lambda t: analyses.page_visit_report(t, OPTIONS)),
        "page_visits_top5": _tables(lambda t: most_visited(analyses.page_visit_report(t, OPTIONS), top=5)),
        "popular_interactions": _tables(lambda t: analyses.popular_interaction_report(t, OPTIONS)),
        "all_pages": _tables(lambda t: analyses.all_page_report(t, OPTIONS)),
        "avg_page_per_user": _tables(lambda t: analyses.average_page_report(t, OPTIONS)),
        "frequent_pairs": _tables(lambda t: _itemsets(t, biggest=2)),
        "frequent_itemsets": _tables(_itemsets),
        "banner_impressions": _banners(lambda t: banners.impressions(t, AS_OF, OPTIONS.lookback_days)),
        "banner_impressions_24h": _banners(lambda t: banners.impressions_24h(t, AS_OF, OPTIONS.lookback_days)),
        "banner_click_pages": _banners(_click_pages),
        "banner_clicks": _clicks(fan_out=True),
        "banner_clicks_dedup": _clicks(fan_out=False),
        "banner_report": _banners(lambda t: _money(_report(t))),
        "banner_weight": _banners(lambda t: _money(banners.with_weight(_report(t), t.assets, IMAGES))),
        "sentiment_polarity": _sentiment(lambda scores: _rounded(scores, polarity=9)),
        "sentiment_label": _sentiment(lambda s: feedback.labelled(s).drop("polarity")),
        "sentiment_recalibrated": _sentiment(lambda s: feedback.recalibrated(s).drop("polarity")),
        "sentiment_counts": _sentiment(lambda s: feedback.label_counts(feedback.recalibrated(s))),
        "feedback_report": lambda spark, sf_dir: _rounded(
            feedback_report(adaptors.feedback(spark, sf_dir), adaptors.lexicon(spark), ["conv_id", "turn"]), polarity=9
        ),
        "top_groups": _tables(lambda t: analyses.top_group_report(t, OPTIONS)),
        "top_group_rows": _sessions(lambda t: analyses.top_group_sessions(t, OPTIONS)),
        "top_group_all_rows": _sessions(lambda t: analyses.top_group_sessions(t, OPTIONS, converted_only=False)),
        "top_group_page_visits": _tables(lambda t: analyses.top_group_page_report(t, OPTIONS)),
        "other_rows": _sessions(lambda t: analyses.other_sessions(t, OPTIONS)),
        "empty_rows": _sessions(lambda t: analyses.other_sessions(t, OPTIONS, empty=True)),
        "single_session_converted": _sessions(lambda t: analyses.single_session_report(t, RECENT)),
        "chat_ending_counts": _tables(lambda t: analyses.chat_ending_report(t, OPTIONS)),
        "user_journey_by_day": _by_day(journeys.user_journey, journeys.JOURNEY),
        "user_journey_detailed_by_day": _by_day(_detailed, journeys.DETAILED, detailed=True),
        "journey_after_event_by_day": _by_day(journeys.journey_after_event, journeys.AFTER_EVENT),
        "popular_interactions_by_day": _by_day(analyses.popular_interaction_report, journeys.JOURNEY),
        "page_visits_by_day": _by_day(analyses.page_visit_report, journeys.JOURNEY),
        "funnel_stats_by_funnel_session_category_by_day": _by_day(
            lambda t, options: analyses.conversion_report(t, "funnel_session_category", options), journeys.JOURNEY
        ),
    }
    return found
