"""Conversion statistics of sessions by any grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column titles of the printed statistics.
TITLES = {
    "banner_click": "Banner Click",
    "attribute_click": "Attribute Click",
    "redirected": "Redirected",
    "journey_len": "Journey len",
    "total_user": "Total User",
    "total_click": "Total Click",
    "banner_click_pct": "Banner Click %",
    "attribute_click_pct": "Attribute Click %",
    "total_click_pct": "Total Click %",
}

_CLICKS = ["banner_clicks", "attr_clicks", "redirected"]


def conversion_stats(
    sessions: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (), ascending: bool = False
) -> DataFrame:
    """Users, clicks, redirects, mean length and time, and percents per group.

    Percents divide clicks by distinct users, so they can exceed 100; they are
    rounded half to even. ``order_by`` may name keys or result columns.
    """
    stats = user_figures(sessions, keys).groupBy(*keys).agg(*_merged_figures(F.count("user_id")))
    return _sorted(_percents(stats, keys), order_by, ascending)


def conversion_stats_sets(sessions: DataFrame, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """The statistics of several groupings in one pass.

    ``grouping`` names the keys of a row's grouping; keys outside it are NULL.
    Sessions of one user that agree in all keys become one row before rows are
    repeated for the groupings, so what is repeated are users, not sessions.
    """
    keys = list(dict.fromkeys(key for key_set in key_sets for key in key_set))
    sets = [[F.col(key) for key in key_set] for key_set in key_sets]
    label = F.concat_ws("+", *[F.when(F.grouping(key) == 0, F.lit(key)) for key in keys])
    users = user_figures(sessions, keys)
    stats = users.groupingSets(sets, *keys).agg(*_merged_figures(F.count_distinct("user_id")), label.alias("grouping"))
    return _percents(stats, ["grouping", *keys])


def with_titles(stats: DataFrame) -> DataFrame:
    """Rename result columns to their printed titles."""
    return stats.withColumnsRenamed(TITLES)


def nonconverted_by_source(sessions: DataFrame, excluded_ending: str = "chats") -> DataFrame:
    """Redirect sum and mean and users per funnel and source.

    Sessions whose last page contains ``excluded_ending`` are left out;
    sessions without pages stay.
    """
    kept = sessions.filter(~F.coalesce("last_page", F.lit("")).contains(excluded_ending))
    return kept.groupBy("funnel_id", "user_source").agg(
        F.sum("redirected").alias("redirected_sum"),
        F.avg("redirected").alias("redirected_mean"),
        F.count_distinct("user_id").alias("users"),
    )


def user_figures(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per user and ``keys``, with figures that add up over users and over keys.

    Seconds are added as microsecond decimals, lengths as whole numbers, so that
    the order of adding has no effect. NULL users form rows of their own.
    """
    return sessions.groupBy("user_id", *keys).agg(
        *[F.sum(name).alias(name) for name in _CLICKS],
        F.sum("journey_len").alias("length"),
        F.count("journey_len").alias("lengths"),
        F.sum(F.col("product_time").cast("decimal(18,6)")).alias("seconds"),
        F.count("product_time").alias("times"),
    )


def _merged_figures(users: Column) -> list[Column]:
    """Figures of a grouping from the rows of ``user_figures``; ``users`` counts its users."""
    return [
        users.alias("total_user"),
        F.sum("banner_clicks").alias("banner_click"),
        F.sum("attr_clicks").alias("attribute_click"),
        F.sum("redirected").alias("redirected"),
        F.try_divide(F.sum("length").cast("double"), F.sum("lengths")).alias("journey_len"),
        F.try_divide(F.sum("seconds").cast("double"), F.sum("times")).alias("product_time"),
    ]


def _percents(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = F.col("banner_click") + F.col("attribute_click")

    def percent(clicks: Column) -> Column:
        return F.bround(clicks / F.col("total_user") * 100, 0)

    return stats.select(
        *keys,
        "banner_click",
        "attribute_click",
        "redirected",
        "journey_len",
        "product_time",
        "total_user",
        total.alias("total_click"),
        percent(F.col("banner_click")).alias("banner_click_pct"),
        percent(F.col("attribute_click")).alias("attribute_click_pct"),
        percent(total).alias("total_click_pct"),
    )


def _sorted(stats: DataFrame, order_by: Sequence[str], ascending: bool) -> DataFrame:
    if not order_by:
        return stats
    return stats.orderBy(
        *[F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last() for name in order_by]
    )
