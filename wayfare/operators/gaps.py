"""Time between a user's events, and the time a user spends in the product.

Both work on time slices per user. Inside a slice the previous event comes
from a window; the first event of a slice looks back to the last event of the
user's previous slice, which is known from one small row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.functions.references import IDLE_EVENTS
from wayfare.functions.times import (
    SLICE_SECONDS,
    AsOf,
    as_of_date,
    hours_interval,
    interval_seconds,
    seconds_interval,
    since,
    slice_of,
    within_horizon,
)
from wayfare.operators.slices import with_slices


def early_events(
    events: DataFrame,
    users: DataFrame,
    *,
    as_of: AsOf = None,
    lookback_days: int = 7,
    horizon_hours: int = 24,
    device: str = "mobile",
    ignored: Sequence[str] = IDLE_EVENTS,
) -> DataFrame:
    """Events soon after signup on one device: ``user_id, created, id``."""
    # An event inside both windows needs a signup at most one horizon before
    # the lookback; saying so keeps old users out of the join.
    oldest = F.date_sub(as_of_date(as_of), lookback_days).cast("timestamp_ntz") - hours_interval(horizon_hours)
    signups = users.filter((F.col("device") == device) & (F.col("created") >= oldest)).select(
        F.col("id").alias("user_id"), F.col("created").alias("signed_up")
    )
    recent = events.filter(since("created", as_of, lookback_days) & ~F.col("event").isin(*ignored))
    return (
        recent.select("user_id", "created", "id")
        .join(signups, "user_id")
        .filter(within_horizon("created", "signed_up", horizon_hours))
        .select("user_id", "created", "id")
    )


def event_gaps(events: DataFrame, slice_seconds: int = SLICE_SECONDS, parts: int | None = None) -> DataFrame:
    """``id, user_id, created, gap``: interval since the user's previous event.

    The first event of a user has a NULL gap. Slices with many events are cut by
    count (see ``operators.slices``).
    """
    inside = W.partitionBy("user_id", "slice").orderBy("created", "id")
    rows = with_slices(events.select("user_id", "created", "id"), ["user_id"], slice_seconds, parts).select(
        "*", F.lag("created").over(inside).alias("previous"), F.lead("created").over(inside).alias("following")
    )
    in_order = W.partitionBy("user_id").orderBy("slice")
    lasts = rows.filter(F.col("following").isNull()).select("user_id", "slice", "created")
    carried = lasts.select("user_id", "slice", F.lag("created").over(in_order).alias("carried"))
    # Inside a slice only its first row lacks a previous event.
    previous = F.coalesce("previous", "carried")
    return rows.join(carried, ["user_id", "slice"]).select(
        "id", "user_id", "created", (F.col("created") - previous).alias("gap")
    )


def product_time(events: DataFrame, gap_cap_seconds: int = 900, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``user_id, product_time``: seconds summed over gaps up to the cap.

    Users without such a gap have no row.
    """
    return joined_presence(presence(events, gap_cap_seconds, slice_seconds), gap_cap_seconds)


def presence(events: DataFrame, gap_cap_seconds: int = 900, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``user_id, slice, first_created, last_created, spent``: what product time needs of a slice.

    Events of one second are at most a second apart, which any cap allows, so what is
    spent between them is the time from the first to the last. They become one row
    before they are shuffled: a burst of any size is as many rows as it has seconds.
    """
    if gap_cap_seconds < 1:
        raise ValueError("the cap is a second or more")
    cap = seconds_interval(gap_cap_seconds)
    cells = events.groupBy("user_id", slice_of("created", 1).alias("second"), slice_of("created", slice_seconds).alias("slice")).agg(
        F.min("created").alias("first_created"), F.max("created").alias("last_created"), F.count(F.lit(1)).alias("events")
    )
    # Events often come from a join on the user, whose partitioning would satisfy all
    # that follows and leave a busy user in one task; so a shuffle is asked for.
    cells = cells.repartition("user_id", "slice")
    inside = W.partitionBy("user_id", "slice").orderBy("second")
    own = F.when(F.col("events") > 1, F.col("last_created") - F.col("first_created"))
    gap = F.col("first_created") - F.lag("last_created").over(inside)
    return (
        cells.select("*", own.alias("own"), gap.alias("gap"))
        .groupBy("user_id", "slice")
        .agg(
            F.min("first_created").alias("first_created"),
            F.max("last_created").alias("last_created"),
            F.sum("own").alias("own"),
            F.sum(F.when(F.col("gap") <= cap, F.col("gap"))).alias("between"),
        )
        .select("user_id", "slice", "first_created", "last_created", _added("own", "between").alias("spent"))
    )


def _added(*intervals: str) -> Column:
    """The sum of intervals, leaving out NULL ones; NULL if all are."""
    some = F.coalesce(*intervals).isNotNull()
    total = seconds_interval(0)
    for interval in intervals:
        total = total + F.coalesce(interval, seconds_interval(0))
    return F.when(some, total)


def joined_presence(slices: DataFrame, gap_cap_seconds: int = 900) -> DataFrame:
    """``user_id, product_time`` from the slices of ``presence``, whichever days they come from."""
    cap = seconds_interval(gap_cap_seconds)
    in_order = W.partitionBy("user_id").orderBy("slice")
    joints = slices.select(
        "user_id", "spent", (F.col("first_created") - F.lag("last_created").over(in_order)).alias("joint")
    )
    spent = joints.groupBy("user_id").agg(
        F.sum("spent").alias("spent"), F.sum(F.when(F.col("joint") <= cap, F.col("joint"))).alias("joints")
    )
    none = seconds_interval(0)
    total = F.coalesce("spent", none) + F.coalesce("joints", none)
    return spent.filter(F.col("spent").isNotNull() | F.col("joints").isNotNull()).select(
        "user_id", interval_seconds(total).alias("product_time")
    )
