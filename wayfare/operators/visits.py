"""Which visits are active, and their session numbers.

Session numbers are dense: per visit owner, by start time, counted over the
visits that still have an event after all filters. The ranking is sliced by
time: rank inside the slice plus the number of distinct starts in earlier
slices. So an owner with very many visits is ranked by many tasks, and the
only whole-owner window runs over one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.functions.references import visit_key
from wayfare.functions.times import VISIT_SLICE_SECONDS, slice_of


def active_visits(events: DataFrame, users: DataFrame, visits: DataFrame) -> DataFrame:
    """Distinct (event user, visit) pairs of known users and visits.

    Gives ``user_id, visit_id, owner_id, session_start``. Events are reduced
    to distinct pairs before anything is joined.
    """
    pairs = events.select("user_id", visit_key("user_visit_id").alias("visit_id")).distinct()
    return known_visits(pairs, users, visits)


def known_visits(pairs: DataFrame, users: DataFrame, visits: DataFrame) -> DataFrame:
    """The same for (user, visit) pairs that are distinct already; their other columns stay."""
    known = pairs.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    starts = visits.select(visit_key("id").alias("visit_id"), F.col("user_id").alias("owner_id"), "session_start")
    return known.join(starts, "visit_id").select(*pairs.columns, "owner_id", "session_start")


def number_visits(
    active: DataFrame, max_session: int | None = None, slice_seconds: int = VISIT_SLICE_SECONDS
) -> DataFrame:
    """``user_id, visit_id, session_number`` of every active pair, and its other columns.

    Visits that start at the same time share a number. ``max_session`` keeps
    the first sessions, numbered before the cut.
    """
    sliced = active.withColumn("slice", slice_of("session_start", slice_seconds))
    ranked = sliced.withColumn("rank_inside", F.dense_rank().over(_inside_slice()))
    if max_session is not None:
        # Implied by the cut below; lets Spark drop later visits before the shuffle.
        ranked = ranked.filter(F.col("rank_inside") <= max_session)
    carried = [name for name in active.columns if name not in ("owner_id", "session_start")]
    numbered = ranked.join(_slice_offsets(sliced), ["owner_id", "slice"]).select(
        *carried, _number().alias("session_number")
    )
    return numbered if max_session is None else numbered.filter(F.col("session_number") <= max_session)


def session_bounds(active: DataFrame, slice_seconds: int = VISIT_SLICE_SECONDS) -> DataFrame:
    """``owner_id, session_number, session_start, session_end`` per distinct start.

    ``session_end`` is the start of the owner's next session.
    """
    starts = active.select("owner_id", "session_start").distinct()
    sliced = starts.withColumn("slice", slice_of("session_start", slice_seconds))
    ranked = sliced.withColumns(
        {
            "rank_inside": F.row_number().over(_inside_slice()),
            "next_inside": F.lead("session_start").over(_inside_slice()),
        }
    )
    return ranked.join(_slice_offsets(sliced), ["owner_id", "slice"]).select(
        "owner_id",
        _number().alias("session_number"),
        "session_start",
        F.coalesce("next_inside", "next_slice_start").alias("session_end"),
    )


def _inside_slice() -> WindowSpec:
    return W.partitionBy("owner_id", "slice").orderBy(F.col("session_start").asc_nulls_last())


def _slice_offsets(sliced: DataFrame) -> DataFrame:
    """Per owner and slice: distinct starts before it, and the next slice's first start."""
    by_slice = W.partitionBy("owner_id").orderBy("slice")
    earlier = by_slice.rowsBetween(W.unboundedPreceding, -1)
    slices = sliced.groupBy("owner_id", "slice").agg(
        F.count_distinct("session_start").alias("starts"), F.min("session_start").alias("first_start")
    )
    return slices.select(
        "owner_id",
        "slice",
        F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("before"),
        F.lead("first_start").over(by_slice).alias("next_slice_start"),
    )


def _number() -> Column:
    return (F.col("before") + F.col("rank_inside")).cast("int")
