"""Partial figures of events, written by day.

Each part holds figures that merge over days, so a report folds the days it covers
and reads no events. Days are added one by one or many at a time; writing a day
again replaces it, also when its events are gone. Signups must be known when a day
is written; a day whose users came later is written again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.references import IDLE_EVENTS
from wayfare.functions.times import within_horizon
from wayfare.operators.gaps import presence
from wayfare.operators.journeys import journey_rows, page_events, slice_steps, visit_figures, visit_pages
from wayfare.operators.keys import VISIT
from wayfare.sources.days import SCHEMAS, DaySettings, DayTables
from wayfare.sources.tables import Tables


def day_parts(events: DataFrame, users: DataFrame, settings: DaySettings, detailed: bool = False) -> dict[str, DataFrame]:
    """The parts of ``events``, with the ``day`` they belong to."""
    day = F.to_date("created").alias("day")
    rows = journey_rows(events, settings.page_rule).select("*", day)
    anchor = F.min(F.when(F.col("event") == settings.anchor_event, F.col("created"))).alias("anchor_time")
    signups = users.select(F.col("id").alias("user_id"), F.col("created").alias("signed_up"))
    early = (
        events.filter(~F.col("event").isin(*IDLE_EVENTS))
        .select("user_id", "created")
        .join(signups, "user_id")
        .filter(within_horizon("created", "signed_up", settings.horizon_hours))
    )
    step = F.struct("created", "id", "event", "page_name")
    parts = {
        "visits": visit_figures(rows, ["day"], [anchor]),
        "offers": rows.filter(F.col("offer_id").isNotNull()).select("day", *VISIT, "offer_id").distinct(),
        "pages": visit_pages(rows, ["day"]),
        "steps": slice_steps(page_events(rows), step, "steps", settings.slice_seconds),
        "presence": presence(early, settings.gap_cap_seconds, settings.slice_seconds).withColumn("day", F.to_date("first_created")),
    }
    if detailed:
        parts["infos"] = slice_steps(rows, step, "infos", settings.slice_seconds)
    return parts


def write_days(
    tables: Tables, root: str, first: dt.date, last: dt.date, settings: DaySettings = DaySettings(), detailed: bool = False
) -> DayTables:
    """Write the days from ``first`` to ``last``, both included, in place of what is stored for them."""
    spark = tables.user_event.sparkSession
    within = F.to_date("created").between(F.lit(first), F.lit(last))
    events = tables.user_event.filter(within)
    if tables.event_day is not None:
        events = events.filter(F.col(tables.event_day).between(F.lit(first), F.lit(last))).drop(tables.event_day)
    stored = DayTables(spark, root, settings)
    for part, rows in day_parts(events, tables.user, settings, detailed).items():
        kept = rows.filter(F.col("user_id").isNotNull()).select(*spark.createDataFrame([], SCHEMAS[part]).columns, "day")
        whole = kept.unionByName(_marks(spark, first, last), allowMissingColumns=True)
        # One day's rows together, in files of even size however busy the day or a user is.
        even = whole.hint("rebalance", "day")
        even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(stored.path(part))
    return stored


def _marks(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """A row without user for every day, by which its partition exists and is replaced."""
    days = F.sequence(F.lit(first), F.lit(last))
    return spark.range(1).select(F.explode(days).alias("day"))
