"""Slices cut by count: a burst is spread, and nothing changes in the results."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.functions.times import epoch_millis
from wayfare.operators.gaps import event_gaps, presence, product_time
from wayfare.operators.journeys import chunked_events, chunked_pages, ordered_events, ordered_steps
from wayfare.operators.slices import with_slices


@pytest.fixture(scope="module")
def burst(spark):
    """A third of 30,000 events in 15 minutes of user 1, 3,000 of them in one second; the rest over users and days."""
    second = dt.datetime(2024, 1, 10, 12, 0, 7)
    start = F.lit(dt.datetime(2024, 1, 10, 12, 0, 0)).cast("timestamp_ntz")
    n = F.col("id")
    rows = spark.range(30000, numPartitions=6)
    micros = (
        F.when(n < 3000, F.lit(7_000_000) + n * 331)
        .when(n < 10000, F.pmod(n * 104729, F.lit(900_000_000)))
        .otherwise(F.pmod(n * 7919, F.lit(86400 * 5)) * 1_000_000)
    )
    created = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1_000_000).cast("decimal(18,6)"))
    user = F.when(n < 10000, 1).otherwise(F.pmod(n, F.lit(50)) + 1).cast("long")
    events = rows.select(user.alias("user_id"), created.alias("created"), "id", F.lit("route").alias("event"), F.concat(F.lit("p"), (n % 9).cast("string")).alias("page_name"))
    assert events.filter(F.col("created").between(F.lit(second), F.lit(second + dt.timedelta(seconds=1)))).count() >= 3000
    return events


def test_a_burst_is_cut_by_count(burst):
    parts = 64
    sizes = [r["count"] for r in with_slices(burst, ["user_id"], parts=parts).groupBy("user_id", "slice").count().collect()]
    # A piece ends with the millisecond in which its share is full.
    assert sum(sizes) == 30000 and max(sizes) <= 30000 / parts + 30
    uncut = [r["count"] for r in with_slices(burst, ["user_id"], parts=2).groupBy("user_id", "slice").count().collect()]
    assert max(uncut) >= 10000


def test_pieces_follow_time(burst):
    sliced = with_slices(burst, ["user_id"], parts=64)
    spans = sliced.groupBy("user_id", "slice").agg(F.min("created").alias("first"), F.max("created").alias("last"))
    following = F.lead("first").over(W.partitionBy("user_id").orderBy("slice"))
    assert spans.withColumn("next", following).filter("next <= last").count() == 0


def test_gaps_and_positions_equal_the_plain_window(burst):
    plain = W.partitionBy("user_id").orderBy("created", "id")
    expected = burst.select("id", (F.col("created") - F.lag("created").over(plain)).alias("plain"), F.row_number().over(plain).alias("number"))
    gaps = event_gaps(burst, parts=64).join(expected, "id")
    assert gaps.count() == 30000 and gaps.filter("NOT (gap <=> plain)").count() == 0
    steps = ordered_events(burst, ["user_id"], parts=64).groupBy("user_id").agg(F.max("position").alias("last"), F.count_distinct("position").alias("all"))
    assert steps.join(burst.groupBy("user_id").count(), "user_id").filter("last != count OR all != count").count() == 0
    first = ordered_steps(burst, ["user_id"], parts=64).filter("user_id = 1").orderBy("position").limit(50).collect()
    direct = burst.filter("user_id = 1").orderBy("created", "id").limit(50).collect()
    assert [(r["position"], r["page_name"]) for r in first] == [(i + 1, r["page_name"]) for i, r in enumerate(direct)]


def test_product_time_shuffles_seconds_not_events(burst):
    cap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(60))
    plain = W.partitionBy("user_id").orderBy("created")
    gaps = burst.select("user_id", (F.col("created") - F.lag("created").over(plain)).alias("gap")).filter(F.col("gap") <= cap)
    micros = F.sum(F.extract(F.lit("MINUTE"), "gap") * 60 + F.extract(F.lit("SECOND"), "gap"))
    expected = {r[0]: float(r[1]) for r in gaps.groupBy("user_id").agg(micros).collect()}
    assert dict(tuple(r) for r in product_time(burst, 60).collect()) == pytest.approx(expected)
    plan = product_time(burst, 60)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(created" in plan
    with pytest.raises(ValueError, match="second or more"):
        presence(burst, 0)


def test_chunks_are_bounded_and_joined_give_the_whole(burst):
    steps = ordered_steps(burst, ["user_id"], parts=64)
    chunks = chunked_pages(steps, ["user_id"], 100)
    assert chunks.agg(F.max("pages")).first()[0] == 100
    whole = ",".join(r["journey_pages"] for r in chunks.filter("user_id = 1").orderBy("chunk").collect())
    direct = burst.filter("user_id = 1").orderBy("created", "id").collect()
    assert whole == ",".join(r["page_name"] for r in direct)
    events = chunked_events(ordered_events(burst, ["user_id"], parts=64), ["user_id"], 100)
    rows = events.filter("user_id = 1").orderBy("chunk").collect()
    assert max(len(r["page_info_array"]) for r in rows) == 100
    assert [i["page_name"] for r in rows for i in r["page_info_array"]] == [r["page_name"] for r in direct]
    assert rows[0]["page_info_array"][0].asDict() == {"event": "route", "page_name": direct[0]["page_name"], "created_date": direct[0]["created"].date()}


def test_epoch_millis(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 678999),), (dt.datetime(1969, 12, 31, 23, 59, 59, 1000),)], "created timestamp_ntz")
    assert [r[0] for r in rows.select(epoch_millis("created")).collect()] == [1704164645678, -999]
