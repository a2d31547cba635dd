"""Column expressions that turn the driver's tables into the library's tables."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.daily import write_days
from wayfare.session import use_checkpoint_dir
from wayfare.sources.days import DaySettings
from wayfare.sources.schemas import LEXICON, TABLES
from wayfare.sources.tables import Tables, conform

FIRST_DAY = "2024-01-01"
SITE = "https://app.example.com"
WORDS = {
    "for": "0.6",
    "with": "0.9",
    "this": "0.3",
    "by": "0.1",
    "was": "-0.4",
    "from": "-0.9",
    "on": "-0.2",
    "as": "0.8",
}


# The columns read, with their types, so that opening a table starts no job.
COLUMNS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_size int",
    "supplier": "s_suppkey bigint",
    "conversations": "conv_id bigint, turn bigint, text string",
}


def load(spark: SparkSession, sf_dir: str, with_banners: bool = False) -> Tables:
    """The journey tables, and on request those of the banner reports."""
    events = _read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    user_event = _user_event(events)
    tables = {
        "user_event": user_event,
        "user": _user(_read(spark, sf_dir, "customer"), events),
        "user_visit": user_event.groupBy("user_visit_id", "user_id")
        .agg(F.min("created").alias("session_start"))
        .withColumnRenamed("user_visit_id", "id"),
        "offer": _offer(_read(spark, sf_dir, "part")),
    }
    if with_banners:
        banner = _banner(_read(spark, sf_dir, "supplier"))
        clicks = _banner_click(events)
        tables |= {
            "banner": banner,
            "banner_click": clicks,
            "postback": _postback(clicks),
            "assets": banner.select(
                "image_url", ((F.col("id") + 1) * 1000 + 500).alias("size_bytes")
            ),
        }
    return Tables(**{name: conform(df, TABLES[name]) for name, df in tables.items()})


def load_by_day(spark: SparkSession, sf_dir: str, settings: DaySettings, detailed: bool = False) -> Tables:
    """The journey tables with their events stored by day, in two steps that overlap, and no events."""
    tables = load(spark, sf_dir)
    use_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/days-{uuid.uuid4().hex}"
    write_days(tables, root, dt.date(2023, 12, 30), dt.date(2024, 1, 20), settings, detailed)
    days = write_days(tables, root, dt.date(2024, 1, 20), dt.date(2024, 3, 1), settings, detailed)
    return replace(tables, user_event=None, days=days)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(COLUMNS[table]).parquet(f"{sf_dir}/{table}.parquet")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations")


def lexicon(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(WORDS.items()), "word string, polarity string")
    return conform(rows, LEXICON)


def _user_event(events: DataFrame, *also: str) -> DataFrame:
    k, kind = F.col("k"), F.col("event_type")
    text = k.cast("string")

    def joined(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    event = (
        F.when(kind == "view", "route")
        .when(kind == "signup", F.when(k % 5 == 0, "chat_message_limit_reached").otherwise("user_visit"))
        .when(kind == "click", "bnr_click")
        .when(kind == "purchase", "redirected_to_offer")
        .when(
            kind == "error",
            F.when(k % 4 == 0, "user_afk").when(k % 4 == 1, "user_socket_disconnect").otherwise("banner_show"),
        )
    )
    attr_1 = (
        F.when(
            kind == "click",
            F.when(k % 4 == 0, "null").when(k % 4 == 1, joined("attr", (k % 9).cast("string"))).otherwise(text),
        )
        .when(kind == "purchase", text)
        .when(kind == "error", (k % 20).cast("string"))
    )
    attr_2 = F.when(
        kind == "click",
        F.when(k % 3 == 0, joined("btn", (k % 5).cast("string"))).otherwise((k % 10).cast("string")),
    )
    seventh, tenth = (k % 7).cast("string"), k % 10
    page = (
        F.when(tenth == 0, f"{SITE}/browse")
        .when(tenth == 1, joined(f"{SITE}/chats?id=", seventh))
        .when(tenth == 2, joined(f"{SITE}/profile/", seventh))
        .when(tenth == 3, joined(f"{SITE}/matches/", seventh, "?p=1"))
        .when(tenth == 4, joined(f"{SITE}/chats/", seventh))
        .when(tenth == 5, f"{SITE}/feed?x=1")
        .when(tenth == 6, "https://a.io/b")
        .when(tenth == 7, f"{SITE}/settings/" + "z" * 40)
        .when(tenth == 8, F.when(k != 8, f"{SITE}/"))
        .otherwise(f"{SITE}/a/b/c")
    )
    week = F.floor(F.date_diff(F.to_date("ts"), F.lit(FIRST_DAY).cast("date")) / F.lit(7))
    return events.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("ts").alias("created"),
        event.alias("event"),
        page.alias("page"),
        attr_1.alias("attr_1"),
        attr_2.alias("attr_2"),
        (F.col("user_id") * 100 + week).cast("string").alias("user_visit_id"),
        *also,
    )


def _user(customer: DataFrame, events: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    firsts = events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.min("ts").alias("first_ts"))
    info = F.format_string(
        '{"screen_size_width": "%d", "screen_size_height": "%d"}', F.lit(320) + key % 97, F.lit(640) + key % 203
    )
    return customer.join(firsts, "c_custkey", "left").select(
        key.alias("id"),
        F.coalesce("first_ts", F.lit(FIRST_DAY).cast("timestamp_ntz")).alias("created"),
        F.when(key % 3 == 2, "desktop").otherwise("mobile").alias("device"),
        F.when(key % 3 == 0, "iOS").when(key % 3 == 1, "Android").otherwise("Windows").alias("os"),
        F.col("c_mktsegment").alias("device_vendor"),
        F.when(key % 11 == 0, "{}").otherwise(info).alias("user_info"),
        F.when(key % 4 == 0, 1).when(key % 4 == 3, 3).otherwise(8).alias("conversion_funnel_id"),
        F.when(key % 13 != 0, F.concat(F.lit("src"), (F.col("c_nationkey") % 4).cast("string"))).alias("user_source"),
    )


def _offer(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select(
        key.alias("id"),
        (F.col("p_size") % 7).alias("offer_category_id"),
        F.when(key % 3 == 0, "cpc").when(key % 3 == 1, "cpa").alias("conversion_type"),
    )


def _banner(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        key.alias("id"),
        F.when(key % 2 == 0, "mobile").otherwise("desktop").alias("device"),
        F.concat(F.lit("slot"), (key % 3).cast("string")).alias("placement"),
        F.concat(F.lit("b"), key.cast("string"), F.lit(".gif")).alias("image_url"),
        (key % 5).alias("priority"),
    )


def _banner_click(events: DataFrame) -> DataFrame:
    clicked = _user_event(events, "k", "value").filter(F.col("event") == "bnr_click")
    number = F.col("attr_1").try_cast("int")
    last = F.substring("attr_1", -1, 1).try_cast("int")
    return clicked.select(
        "id",
        "user_id",
        F.when(F.col("id") % 17 != 0, number % 10).alias("banner_id"),
        (last + F.col("k")).alias("offer_id"),
        "page",
        "created",
        (F.col("id") % 3 == 0).alias("redirected_to_offer"),
        F.when(F.col("id") % 2 == 0, F.col("value").cast("decimal(18,2)")).alias("cpc_revenue"),
    )


def _postback(clicks: DataFrame) -> DataFrame:
    first = clicks.filter(F.col("id") % 3 == 0).select(
        F.col("id").alias("banner_click_id"), F.lit("1.25").cast("decimal(18,2)").alias("payout")
    )
    second = clicks.filter(F.col("id") % 6 == 0).select(
        F.col("id").alias("banner_click_id"), F.lit("2.50").cast("decimal(18,2)").alias("payout")
    )
    return first.unionByName(second)
