"""Banner impressions, clicks, revenue and image weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.pages import first_segment
from wayfare.functions.references import BANNER_CLICK, BANNER_SHOW, banner_url
from wayfare.functions.times import AsOf, within_signup_days
from wayfare.sources.tables import Tables

LOOKBACK_DAYS = 30


def banner_events(tables: Tables, as_of: AsOf = None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Banner shows and clicks with the banner's place and the bare page name."""
    shown = tables.events_since(as_of, lookback_days).filter(
        F.col("event").isin(BANNER_SHOW, BANNER_CLICK)
    ).select("id", "user_id", "event", "attr_1", first_segment("page").alias("page_name"))
    known = tables.user.select(F.col("id").alias("user_id"))
    banners = tables.banner.select(
        F.col("id").alias("banner_id"), "device", "placement", F.col("id").cast("string").alias("attr_1")
    )
    return (
        shown.join(known, "user_id", "left_semi")
        .join(banners, "attr_1", "left")
        .select("id", "user_id", "event", "banner_id", "device", "placement", "page_name")
    )


def impressions(tables: Tables, as_of: AsOf = None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """``banner_id, users, impressions, impressions_24hours`` in one pass.

    Shows are counted per (reference, user, date) before they meet users and
    banners. Shows of unknown banners form the NULL group, which has no
    signup-day figure.
    """
    shows = (
        tables.events_since(as_of, lookback_days).filter(F.col("event") == BANNER_SHOW)
        .groupBy("attr_1", "user_id", F.to_date("created").alias("day"))
        .agg(F.count(F.lit(1)).alias("shows"))
    )
    signups = tables.user.select(F.col("id").alias("user_id"), F.col("created").alias("signed_up"))
    banners = tables.banner.select(F.col("id").alias("banner_id"), F.col("id").cast("string").alias("attr_1"))
    early = F.when(within_signup_days("day", "signed_up"), F.col("shows"))
    totals = (
        shows.join(signups, "user_id")
        .join(banners, "attr_1", "left")
        .groupBy("banner_id")
        .agg(
            F.count_distinct("user_id").alias("users"),
            F.sum("shows").alias("impressions"),
            F.sum(early).alias("early_shows"),
        )
    )
    return totals.select(
        "banner_id",
        "users",
        "impressions",
        F.when(F.col("banner_id").isNotNull(), F.col("early_shows")).alias("impressions_24hours"),
    )


def impressions_24h(tables: Tables, as_of: AsOf = None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Shows up to the day after signup; banners without any have no row."""
    early = impressions(tables, as_of, lookback_days).select("banner_id", "impressions_24hours")
    return early.filter(F.col("impressions_24hours").isNotNull())


def click_pages(tables: Tables, as_of: AsOf = None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Clicks on known banners and offers by known users, with the banner's place and the bare page name."""
    clicked = tables.clicks_since(as_of, lookback_days).filter(F.col("banner_id").isNotNull())
    offers = tables.offer.select(F.col("id").alias("offer_id"), "conversion_type")
    banners = tables.banner.select(F.col("id").alias("banner_id"), "device", "placement", "image_url", "priority")
    return (
        clicked.select(
            "id", "user_id", "banner_id", "offer_id", first_segment("page").alias("page_name"), "redirected_to_offer", "cpc_revenue"
        )
        .join(tables.user.select(F.col("id").alias("user_id")), "user_id", "left_semi")
        .join(offers, "offer_id")
        .join(banners, "banner_id")
    )


def clicks(
    tables: Tables,
    base_url: str,
    as_of: AsOf = None,
    lookback_days: int = LOOKBACK_DAYS,
    fan_out: bool = True,
) -> DataFrame:
    """Clicks, redirects, CPA clicks and revenue per banner.

    With ``fan_out`` a click counts once per postback, in the counts and in
    the click revenue; without, each click counts once. Postbacks of the clicks
    looked at are summed per click first, so neither form multiplies rows.
    """
    recent = tables.clicks_since(as_of, lookback_days).filter(F.col("banner_id").isNotNull())
    # Postbacks bear no date; those of older clicks go before they are added up.
    paid = tables.postback.withColumnRenamed("banner_click_id", "id").join(recent.select("id"), "id", "left_semi")
    postbacks = paid.groupBy("id").agg(F.count(F.lit(1)).alias("postbacks"), F.sum("payout").alias("payout"))
    offers = tables.offer.select(F.col("id").alias("offer_id"), "conversion_type")
    banners = tables.banner.select(F.col("id").alias("banner_id"), "image_url", "priority")
    known = tables.user.select(F.col("id").alias("user_id"))
    times = F.greatest(F.coalesce("postbacks", F.lit(0)), F.lit(1)) if fan_out else F.lit(1)
    is_cpa = F.col("conversion_type") != "cpc"
    weighed = (
        recent.select("id", "user_id", "banner_id", "offer_id", "redirected_to_offer", "cpc_revenue")
        .join(offers, "offer_id")
        .join(banners, "banner_id")
        .join(postbacks, "id", "left")
        .withColumn("times", times.cast("int"))
    )
    # Reduce to (banner, user) before users are looked up.
    per_user = weighed.groupBy("user_id", "banner_id", "priority", "image_url").agg(
        F.sum("times").alias("clicks"),
        F.sum(F.when(F.col("redirected_to_offer"), F.col("times"))).alias("redirects"),
        F.sum(F.when(is_cpa, F.col("times"))).alias("cpa_clicks"),
        F.sum("payout").alias("payout"),
        F.sum(F.col("cpc_revenue") * F.col("times")).alias("cpc_revenue"),
    )
    zero = F.lit(0)
    payout = F.coalesce(F.sum("payout"), zero)
    return (
        per_user.join(known, "user_id", "left_semi")
        .groupBy("banner_id", "priority", "image_url")
        .agg(
            F.sum("clicks").alias("clicks"),
            F.coalesce(F.sum("redirects"), zero).alias("redirects"),
            F.coalesce(F.sum("cpa_clicks"), zero).alias("cpa_clicks"),
            (payout + F.coalesce(F.sum("cpc_revenue"), zero)).cast("decimal(28,2)").alias("revenue"),
            payout.cast("decimal(28,2)").alias("cpa_revenue"),
        )
        .select(
            "banner_id",
            banner_url(base_url).alias("banner_url"),
            "clicks",
            "redirects",
            "cpa_clicks",
            "revenue",
            "cpa_revenue",
        )
    )


def banner_report(
    tables: Tables,
    base_url: str,
    as_of: AsOf = None,
    lookback_days: int = LOOKBACK_DAYS,
    fan_out: bool = True,
) -> DataFrame:
    """Impressions and clicks side by side, one row per shown banner."""
    clicked = clicks(tables, base_url, as_of, lookback_days, fan_out)
    shown = impressions(tables, as_of, lookback_days)
    return shown.join(clicked, "banner_id", "left").select(
        "banner_id",
        "banner_url",
        "users",
        "impressions",
        "impressions_24hours",
        "clicks",
        "redirects",
        "cpa_clicks",
        "revenue",
        "cpa_revenue",
    )


def with_weight(report: DataFrame, assets: DataFrame, base_url: str) -> DataFrame:
    """Add the image size in KB; NULL where no image is known."""
    sizes = assets.select(
        banner_url(base_url).alias("banner_url"), (F.col("size_bytes") / F.lit(1000)).alias("weight_kb")
    )
    return report.join(sizes, "banner_url", "left").select(*report.columns, "weight_kb")
