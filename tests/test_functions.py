from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.builders import SITE
from wayfare.functions import pages, references, times

RULES = ["bracketed", "with_visits", "plain_id", "inverted", "generic"]

NAMES = [
    ("route", f"{SITE}/browse", ["browse"] * 5),
    ("route", f"{SITE}/chats?id=3", ["chats[3]", "chats[3]", "chats", "chats[3]", "chats"]),
    ("route", f"{SITE}/profile/7", ["profile", "profile", "profile", "profile[7]", "profile"]),
    ("route", f"{SITE}/matches/7?p=1", ["matches", "matches", "matches", "matches[7?p=1]", "matches"]),
    ("route", f"{SITE}/chats/7", ["chats[7]", "chats[7]", "chats[7]", "chats", "chats"]),
    ("route", "https://a.io/b", [None, "b", None, None, "b"]),
    ("user_visit", f"{SITE}/browse", [None, "browse", None, None, "browse"]),
    ("user_visit", "https://a.io/b", [None] * 5),
    ("route", f"{SITE}/a/b/c", [None] * 5),
    ("route", f"{SITE}/", [""] * 5),
    ("route", None, [None] * 5),
    (None, f"{SITE}/browse", [None] * 5),
    ("banner_show", f"{SITE}/browse", [None] * 5),
    ("route", f"{SITE}/chats/7?id=1", ["chats[7?id=1]", "chats[7?id=1]", "chats[7?id=1]", "chats", "chats"]),
    ("route", f"{SITE}/ feed ?x=1", ["feed"] * 5),
]


def test_page_names(spark):
    df = spark.createDataFrame([(i, e, p) for i, (e, p, _) in enumerate(NAMES)], "i int, event string, page string")
    rows = df.select("i", *[pages.page_name(rule).alias(rule) for rule in RULES]).orderBy("i").collect()
    assert [[row[rule] for rule in RULES] for row in rows] == [expected for _, _, expected in NAMES]


def test_page_length_limits(spark):
    urls = [("https://a.io/" + "b" * n)[:size] for n in (60,) for size in (19, 20, 49, 50)]
    df = spark.createDataFrame([("route", u) for u in urls], "event string, page string")
    found = [r[0] for r in df.select(pages.page_name("bracketed").isNotNull()).collect()]
    assert found == [False, True, True, False]


def test_banner_reference(spark):
    rows = [("bnr_click", "null", "x"), ("bnr_click", None, "x"), ("bnr_click", "5", "x"), ("route", "5", "x")]
    df = spark.createDataFrame(rows, "event string, attr_1 string, attr_2 string")
    assert [r[0] for r in df.select(references.banner_ref()).collect()] == ["x", "x", "5", "x"]


def test_click_kinds(spark):
    rows = [("bnr_click", ref) for ref in ("12", "12\n", "a1", None, "")] + [("route", "12")]
    df = spark.createDataFrame(rows, "event string, ref string")
    kinds = df.select(
        F.coalesce(references.is_banner_click("event", "ref"), F.lit(False)),
        F.coalesce(references.is_attribute_click("event", "ref"), F.lit(False)),
    ).collect()
    no = (False, False)
    assert [tuple(k) for k in kinds] == [(True, False), no, (False, True), no, no, no]


def test_offer_reference(spark):
    rows = [("redirected_to_offer", "7"), ("redirected_to_offer", "x7"), ("route", "7"), ("redirected_to_offer", None)]
    df = spark.createDataFrame(rows, "event string, attr_1 string")
    assert [r[0] for r in df.select(references.offer_ref()).collect()] == [7, None, None, None]


@pytest.mark.parametrize(
    ("info", "size"),
    [
        ('{"screen_size_width": "375", "screen_size_height": "812"}', "370x810"),
        ('{"screen_size_width": 375, "screen_size_height": 812}', "370x810"),
        ('{"screen_size_width": "375"}', "370x"),
        ("{}", "x"),
        (None, "x"),
        ('{"screen_size_width": "wide"}', "x"),
    ],
)
def test_screen_size(spark, info, size):
    df = spark.createDataFrame([(info,)], "user_info string")
    assert df.select(references.screen_size()).first()[0] == size


def test_journey_length(spark):
    texts = [("a,,b", 3), ("", 0), (",", 2), ("able", 1)]
    df = spark.createDataFrame(texts, "j string, n int")
    assert all(a == b for a, b in df.select(pages.journey_length("j"), "n").collect())


def test_lookback_counts_dates(spark):
    stamps = [dt.datetime(2024, 1, 23, 23, 59, 59), dt.datetime(2024, 1, 24), dt.datetime(2024, 2, 9)]
    df = spark.createDataFrame([(s,) for s in stamps], "created timestamp_ntz")
    assert [r[0] for r in df.select(times.since("created", "2024-01-31", 7)).collect()] == [False, True, True]


def test_signup_horizons(spark):
    signup = dt.datetime(2024, 1, 1, 0, 1)
    exact = signup + dt.timedelta(hours=24)
    rows = [exact, exact + dt.timedelta(microseconds=1), dt.datetime(2024, 1, 2, 23, 59), dt.datetime(2024, 1, 3)]
    df = spark.createDataFrame([(r, signup) for r in rows], "created timestamp_ntz, signed timestamp_ntz")
    found = df.select(times.within_horizon("created", "signed", 24), times.within_signup_days("created", "signed"))
    assert [tuple(r) for r in found.collect()] == [(True, True), (False, True), (False, True), (False, False)]


def test_interval_seconds_is_exact(spark):
    df = spark.sql("SELECT INTERVAL '40 23:59:59.999999' DAY TO SECOND AS i")
    assert df.select(times.interval_seconds("i")).first()[0] == 40 * 86400 + 86399.999999


def test_slices_follow_time(spark):
    rows = [dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(1970, 1, 1), dt.datetime(2024, 3, 31, 2, 30), None]
    df = spark.createDataFrame([(r,) for r in rows], "t timestamp_ntz")
    found = [r[0] for r in df.select(times.slice_of("t", 900)).collect()]
    assert found[:2] == [-1, 0]
    assert found == sorted(found)
    assert found[2] == int(dt.datetime(2024, 3, 31, 2, 30, tzinfo=dt.timezone.utc).timestamp()) // 900


def test_slices_ignore_the_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 2, 30),)], "t timestamp_ntz").select(times.slice_of("t", 900))
    utc = df.first()[0]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert df.first()[0] == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
