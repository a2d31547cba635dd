from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest

from tests.builders import at, event, money, tables, user
from wayfare.operators import banners

BASE = "https://img.example.com/b/"
AS_OF = "2024-01-31"
BANNERS = [{"id": 1, "image_url": "b1.gif", "priority": 1, "device": "mobile", "placement": "top"}]
OFFERS = [
    {"id": 1, "conversion_type": "cpa"},
    {"id": 2, "conversion_type": "cpc"},
    {"id": 3, "conversion_type": None},
]


def _click(id: int, **more) -> dict:
    return {"id": id, "user_id": 1, "banner_id": 1, "offer_id": 1, "created": at(), "redirected_to_offer": True, **more}


def test_postbacks_fan_out(spark):
    t = tables(
        spark,
        user=[user()],
        banner=BANNERS,
        offer=OFFERS,
        banner_click=[_click(1, cpc_revenue=money("2.00"))],
        postback=[{"banner_click_id": 1, "payout": money(p)} for p in ("1.25", "2.50")],
    )
    expected = {True: (2, 2, 2, "7.75", "3.75"), False: (1, 1, 1, "5.75", "3.75")}
    for fan_out, figures in expected.items():
        row = banners.clicks(t, BASE, AS_OF, fan_out=fan_out).first()
        assert row["banner_url"] == BASE + "b1.gif"
        counts = (row["clicks"], row["redirects"], row["cpa_clicks"])
        assert (*counts, row["revenue"], row["cpa_revenue"]) == (*figures[:3], *map(Decimal, figures[3:]))


def test_clicks_need_user_offer_and_banner(spark):
    clicked = [
        _click(1, user_id=2),
        _click(2, offer_id=9),
        _click(3, banner_id=None),
        _click(4, banner_id=7),
        _click(5, created=dt.datetime(2023, 12, 31)),
        _click(6, offer_id=3, redirected_to_offer=None),
        _click(7, offer_id=2, redirected_to_offer=False),
    ]
    t = tables(spark, user=[user()], banner=BANNERS, offer=OFFERS, banner_click=clicked)
    row = banners.clicks(t, BASE, AS_OF).first()
    assert (row["clicks"], row["redirects"], row["cpa_clicks"], row["revenue"]) == (2, 0, 0, Decimal("0.00"))


@pytest.mark.parametrize("seed", [1, 2])
def test_fan_out_equals_row_by_row_sums(spark, seed):
    rng = random.Random(seed)
    clicked = [
        _click(
            i,
            user_id=rng.choice([1, 2, 9]),
            offer_id=rng.choice([1, 2, 3, 8]),
            redirected_to_offer=rng.choice([True, False, None]),
            cpc_revenue=rng.choice([None, money("0.10"), money("3.33")]),
        )
        for i in range(40)
    ]
    paid = [
        {"banner_click_id": rng.randint(0, 60), "payout": rng.choice([None, money("1.25"), money("2.50")])}
        for _ in range(50)
    ]
    t = tables(spark, user=[user(1), user(2)], banner=BANNERS, offer=OFFERS, banner_click=clicked, postback=paid)
    kinds = {o["id"]: o["conversion_type"] for o in OFFERS}
    expected = {"clicks": 0, "redirects": 0, "cpa_clicks": 0, "revenue": Decimal(0), "cpa_revenue": Decimal(0)}
    for c in clicked:
        if c["user_id"] == 9 or c["offer_id"] == 8:
            continue
        for p in [p for p in paid if p["banner_click_id"] == c["id"]] or [{"payout": None}]:
            expected["clicks"] += 1
            expected["redirects"] += c["redirected_to_offer"] is True
            expected["cpa_clicks"] += kinds[c["offer_id"]] not in (None, "cpc")
            expected["cpa_revenue"] += p["payout"] or 0
            expected["revenue"] += (p["payout"] or 0) + (c["cpc_revenue"] or 0)
    once = banners.clicks(t, BASE, AS_OF, fan_out=False).first()
    row = banners.clicks(t, BASE, AS_OF).first()
    assert {name: row[name] for name in expected} == expected
    assert once["revenue"] <= row["revenue"]


def test_report_keeps_shows_of_unknown_banners(spark):
    shows = [
        event(1, at(), "banner_show", attr_1="1"),
        event(2, at(days=1), "banner_show", attr_1="1"),
        event(3, at(days=2), "banner_show", attr_1="1"),
        event(4, at(), "banner_show", attr_1="77"),
        event(5, at(), "banner_show", attr_1=None),
        event(6, at(), "banner_show", attr_1="1", user_id=5),
        event(7, at(), "banner_show", attr_1="1", user_id=2),
        event(8, at(), "route", attr_1="1"),
    ]
    t = tables(
        spark,
        user_event=shows,
        user=[user(1), user(2)],
        banner=[*BANNERS, {"id": 2, "image_url": "b2.gif", "priority": 1}],
        offer=OFFERS,
        banner_click=[_click(1), _click(2, banner_id=2)],
        assets=[{"image_url": "b1.gif", "size_bytes": 2500}],
    )
    rows = {r["banner_id"]: r for r in banners.banner_report(t, BASE, AS_OF).collect()}
    assert set(rows) == {1, None}
    known, unknown = rows[1], rows[None]
    assert (known["users"], known["impressions"], known["impressions_24hours"], known["clicks"]) == (2, 4, 3, 1)
    assert (unknown["users"], unknown["impressions"]) == (1, 2)
    assert unknown["impressions_24hours"] is None and unknown["clicks"] is None and unknown["banner_url"] is None
    early = banners.impressions_24h(t, AS_OF).collect()
    assert [tuple(r) for r in early] == [(1, 3)]
    weights = banners.with_weight(banners.banner_report(t, BASE, AS_OF), t.assets, BASE).collect()
    assert {r["banner_id"]: r["weight_kb"] for r in weights} == {1: 2.5, None: None}


def test_late_shows_leave_no_signup_day_figure(spark):
    t = tables(spark, user_event=[event(1, at(days=3), "banner_show", attr_1="1")], user=[user()], banner=BANNERS)
    assert banners.impressions(t, AS_OF).first()["impressions_24hours"] is None
    assert banners.impressions_24h(t, AS_OF).count() == 0


def test_banner_events(spark):
    rows = [
        event(1, at(), "banner_show", "https://app.example.com/ feed ?x=1", attr_1="1"),
        event(2, at(), "bnr_click", None, attr_1="z"),
        event(3, at(), "route", "https://app.example.com/browse", attr_1="1"),
    ]
    t = tables(spark, user_event=rows, user=[user()], banner=BANNERS)
    found = banners.banner_events(t, AS_OF).orderBy("id").collect()
    assert [tuple(r) for r in found] == [
        (1, 1, "banner_show", 1, "mobile", "top", "feed"),
        (2, 1, "bnr_click", None, None, None, None),
    ]
