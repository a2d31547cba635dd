"""Session numbers, gaps, journeys: edge rows, and random rows against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.builders import SITE, at, event, tables, user, visit
from wayfare.operators.exports import items_from_journeys, pages_from_journeys, summary_from_journeys
from wayfare.operators.gaps import early_events, event_gaps, product_time
from wayfare.operators.journeys import (
    JourneyOptions,
    journey_events,
    numbered_visits,
    ordered_steps,
    page_counts,
    second_pages,
    session_items,
    session_measures,
    session_summary,
)
from wayfare.operators.visits import session_bounds
from wayfare.plans import journeys

OPTIONS = JourneyOptions(as_of="2024-01-12", lookback_days=20)
PAGE = f"{SITE}/{{}}".format


def _journeys(spark, names: list[str | None], **more):
    rows = [event(i, at(i), page=None if n is None else PAGE(n)) for i, n in enumerate(names)]
    t = tables(spark, user_event=rows, user=[user()], user_visit=[visit()], **more)
    return journeys.user_journey(t, OPTIONS).first()


@pytest.mark.parametrize(
    ("names", "text", "length"),
    [
        (["a", None, "", "b"], "a,,b", 3),
        ([""], "", 0),
        (["", ""], ",", 2),
        ([None], "", 0),
        (["nullable"], "able", 1),
        (["null"], "", 0),
        (["x,y", "z"], "x,y,z", 3),
    ],
)
def test_journey_string_and_length(spark, names, text, length):
    row = _journeys(spark, names)
    assert (row["journey_pages"], row["journey_len"]) == (text, length)


def test_offer_and_category_are_independent_maxima(spark):
    rows = [event(i, at(i), "redirected_to_offer", attr_1=str(offer)) for i, offer in enumerate((1, 2))]
    offers = [{"id": 1, "offer_category_id": 9}, {"id": 2, "offer_category_id": 3}]
    t = tables(spark, user_event=rows, user=[user()], user_visit=[visit()], offer=offers)
    row = journeys.user_journey(t, OPTIONS).first()
    assert (row["offer_id"], row["offer_category_id"], row["redirected"]) == (2, 9, 2)


def test_session_numbers(spark):
    rows = [event(i, at(10 * i), user_visit_id=v) for i, v in enumerate(("A1", "b", "d"))]
    visits = [
        visit("a1", start=at(0)),
        visit(" b ", start=at(0)),
        visit("unused", start=at(5)),
        visit("d", start=at(9000)),
    ]
    t = tables(spark, user_event=rows, user=[user()], user_visit=visits)
    found = {r["visit_id"]: r["session_number"] for r in numbered_visits(t, OPTIONS).collect()}
    assert found == {"a1": 1, "b": 1, "d": 2}


def test_session_cap_numbers_before_the_cut(spark):
    rows = [event(i, at(i * 4000), user_visit_id=f"v{i}", page=PAGE("a")) for i in range(7)]
    visits = [visit(f"v{i}", start=at(i * 4000)) for i in range(7)]
    t = tables(spark, user_event=rows, user=[user()], user_visit=visits)
    capped = journeys.user_journey_first5(
        t, JourneyOptions(page_rule="inverted", as_of="2024-01-12", max_session=5)
    )
    assert sorted(r["session_number"] for r in capped.collect()) == [1, 2, 3, 4, 5]


def test_unknown_users_and_visits_drop_out(spark):
    rows = [event(1, at(), user_id=2), event(2, at(), user_visit_id="gone"), event(3, at(), user_visit_id=None)]
    t = tables(spark, user_event=rows, user=[user()], user_visit=[visit()])
    assert journeys.user_journey(t, OPTIONS).count() == 0


def test_session_bounds(spark):
    starts = [at(0), at(100), at(5000), at(90000)]
    active = spark.createDataFrame(
        [(1, f"v{i}", 1, s) for i, s in enumerate(starts)] + [(1, "same", 1, starts[0])],
        "user_id long, visit_id string, owner_id long, session_start timestamp_ntz",
    )
    rows = session_bounds(active).orderBy("session_number").collect()
    assert [(r["session_number"], r["session_start"], r["session_end"]) for r in rows] == [
        (i + 1, s, starts[i + 1] if i < 3 else None) for i, s in enumerate(starts)
    ]


def test_product_time(spark):
    rows = [event(1, at(0)), event(2, at(900)), event(3, at(1800.5))]
    rows += [event(4, at(0), user_id=2), event(5, at(0), "user_afk", user_id=2), event(6, at(1), None, user_id=2)]
    rows += [event(7, at(0), user_id=3), event(8, at(5), user_id=3)]
    t = tables(spark, user_event=rows, user=[user(1), user(2), user(3, device="desktop")])
    found = product_time(early_events(t.user_event, t.user, as_of="2024-01-12"))
    assert [tuple(r) for r in found.collect()] == [(1, 900.0)]


def test_horizon_bounds_early_events(spark):
    edge = at(86400)
    rows = [event(1, at(0)), event(2, edge), event(3, edge + dt.timedelta(microseconds=1))]
    t = tables(spark, user_event=rows, user=[user(1)])
    found = early_events(t.user_event, t.user, as_of="2024-01-12")
    assert sorted(r["id"] for r in found.collect()) == [1, 2]


def test_old_signups_are_cut_without_loss(spark):
    """The signup bound implied by lookback and horizon keeps its edge."""
    signed = dt.datetime(2024, 1, 4)
    rows = [event(1, dt.datetime(2024, 1, 5)), event(2, dt.datetime(2024, 1, 5, 0, 0, 1))]
    t = tables(spark, user_event=rows, user=[user(1, created=signed)])
    found = early_events(t.user_event, t.user, as_of="2024-01-12", lookback_days=7)
    assert [r["id"] for r in found.collect()] == [1]


def test_pages_after_anchor(spark):
    rows = [
        event(1, at(0), page=PAGE("before")),
        event(2, at(5), "chat_message_limit_reached"),
        event(3, at(5), page=PAGE("same_moment")),
        event(4, at(6), page=PAGE("after")),
        event(5, at(7), "user_visit", page=PAGE("not_route")),
        event(6, at(8), "chat_message_limit_reached"),
        event(7, at(9), page=PAGE("last")),
        event(8, at(1), user_visit_id="v2", page=PAGE("no_anchor")),
    ]
    t = tables(spark, user_event=rows, user=[user()], user_visit=[visit(), visit("v2", start=at(3))])
    options = JourneyOptions(page_rule="inverted", as_of="2024-01-12", filter_visits=False, max_session=5)
    assert [tuple(r) for r in journeys.journey_after_event(t, options).collect()] == [(1, 1, 8, "after,last")]
    ends = journeys.summary_after_event(t, options).first()
    assert (ends["journey_len"], ends["first_page"], ends["last_page"]) == (2, "after", "last")


def test_visits_without_a_start_come_last(spark):
    rows = [event(i, at(i), "route", PAGE("a"), user_visit_id=v) for i, v in enumerate(("none", "late", "none2"))]
    visits = [visit("none", start=None), visit("late", start=at(90000)), visit("none2", start=None)]
    t = tables(spark, user_event=rows, user=[user()], user_visit=visits)
    options = JourneyOptions(as_of="2024-01-12", filter_visits=False)
    found = {r["visit_id"]: r["session_number"] for r in numbered_visits(t, options).collect()}
    assert found == {"late": 1, "none": 2, "none2": 2}


def test_user_pages_array(spark):
    rows = [event(1, at(5), page=PAGE("b")), event(2, at(1), page=PAGE("a")), event(3, at(2000), page=PAGE("null"))]
    rows += [event(4, at(0), "banner_show", page=PAGE("x")), event(5, at(0), page=PAGE("y"), user_id=2)]
    t = tables(spark, user_event=rows, user=[user(1, conversion_funnel_id=1), user(2)])
    assert [tuple(r) for r in journeys.user_pages_array(t, "2024-01-12").collect()] == [(1, 1, ["a", "b", "null"])]
    steps = journeys.user_page_steps(t, "2024-01-12").orderBy("position").collect()
    assert [tuple(r) for r in steps] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "null")]


def test_detailed_journey_lists_all_events(spark):
    rows = [event(2, at(5), "user_afk"), event(1, at(1), page=PAGE("a"))]
    t = tables(spark, user_event=rows, user=[user()], user_visit=[visit()])
    info = journeys.user_journey_detailed(t, JourneyOptions(page_rule="plain_id", as_of="2024-01-12")).first()
    day = at().date()
    assert [tuple(i) for i in info["page_info_array"]] == [("route", "a", day), ("user_afk", None, day)]


# --- random rows ------------------------------------------------------------

PAGES = ["a", "b", "", "null", "x,y", "chats?id=1", "chats/2", "chats/3,4", "profile/5", None, "nullnull", "c ,d?id=9"]
KINDS = ["route"] * 6 + ["bnr_click", "redirected_to_offer", "user_visit"]


def _random_tables(spark, seed: int):
    rng = random.Random(seed)
    visits = [visit(f"v{i}", rng.choice([1, 2, 3]), at(rng.choice([0, 0, 50, 300, 7000, 90000]))) for i in range(9)]
    rows = []
    for i in range(rng.randint(60, 160)):
        name = rng.choice(PAGES)
        rows.append(
            event(
                i,
                at(rng.choice([rng.randint(0, 40), rng.randint(0, 5000), rng.randint(0, 80000)])),
                rng.choice(KINDS),
                None if name is None else PAGE(name),
                user_id=rng.choice([1, 1, 1, 2, 3, 4]),
                user_visit_id=rng.choice(["v9", None, *[v["id"] for v in visits]]),
                attr_1=rng.choice(["1", "2", "a3", "null", None]),
                attr_2=rng.choice(["5", "b", None]),
            )
        )
    offers = [{"id": 1, "offer_category_id": 5}, {"id": 2, "offer_category_id": 4}]
    users = [user(i, conversion_funnel_id=i, created=at(-100 * i)) for i in (1, 2, 3)]
    return tables(spark, user_event=rows, user=users, user_visit=visits, offer=offers), rows, users, visits


def _name(row) -> str | None:
    """Bracketed page name, for the URLs used here."""
    url = row["page"]
    if row["event"] != "route" or url is None or not 19 < len(url) < 50:
        return None
    parts = url.split("/")
    if len(parts) == 4:
        head = parts[3].split("?")[0].strip()
        return f"{head}[{parts[3].split('id=')[1].strip()}]" if "id=" in url else head
    if len(parts) == 5:
        if "profile" in parts[3] or "matches" in parts[3]:
            return parts[3].split("?")[0].strip()
        return f"{parts[3].strip()}[{parts[4].strip()}]"
    return None


def _expected(rows, users, visits):
    known = {v["id"]: v for v in visits}
    kept = [r for r in rows if r["user_id"] in {u["id"] for u in users} and r["user_visit_id"] in known]
    starts: dict[int, set] = {}
    for r in kept:
        v = known[r["user_visit_id"]]
        starts.setdefault(v["user_id"], set()).add(v["session_start"])
    sessions: dict[tuple, list] = {}
    for r in sorted(kept, key=lambda r: (r["created"], r["id"])):
        v = known[r["user_visit_id"]]
        number = sorted(starts[v["user_id"]]).index(v["session_start"]) + 1
        sessions.setdefault((r["user_id"], number), []).append(r)
    result = {}
    for key, members in sessions.items():
        text = ",".join(n for n in map(_name, members) if n is not None).replace("null", "")
        refs = [
            r["attr_1"] if r["attr_1"] not in (None, "null") else r["attr_2"]
            for r in members
            if r["event"] == "bnr_click"
        ]
        result[key] = {
            "journey_pages": text,
            "journey_len": len(text.split(",")) if text else 0,
            "tokens": text.split(",") if text else [],
            "steps": [n for n in map(_name, members) if n is not None],
            "banner_clicks": sum(bool(r) and r.isdigit() for r in refs),
            "attr_clicks": sum(bool(r) and any(c.isalpha() for c in r) for r in refs),
            "redirected": sum(r["event"] == "redirected_to_offer" for r in members),
        }
    return result


@pytest.mark.parametrize("seed", range(5))
def test_random_sessions(spark, seed):
    t, rows, users, visits = _random_tables(spark, seed)
    expected = _expected(rows, users, visits)
    slices = {"slice_seconds": [7, 60, 900][seed % 3], "visit_slice_seconds": [900, 7, 60][seed % 3]}
    options = JourneyOptions(as_of="2024-01-12", lookback_days=20, **slices)
    figures = ["journey_len", "banner_clicks", "attr_clicks", "redirected"]

    texts = journeys.user_journey(t, options).select("user_id", "session_number", "journey_pages", *figures)
    assert {(r[0], r[1]): tuple(r)[2:] for r in texts.collect()} == {
        key: (e["journey_pages"], *[e[f] for f in figures]) for key, e in expected.items()
    }

    summary = session_summary(t, options).select("user_id", "session_number", *figures, "first_page", "last_page")
    assert {(r[0], r[1]): tuple(r)[2:] for r in summary.collect()} == {
        key: (*[e[f] for f in figures], *((e["tokens"][0], e["tokens"][-1]) if e["tokens"] else (None, None)))
        for key, e in expected.items()
    }

    events, numbered = journey_events(t, options), numbered_visits(t, options)
    seconds = {(r[0], r[1]): r[2] for r in second_pages(events, numbered).collect()}
    assert seconds == {key: e["tokens"][1] for key, e in expected.items() if len(e["tokens"]) > 1}

    steps: dict[tuple, list] = {}
    numbered_rows = events.join(numbered, ["user_id", "visit_id"])
    found = ordered_steps(numbered_rows, ["user_id", "session_number"], slice_seconds=options.slice_seconds)
    for r in found.orderBy("position").collect():
        steps.setdefault((r["user_id"], r["session_number"]), []).append((r["position"], r["page_name"]))
    assert steps == {key: list(enumerate(e["steps"], 1)) for key, e in expected.items() if e["steps"]}

    items = {(r[0], r[1]): set(r[2]) for r in session_items(events, numbered).collect()}
    assert items == {
        key: set(e["journey_pages"].split("[")[0].strip().split(",")) for key, e in expected.items() if e["steps"]
    }


@pytest.mark.parametrize("seed", [11, 12])
def test_exports_and_events_agree(spark, seed):
    """Journey strings, split again, give what the events give directly."""
    t, *_ = _random_tables(spark, seed)
    texts = journeys.user_journey(t, OPTIONS)
    events, numbered = journey_events(t, OPTIONS), numbered_visits(t, OPTIONS)

    ends = ["user_id", "session_number", "journey_len", "first_page", "last_page"]
    direct = session_measures(events, numbered)
    assert _bag(summary_from_journeys(texts).select(*ends)) == _bag(direct.select(*ends))

    journeyed = direct.filter("journey_len > 0")
    counted = page_counts(events, numbered).join(journeyed, ["user_id", "session_number"], "left_semi")
    keys = ["user_id", "session_number", "page"]
    assert _bag(pages_from_journeys(texts).groupBy(*keys).agg(F.sum("visits"))) == _bag(
        counted.groupBy(*keys).agg(F.sum("visits"))
    )

    named = texts.filter(F.col("journey_pages") != "")
    found = session_items(events, numbered).join(named, ["user_id", "session_number"], "left_semi")
    keys = ["user_id", "session_number", "items"]
    assert _bag(items_from_journeys(named).select(*keys)) == _bag(found.select(*keys))


@pytest.mark.parametrize("slice_seconds", [5, 900])
def test_random_gaps(spark, slice_seconds):
    rng = random.Random(slice_seconds)
    rows = [
        event(i, at(rng.choice([rng.randint(0, 60), rng.randint(0, 9000)])), user_id=rng.choice([1, 2]))
        for i in range(120)
    ]
    t = tables(spark, user_event=rows, user=[user(1), user(2)])
    early = early_events(t.user_event, t.user, as_of="2024-01-12")
    gaps, spent = {}, {}
    previous: dict[int, dt.datetime] = {}
    for r in sorted(rows, key=lambda r: (r["created"], r["id"])):
        owner = r["user_id"]
        gap = r["created"] - previous[owner] if owner in previous else None
        previous[owner], gaps[r["id"]] = r["created"], gap
        if gap is not None and gap <= dt.timedelta(seconds=100):
            spent[owner] = spent.get(owner, 0.0) + gap.total_seconds()
    assert {r["id"]: r["gap"] for r in event_gaps(early, slice_seconds).collect()} == gaps
    assert dict(tuple(r) for r in product_time(early, 100, slice_seconds).collect()) == spent


def _bag(df) -> list[str]:
    return sorted(str(tuple(r)) for r in df.collect())
