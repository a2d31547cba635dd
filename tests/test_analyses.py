from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from wayfare.operators import conversion, groups, pages, patterns
from wayfare.operators.exports import items_from_journeys, pages_from_journeys, summary_from_journeys
from wayfare.operators.filters import converted, fill_missing, not_converted
from wayfare.operators.keys import hot_keys, with_hot_keys

SESSIONS = """user_id long, session_number int, funnel_id int, offer_category_id int, offer_id int, user_source string,
product_time double, journey_pages string, banner_clicks long, attr_clicks long, redirected long"""


def _sessions(spark, rows: list[dict]):
    names = [column.split()[0] for column in SESSIONS.replace("\n", " ").split(",")]
    plain = {
        "user_id": 1,
        "session_number": 1,
        "funnel_id": 8,
        "product_time": 10.0,
        "banner_clicks": 0,
        "attr_clicks": 0,
        "redirected": 0,
    }
    return spark.createDataFrame([tuple({**plain, **row}.get(n) for n in names) for row in rows], SESSIONS)


def _from_journeys(spark, texts: list[str | None], **more):
    rows = [{"user_id": i, "journey_pages": text, **more} for i, text in enumerate(texts)]
    return summary_from_journeys(_sessions(spark, rows))


def test_filters_drop_missing_figures(spark):
    df = _sessions(
        spark,
        [
            {"user_id": 1, "redirected": 1},
            {"user_id": 2, "redirected": 1, "product_time": None},
            {"user_id": 3, "redirected": 1, "product_time": 9.0},
            {"user_id": 4, "redirected": 1, "funnel_id": 3},
            {"user_id": 5, "redirected": 1, "funnel_id": 1, "session_number": 6},
            {"user_id": 6},
            {"user_id": 7, "banner_clicks": 1},
            {"user_id": 8, "session_number": 6},
            {"user_id": 9, "funnel_id": 1},
        ],
    )

    def ids(condition):
        return sorted(r[0] for r in df.filter(condition).select("user_id").collect())

    assert ids(converted()) == [1, 5]
    assert ids(converted([8], 5)) == [1]
    assert ids(not_converted(max_session=5)) == [6, 9]
    assert ids(not_converted([8])) == [6, 8]


def test_fill_missing_covers_texts(spark):
    row = fill_missing(_sessions(spark, [{"offer_category_id": None, "journey_pages": None}])).first()
    assert (row["offer_category_id"], row["journey_pages"], row["user_source"]) == (0, "0", "0")


@pytest.mark.parametrize(("users", "percent"), [(200, 0.0), (40, 2.0), (3, 33.0)])
def test_percent_rounds_half_to_even(spark, users, percent):
    rows = [{"user_id": i, "banner_clicks": int(i == 0)} for i in range(users)]
    stats = conversion.conversion_stats(summary_from_journeys(_sessions(spark, rows)), ["funnel_id"])
    assert stats.first()["banner_click_pct"] == percent


def test_conversion_stats(spark):
    rows = [
        {"user_id": 1, "banner_clicks": 3, "attr_clicks": 1, "redirected": 1, "journey_pages": "a,b"},
        {"user_id": 1, "session_number": 2, "redirected": 2, "product_time": 20.5, "journey_pages": ""},
        {"user_id": 2, "funnel_id": 1, "journey_pages": "a"},
    ]
    sessions = summary_from_journeys(_sessions(spark, rows))
    stats = conversion.conversion_stats(sessions, ["funnel_id"], ["funnel_id"], ascending=True)
    assert [r["funnel_id"] for r in stats.collect()] == [1, 8]
    row = stats.collect()[1]
    assert (row["total_user"], row["banner_click"], row["attribute_click"], row["total_click"]) == (1, 3, 1, 4)
    assert (row["journey_len"], row["product_time"], row["total_click_pct"]) == (1.0, 15.25, 400.0)
    assert "Total Click %" in conversion.with_titles(stats).columns


def test_grouping_sets_equal_single_groupings(spark):
    rng = random.Random(1)
    rows = [
        {
            "user_id": rng.randint(1, 9),
            "session_number": rng.randint(1, 3),
            "funnel_id": rng.choice([1, 8]),
            "banner_clicks": rng.randint(0, 2),
        }
        for _ in range(60)
    ]
    sessions = summary_from_journeys(_sessions(spark, rows))
    key_sets = [["funnel_id"], ["session_number"], ["funnel_id", "session_number"]]
    together = conversion.conversion_stats_sets(sessions, key_sets)
    for keys in key_sets:
        alone = conversion.conversion_stats(sessions, keys)
        part = together.filter(F.col("grouping") == "+".join(keys)).select(*alone.columns)
        assert sorted(map(tuple, part.collect())) == sorted(map(tuple, alone.collect()))


def test_users_with_many_sessions_count_once(spark):
    rng = random.Random(7)
    rows = [
        (rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 8]), rng.choice([None, 1, 2]), rng.choice(["a", "b"]),
         rng.randint(0, 3), rng.randint(0, 1), rng.randint(0, 2), rng.choice([None, 0, 5]), rng.choice([None, 0.25, 7.000001]))
        for _ in range(80)
    ]
    names = "user_id long, funnel_id int, offer_category_id int, screen_size string, banner_clicks long, attr_clicks long, redirected long, journey_len int, product_time double"
    sessions = spark.createDataFrame(rows, names)
    key_sets = [["funnel_id"], ["offer_category_id"], ["screen_size"], ["funnel_id", "offer_category_id"]]
    together = conversion.conversion_stats_sets(sessions, key_sets)
    for keys in key_sets:
        groups_of = {}
        for row in (dict(zip(sessions.columns, r)) for r in rows):
            groups_of.setdefault(tuple(row[k] for k in keys), []).append(row)
        expected = {}
        for key, held in groups_of.items():
            lengths = [r["journey_len"] for r in held if r["journey_len"] is not None]
            times = [r["product_time"] for r in held if r["product_time"] is not None]
            expected[key] = (
                len({r["user_id"] for r in held} - {None}),
                sum(r["banner_clicks"] for r in held),
                sum(r["redirected"] for r in held),
                sum(lengths) / len(lengths) if lengths else None,
                pytest.approx(sum(times) / len(times)) if times else None,
            )
        for stats in (together.filter(F.col("grouping") == "+".join(keys)), conversion.conversion_stats(sessions, keys)):
            found = {tuple(r[k] for k in keys): (r.total_user, r.banner_click, r.redirected, r.journey_len, r.product_time) for r in stats.collect()}
            assert found == expected


def test_second_page(spark):
    sessions = _from_journeys(spark, ["a,b[1],c", "a,b,a", "a", None, "", "d,b[2]"], redirected=1)
    assert [tuple(r) for r in pages.second_page_counts(sessions).collect()] == [(8, "1", "b", 2)]


def test_session_sorts_as_text(spark):
    rows = [{"session_number": n, "journey_pages": "a,b", "user_id": n} for n in (2, 10, 1)]
    counted = pages.second_page_counts(summary_from_journeys(_sessions(spark, rows)))
    assert [r["session"] for r in counted.collect()] == ["1", "10", "2"]


def test_last_page(spark):
    sessions = _from_journeys(spark, ["a,b", "a,b,a", "a", None, "chats[1],chats[2]", "x[1]"])
    found = {r["page_name"]: r["count"] for r in pages.last_page_counts(sessions).collect()}
    assert found == {"b": 1, "a": 1, "nan": 1, "chats": 1, "x": 1}


def test_nonconverted_by_source(spark):
    texts = ["a,b", "a,chats[1]", None, "chats,b", "my chats"]
    rows = [{"user_id": i % 3, "journey_pages": t, "user_source": "s"} for i, t in enumerate(texts)]
    found = conversion.nonconverted_by_source(summary_from_journeys(_sessions(spark, rows)))
    assert [tuple(r) for r in found.collect()] == [(8, "s", 0, 0.0, 2)]


def test_ending_counts(spark):
    sessions = _from_journeys(spark, ["a,chats[1]", "chats[1],a", "chats", None])
    assert [tuple(r) for r in pages.ending_counts(sessions).collect()] == [(8, "1", "chats", 1)]


def test_page_counts(spark):
    sessions = _from_journeys(spark, ["a[1],a [2], b", "a,,a[1]", None, ""])
    rows = pages_from_journeys(sessions)
    visited = [tuple(r) for r in pages.page_visits(sessions, rows).collect()]
    assert visited == [("a", 4), ("", 1), ("b", 1)]
    popular = {r["page"]: r["visits"] for r in pages.popular_interactions(sessions, rows).collect()}
    assert popular == {"a[1]": 2, "a [2]": 1, " b": 1, "a": 1, "": 1, "Null": 2}
    every = {r[0] for r in pages.all_pages(sessions, rows).collect()}
    assert every == {"a[1]", "a", "a [2]", "a ", " b", "", "0"}
    assert sum(r[1] for r in visited) == rows.count()


def test_average_page_per_user(spark):
    sessions = _from_journeys(spark, ["browse,a,browse", "browse[1]", None, "a"])
    rows = pages_from_journeys(sessions)
    assert pages.average_page_per_user(sessions, rows).first()[0] == 0.5
    assert pages.average_page_per_user(sessions.limit(0), rows).first()[0] is None


def test_items(spark):
    texts = ["browse,chats[5],feed", "a,a", None, "a , [x]"]
    journeys = _from_journeys(spark, texts)
    truncated = [set(r["items"]) for r in items_from_journeys(journeys).orderBy("user_id").collect()]
    assert truncated == [{"browse", "chats"}, {"a"}, {""}, {"a ", ""}]
    per_page = [set(r["items"]) for r in items_from_journeys(journeys, "per_page").orderBy("user_id").collect()]
    assert per_page == [{"browse", "chats", "feed"}, {"a"}, {""}, {"a", ""}]


def test_transactions_keep_sessions_without_pages(spark):
    sessions = spark.createDataFrame([(1, 1), (2, 1)], "user_id long, session_number int")
    items = spark.createDataFrame(
        [(1, 1, ["a"]), (3, 1, ["b"])], "user_id long, session_number int, items array<string>"
    )
    assert sorted(r["items"] for r in patterns.transactions(sessions, items).collect()) == [[""], ["a"]]


@pytest.mark.parametrize("total", [100, 700, 3])
def test_itemsets_equal_brute_force(spark, total):
    rng = random.Random(total)
    baskets = [sorted({rng.choice("aaabbcdefgh") for _ in range(rng.randint(1, 5))}) for _ in range(total)]
    found = patterns.frequent_itemsets(spark.createDataFrame([(b,) for b in baskets], "items array<string>"), 0.01)
    counts: dict[tuple, int] = {}
    for basket in baskets:
        for size in range(1, len(basket) + 1):
            for subset in itertools.combinations(basket, size):
                counts[subset] = counts.get(subset, 0) + 1
    expected = {items: n for items, n in counts.items() if n / total >= 0.01}
    rows = found.collect()
    assert {tuple(r["items"]): r["freq"] for r in rows} == expected
    assert all(r["support"] == r["freq"] / total and r["size"] == len(r["items"]) for r in rows)
    supports = [r["support"] for r in rows]
    assert supports == sorted(supports, reverse=True)


def test_support_on_the_limit_is_kept(spark):
    baskets = [(["x"],)] * 7 + [(["y"],)] * 693
    found = patterns.frequent_itemsets(spark.createDataFrame(baskets, "items array<string>"), 0.01)
    assert {tuple(r["items"]) for r in found.collect()} == {("x",), ("y",)}


@pytest.mark.parametrize("parts", [1, 3])
def test_itemsets_equal_the_miner_of_spark(spark, parts):
    rng = random.Random(parts)
    baskets = [([rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))],) for _ in range(300)]
    frame = spark.createDataFrame(baskets, "items array<string>").repartition(parts)
    whole = frame.select(F.array_distinct("items").alias("items"))
    mined = FPGrowth(itemsCol="items", minSupport=0.05).fit(whole).freqItemsets
    expected = {(tuple(sorted(r["items"])), r["freq"]) for r in mined.collect()}
    found = patterns.frequent_itemsets(frame, 0.05)
    assert {(tuple(r["items"]), r["freq"]) for r in found.collect()} == expected
    nulls = spark.createDataFrame([(["a", None, "a"],), ([None],)], "items array<string>")
    assert [tuple(r) for r in patterns.frequent_itemsets(nulls, 0.5).collect()] == [(["a"], 1, 1, 0.5)]
    assert patterns.frequent_itemsets(frame.limit(0), 0.1).collect() == []


def test_itemsets_run_when_they_are_read(spark):
    def fail(batches):
        raise RuntimeError("read")

    unread = spark.range(10).select(F.array(F.lit("a")).alias("items")).mapInArrow(fail, "items array<string>")
    found = patterns.frequent_itemsets(unread, 0.1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_supported_sets():
    sets, counts = [["a", "b"], ["a", "b", "c"], ["c"], []], np.array([2, 1, 4, 9])
    assert sorted(patterns.supported(sets, counts, 3)) == [["a"], ["a", "b"], ["b"], ["c"]]
    assert list(patterns.supported([], np.array([], np.int64), 0.0)) == []


@pytest.mark.parametrize("share", [0.0, 0.01, 0.2, 0.35, 1.0, 3.0])
def test_top_groups_equal_a_full_sort(spark, share):
    rng = random.Random(3)
    rows = [
        {
            "user_id": i,
            "funnel_id": rng.choice([1, 8, None]),
            "session_number": rng.randint(1, 4),
            "offer_category_id": rng.choice([1, 2, None]),
            "offer_id": rng.randint(1, 6),
            "redirected": rng.choice([0, 0, 1, 2]),
        }
        for i in range(150)
    ]
    sessions = summary_from_journeys(_sessions(spark, rows))
    sums: dict[tuple, int] = {}
    for r in rows:
        key = (r["funnel_id"], r["session_number"], r["offer_category_id"], r["offer_id"])
        if None not in key:
            sums[key] = sums.get(key, 0) + r["redirected"]
    best = sorted(sums.items(), key=lambda kv: (-kv[1], kv[0]))[: int(len(rows) * share)]
    found = groups.top_groups(sessions, share)
    assert {tuple(r)[:4]: r["redirected"] for r in found.collect()} == dict(best)

    top = set(dict(best))

    def ids(keep):
        return sorted(
            r["user_id"]
            for r in rows
            if keep((r["funnel_id"], r["session_number"], r["offer_category_id"], r["offer_id"]) in top, r)
        )

    inside = groups.rows_in_groups(sessions, found).collect()
    assert sorted(r["user_id"] for r in inside) == ids(lambda is_top, r: is_top and r["redirected"] > 0)
    outside = groups.rows_outside_groups(sessions, found).collect()
    assert sorted(r["user_id"] for r in outside) == ids(lambda is_top, r: not is_top)


def test_selection_reads_cuts_without_a_task_for_all(spark):
    rows = [{"user_id": i, "funnel_id": 8, "offer_category_id": 1, "offer_id": i % 7, "redirected": 2 ** (i % 40)} for i in range(80)]
    sessions = summary_from_journeys(_sessions(spark, rows))
    found = groups.top_groups(sessions, 0.05)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    sums: dict[int, int] = {}
    for r in rows:
        sums[r["offer_id"]] = sums.get(r["offer_id"], 0) + r["redirected"]
    best = sorted(sums.items(), key=lambda kv: (-kv[1], kv[0]))[:4]
    assert {(r["offer_id"], r["redirected"]) for r in found.collect()} == set(best)


def test_hot_and_missing_keys_do_not_gather(spark):
    """Nine tenths of the sessions on one key, some on none: the hot ones are decided where they are read."""
    keys = ("funnel_id", "session_number", "offer_category_id", "offer_id")
    rows = [
        {
            "user_id": i,
            "funnel_id": None if i % 100 == 7 else 8,
            "offer_category_id": 1,
            "offer_id": 5 if i % 10 else 100 + i,
            "redirected": 1,
        }
        for i in range(3000)
    ]
    sessions = summary_from_journeys(_sessions(spark, rows)).repartition(8)
    members = spark.createDataFrame([(8, 1, 1, 5), (8, 1, 1, 110), (8, 1, 1, 9999)], "funnel_id int, session_number int, offer_category_id int, offer_id int")
    assert [tuple(r) for r in hot_keys(sessions, keys).collect()] == [(8, 1, 1, 5)]
    inside = {i for i, r in enumerate(rows) if r["funnel_id"] and r["offer_id"] in (5, 110)}
    assert {r["user_id"] for r in groups.rows_in_groups(sessions, members, converted_only=False).collect()} == inside
    assert {r["user_id"] for r in groups.rows_outside_groups(sessions, members).collect()} == set(range(3000)) - inside
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # The rows that reach the shuffled join are those of neither kind.
        plan = groups.rows_outside_groups(sessions, members)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2 and re.search(r"SortMergeJoin.*LeftAnti", plan)
        marked = with_hot_keys(sessions, members, keys)
        assert marked.filter("_member IS NULL AND funnel_id IS NOT NULL").count() == 300 - len([r for i, r in enumerate(rows) if i % 10 == 0 and not r["funnel_id"]])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_single_session_converted(spark):
    rows = [
        {"user_id": 1, "funnel_id": 1, "redirected": 1},
        {"user_id": 2, "funnel_id": 1, "redirected": 1},
        {"user_id": 2, "funnel_id": 1, "session_number": 2},
        {"user_id": 3, "funnel_id": 8, "redirected": 1},
        {"user_id": 4, "funnel_id": 1, "redirected": 0},
        {"user_id": 5, "funnel_id": 1, "redirected": 1, "product_time": 3.0},
    ]
    found = groups.single_session_converted(_sessions(spark, rows))
    assert [r["user_id"] for r in found.collect()] == [1]


def test_nonconverted_sessions_without_source_are_group_zero(spark):
    from wayfare.operators import conversion, filters

    rows = [(1, 8, None, 0, None, None, 20.0, "feed"), (2, 8, "a", 0, 0, 0, 20.0, None), (3, 8, "a", 0, 0, 0, 20.0, "chats")]
    sessions = spark.createDataFrame(
        rows,
        "user_id int, funnel_id int, user_source string, redirected long, banner_clicks long, attr_clicks long, product_time double, last_page string",
    )
    kept = filters.fill_missing(sessions).filter(filters.not_converted([filters.MAIN_FUNNEL]))
    found = {(r.user_source, r.users) for r in conversion.nonconverted_by_source(kept).collect()}
    assert found == {("0", 1), ("a", 1)}
