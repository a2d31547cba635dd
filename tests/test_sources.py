from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.builders import at, event, tables, user, visit
from wayfare.operators.exports import summary_from_journeys
from wayfare.plans import journeys
from wayfare.sources import files
from wayfare.sources.schemas import TABLES
from wayfare.sources.tables import Tables, jdbc_options


def test_parquet_tables(spark, tmp_path):
    seen = [event(1, at(), page="https://app.example.com/browse")]
    t = tables(spark, user_event=seen, user=[user()], user_visit=[visit()])
    for name in TABLES:
        getattr(t, name).write.parquet(f"{tmp_path}/{name}")
    loaded = Tables.from_parquet(spark, str(tmp_path))
    options = journeys.JourneyOptions(as_of="2024-01-12")
    assert journeys.user_journey(loaded, options).first()["journey_pages"] == "browse"


def test_journey_export_round_trip(spark, tmp_path):
    rows = [event(i, at(i), page=f"https://app.example.com/{n}") for i, n in enumerate(('say "x"', "a", "b"))]
    rows.append(event(9, at(9), user_visit_id="v2"))
    t = tables(spark, user_event=rows, user=[user()], user_visit=[visit(), visit("v2", start=at(5))])
    made = journeys.user_journey(t, journeys.JourneyOptions(as_of="2024-01-12"))
    files.write_csv(made, str(tmp_path / "export"))
    back = files.read_journeys(spark, str(tmp_path / "export")).orderBy("session_number").collect()
    assert [r["journey_pages"] for r in back] == ['say "x",a,b', None]
    assert [r["journey_len"] for r in back] == [3, 0]
    assert back[0]["screen_size"] == "x" and back[0]["session_number"] == 1
    ends = summary_from_journeys(files.read_journeys(spark, str(tmp_path / "export"))).orderBy("session_number")
    assert [r["last_page"] for r in ends.collect()] == ["b", None]


def test_other_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,session_number,funnel_id,journey_pages\n1,2,8,\"a,b\"\n2,1,1,\n")
    rows = files.read_after_event(spark, str(tmp_path / "a.csv")).orderBy("user_id").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 8, "a,b"), (2, 1, 1, None)]
    assert "user_source" in files.read_users_analytics(spark, str(tmp_path / "a.csv")).columns


def test_feedback_spans_lines(spark, tmp_path):
    (tmp_path / "f.csv").write_text('text\n"two\nlines, and ""quotes"""\nplain\n')
    texts = [r["text"] for r in files.read_feedback(spark, str(tmp_path / "f.csv")).collect()]
    assert texts == ['two\nlines, and "quotes"', "plain"]


def test_lexicon(spark, tmp_path):
    (tmp_path / "l.csv").write_text("word,polarity\ngood,0.70\n")
    assert str(files.read_lexicon(spark, str(tmp_path / "l.csv")).first()["polarity"]) == "0.70"


def test_image_sizes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b1.gif").write_bytes(b"x" * 1500)
    assert [tuple(r) for r in files.read_image_sizes(spark, str(tmp_path)).collect()] == [("sub/b1.gif", 1500)]


def test_json_sink(spark, tmp_path):
    files.write_json(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["s"] == "a"


def test_jdbc_options():
    connection = {"url": "jdbc:postgresql://host/db", "user": "u"}
    split = {"partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "4"}
    options = jdbc_options(connection, table="user_event", split=split)
    assert options["dbtable"] == "user_event" and options["numPartitions"] == "4"
    assert options["preferTimestampNTZ"] == "true"
    assert jdbc_options(connection, query="SELECT 1")["dbtable"] == "(SELECT 1) AS source_query"
    with pytest.raises(ValueError):
        jdbc_options(connection)
    with pytest.raises(ValueError):
        jdbc_options(connection, table="a", split={"numPartitions": "4"})


def test_image_sizes_keep_equal_names_of_two_folders_apart(spark, tmp_path):
    for folder, size in (("one", 10), ("two", 20)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "b1.gif").write_bytes(b"x" * size)
    found = {tuple(r) for r in files.read_image_sizes(spark, str(tmp_path)).collect()}
    assert found == {("one/b1.gif", 10), ("two/b1.gif", 20)}


def test_events_by_day_are_pruned(spark, tmp_path):
    from pyspark.sql import functions as F

    from wayfare.sources.schemas import TABLES
    from wayfare.sources.tables import Tables

    rows = spark.createDataFrame([], TABLES["user_event"])
    made = rows.union(spark.range(3).select(*[
        (F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2024-01-10").cast("timestamp")).cast(f.dataType) if f.name == "created" else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in TABLES["user_event"].fields
    ]))
    made.withColumn("day", F.to_date("created")).write.partitionBy("day").parquet(str(tmp_path / "user_event"))
    tables = Tables.from_parquet(spark, str(tmp_path), names=["user_event"], event_day="day")
    recent = tables.events_since("2024-01-12", 1)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert recent.count() == 2 and "day" not in recent.columns


@pytest.mark.parametrize(
    "name, time, option, read", [("user_visit", "session_start", "visit_day", "visits_since"), ("banner_click", "created", "click_day", "clicks_since")]
)
def test_visits_and_clicks_by_day_are_pruned(spark, tmp_path, name, time, option, read):
    days = F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2024-01-10").cast("timestamp"))
    made = spark.range(3).select(*[
        (days if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields
    ])
    made.withColumn("day", F.to_date(time)).write.partitionBy("day").parquet(str(tmp_path / name))
    made.write.parquet(str(tmp_path / "plain" / name))
    tables = Tables.from_parquet(spark, str(tmp_path), names=[name], **{option: "day"})
    recent = getattr(tables, read)("2024-01-12", 1)
    assert "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().executedPlan().toString()
    assert recent.count() == 2 and "day" not in recent.columns
    plain = getattr(Tables.from_parquet(spark, str(tmp_path / "plain"), names=[name]), read)("2024-01-12", 1)
    assert sorted(plain.collect()) == sorted(recent.collect())
