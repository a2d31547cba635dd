from __future__ import annotations

import pytest

from wayfare.operators import feedback
from wayfare.plans.feedback import feedback_report

LEXICON = [("good", "0.70"), ("fine", "0.30"), ("bad", "-0.70")]


def _lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, polarity string").selectExpr(
        "word", "cast(polarity as decimal(4,2)) as polarity"
    )


@pytest.mark.parametrize(
    ("text", "score"),
    [
        ("Good, good! FINE", (0.7 + 0.7 + 0.3) / 3),
        ("good and bad", 0.0),
        ("nothing known", 0.0),
        ("", 0.0),
        (None, None),
        ("goods", 0.0),
    ],
)
def test_polarity(spark, text, score):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    found = feedback.polarity(df, _lexicon(spark), ["id"]).first()["polarity"]
    assert found == pytest.approx(score) if score is not None else found is None


def test_labels(spark):
    scores = [(0.6, "very good"), (0.5, "good"), (0.0, "normal"), (-0.7, "bad"), (-0.1, "bad"), (None, "normal")]
    df = spark.createDataFrame(scores, "polarity double, expected string")
    assert all(r["sentiment_label"] == r["expected"] for r in feedback.labelled(df).collect())


def _scores(spark, very_good=0, good=0, normal=0, bad=0, missing=0):
    sizes = [(0.9, very_good), (0.3, good), (0.0, normal), (-0.3, bad), (None, missing)]
    return spark.createDataFrame([(s,) for s, n in sizes for _ in range(n)], "polarity double")


def _relabelled(spark, **sizes) -> dict:
    rows = feedback.recalibrated(_scores(spark, **sizes)).distinct().collect()
    return {r["polarity"]: r["sentiment_label"] for r in rows}


def test_recalibration_moves_each_condition_once(spark):
    assert _relabelled(spark, very_good=1, good=10, normal=5, bad=1) == {
        0.9: "good",
        0.3: "good",
        0.0: "bad",
        -0.3: "hate",
    }


def test_recalibration_keeps_big_labels(spark):
    assert _relabelled(spark, very_good=2, good=3, normal=10, bad=2) == {
        0.9: "very good",
        0.3: "good",
        0.0: "normal",
        -0.3: "bad",
    }


def test_missing_scores_stay_normal(spark):
    assert _relabelled(spark, good=10, normal=1, missing=1) == {0.3: "good", 0.0: "bad", None: "normal"}


def test_label_counts(spark):
    counts = feedback.label_counts(feedback.labelled(_scores(spark, good=2, bad=3, normal=2)))
    assert [tuple(r) for r in counts.collect()] == [("bad", 3), ("good", 2), ("normal", 2)]


def test_report_keeps_equal_and_missing_texts(spark):
    texts = ["good"] * 3 + ["fine"] * 20 + [None, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = feedback_report(df, _lexicon(spark)).collect()
    assert sorted(str(r["text"]) for r in rows) == sorted(map(str, texts))
    assert {(r["text"], r["polarity"], r["sentiment_label"]) for r in rows} == {
        ("good", 0.7, "very good"),
        ("fine", 0.3, "good"),
        ("", 0.0, "bad"),
        (None, None, "normal"),
    }
