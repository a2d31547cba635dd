"""The same analysis inputs taken from journey strings (CSV exports)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.pages import journey_length, tokens
from wayfare.operators.keys import SESSION


def summary_from_journeys(journeys: DataFrame) -> DataFrame:
    """Add ``journey_len, first_page, second_page, last_page`` to a journey frame.

    NULL and blank strings are both an empty journey: length 0, no pages.
    """
    pages = tokens(_text())
    return journeys.withColumns(
        {
            "journey_len": F.coalesce(journey_length(_text()), F.lit(0)).cast("bigint"),
            "first_page": F.element_at(pages, 1),
            "second_page": F.try_element_at(pages, F.lit(2)),
            "last_page": F.element_at(pages, -1),
        }
    )


def pages_from_journeys(journeys: DataFrame) -> DataFrame:
    """``user_id, session_number, page, visits`` rows; empty journeys give none."""
    return journeys.select(*SESSION, F.explode(tokens(_text())).alias("page"), F.lit(1).cast("bigint").alias("visits"))


def items_from_journeys(journeys: DataFrame, mode: str = "truncate") -> DataFrame:
    """Add the page set ``items`` of each journey.

    ``truncate`` cuts the whole string at its first ``[`` and drops later
    pages; ``per_page`` strips the bracket of every page instead.
    """
    text = F.coalesce(_text(), F.lit(""))
    if mode == "truncate":
        pages = tokens(F.trim(F.split_part(text, F.lit("["), F.lit(1))))
    elif mode == "per_page":
        pages = F.transform(tokens(text), lambda page: F.trim(F.split_part(page, F.lit("["), F.lit(1))))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return journeys.withColumn("items", F.array_sort(F.array_distinct(pages)))


def _text() -> Column:
    return F.nullif(F.col("journey_pages"), F.lit(""))
