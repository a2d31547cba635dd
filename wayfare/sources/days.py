"""Partial figures stored by day, and what they were made with.

One folder per part below the root, partitioned by ``day``, the date of the events:

``visits``    figures per user and visit that merge: sums, minima and maxima
``offers``    distinct offers a visit led to
``pages``     page texts per visit: how often, and when first
``steps``     sorted events per visit and time slice that can name a page
``presence``  first and last event and time spent per user and slice, soon after signup
``infos``     all events per visit and slice, for the detailed journey; on request

A report reads the partitions of its days and no others. Every day that was written has
a row without user in each part, so that a day without events is known to be empty.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.references import CHAT_LIMIT
from wayfare.functions.times import SLICE_SECONDS, AsOf, since

_VISIT = "user_id bigint, visit_id string"
_STEP = "struct<created:timestamp_ntz,id:bigint,page_text:string>"
SCHEMAS = {
    "visits": f"{_VISIT}, pages bigint, chars bigint, commas bigint, offer_id int, banner_clicks bigint, attr_clicks bigint,"
    f" redirected bigint, head {_STEP}, tail {_STEP}, anchor_time timestamp_ntz",
    "offers": f"{_VISIT}, offer_id int",
    "pages": f"{_VISIT}, page_text string, visits bigint, seen struct<created:timestamp_ntz,id:bigint>",
    "steps": f"{_VISIT}, slice bigint, steps array<struct<created:timestamp_ntz,id:bigint,event:string,page_name:string>>",
    "presence": "user_id bigint, slice bigint, first_created timestamp_ntz, last_created timestamp_ntz, spent interval day to second",
    "infos": f"{_VISIT}, slice bigint, infos array<struct<created:timestamp_ntz,id:bigint,event:string,page_name:string>>",
}


@dataclass(frozen=True)
class DaySettings:
    """What the stored figures depend on; a report must ask for the same."""

    page_rule: str = "bracketed"
    horizon_hours: int = 24
    gap_cap_seconds: int = 900
    slice_seconds: int = SLICE_SECONDS
    anchor_event: str = CHAT_LIMIT

    def __post_init__(self) -> None:
        if 86400 % self.slice_seconds:
            raise ValueError("slices must divide a day, or two days would share one")


@dataclass(frozen=True)
class DayTables:
    """The parts below ``root``."""

    spark: SparkSession
    root: str
    settings: DaySettings = DaySettings()

    def path(self, part: str) -> str:
        return f"{self.root}/{part}"

    def read(self, part: str, as_of: AsOf, days: int) -> DataFrame:
        """Rows of the last ``days`` days and all later ones."""
        stored = self.spark.read.schema(f"{SCHEMAS[part]}, day date").parquet(self.path(part))
        return stored.filter(since("day", as_of, days) & F.col("user_id").isNotNull()).drop("day")

    def written(self) -> DataFrame:
        """``day`` of every day that was written, with or without events."""
        return self.spark.read.schema(f"{SCHEMAS['visits']}, day date").parquet(self.path("visits")).select("day").distinct()

    def check(self, options, anchor_event: str | None = None) -> None:
        """Raise where a report needs figures other than the stored ones."""
        for name, stored in asdict(self.settings).items():
            asked = anchor_event or stored if name == "anchor_event" else getattr(options, name)
            if asked != stored:
                raise ValueError(f"stored by day with {name}={stored!r}, but the report asks for {asked!r}")
