"""Small tables for tests; columns left out are NULL."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from wayfare.sources.schemas import TABLES
from wayfare.sources.tables import Tables

SITE = "https://app.example.com"
START = dt.datetime(2024, 1, 10, 12, 0, 0)


def at(seconds: float = 0, days: int = 0) -> dt.datetime:
    return START + dt.timedelta(days=days, seconds=seconds)


def frame(spark, table: str, rows: list[dict]):
    schema = TABLES[table]
    return spark.createDataFrame([tuple(row.get(name) for name in schema.names) for row in rows], schema)


def tables(spark, **rows: list[dict]) -> Tables:
    return Tables(**{name: frame(spark, name, rows.get(name, [])) for name in TABLES})


def event(id: int, created: dt.datetime, event: str = "route", page: str | None = None, **more) -> dict:
    return {"id": id, "user_id": 1, "created": created, "event": event, "page": page, "user_visit_id": "v1", **more}


def user(id: int = 1, **more) -> dict:
    return {
        "id": id,
        "created": START,
        "device": "mobile",
        "os": "iOS",
        "device_vendor": "A",
        "user_info": "{}",
        "conversion_funnel_id": 8,
        "user_source": "src",
        **more,
    }


def visit(id: str = "v1", user_id: int = 1, start: dt.datetime | None = START) -> dict:
    return {"id": id, "user_id": user_id, "session_start": start}


def money(text: str) -> Decimal:
    return Decimal(text)
