"""Base tables, from parquet folders or a database."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.functions.times import AsOf, since
from wayfare.sources.days import DayTables
from wayfare.sources.schemas import TABLES

# Image sizes come from files, not from the database.
DATABASE_TABLES = tuple(name for name in TABLES if name != "assets")


@dataclass(frozen=True)
class Tables:
    """The tables the reports read. A report touches only those it needs.

    With ``days``, the journey reports read the tables stored by day and no events.
    """

    user_event: DataFrame | None = None
    user: DataFrame | None = None
    user_visit: DataFrame | None = None
    offer: DataFrame | None = None
    banner: DataFrame | None = None
    banner_click: DataFrame | None = None
    postback: DataFrame | None = None
    assets: DataFrame | None = None
    event_day: str | None = None
    days: DayTables | None = None
    visit_day: str | None = None
    click_day: str | None = None

    def events_since(self, as_of: AsOf, days: int) -> DataFrame:
        """Events of the last ``days`` and today; a named day column prunes folders."""
        return _since(self.user_event, "created", self.event_day, as_of, days)

    def visits_since(self, as_of: AsOf, days: int) -> DataFrame:
        """Visits that started in the last ``days`` or today, pruned in the same way."""
        return _since(self.user_visit, "session_start", self.visit_day, as_of, days)

    def clicks_since(self, as_of: AsOf, days: int) -> DataFrame:
        """Banner clicks of the last ``days`` and today, pruned in the same way."""
        return _since(self.banner_click, "created", self.click_day, as_of, days)

    @classmethod
    def from_parquet(
        cls,
        spark: SparkSession,
        root: str,
        names: Sequence[str] = tuple(TABLES),
        event_day: str | None = None,
        visit_day: str | None = None,
        click_day: str | None = None,
    ) -> Tables:
        """One parquet folder per table under ``root``.

        ``event_day`` names the date column that events are partitioned by, if
        they are: the calendar date of ``created``. ``click_day`` does so for banner
        clicks, and ``visit_day`` for visits: the calendar date of ``session_start``.
        """
        schemas = {name: T.StructType(list(TABLES[name].fields)) for name in names}
        for name, day in (("user_event", event_day), ("user_visit", visit_day), ("banner_click", click_day)):
            if day is not None and name in schemas:
                schemas[name].add(day, T.DateType())
        read = {name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in schemas.items()}
        return cls(**read, event_day=event_day, visit_day=visit_day, click_day=click_day)

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        connection: Mapping[str, str],
        splits: Mapping[str, Mapping[str, str]] | None = None,
        names: Sequence[str] = DATABASE_TABLES,
    ) -> Tables:
        """One database table each; ``splits`` names the read ranges of big ones.

        ``connection`` holds Spark's JDBC options (url, user, driver, ...).
        ``splits["user_event"]`` holds partitionColumn, lowerBound, upperBound
        and numPartitions, so that the table is read by many tasks.
        """
        loaded = {}
        for name in names:
            options = jdbc_options(connection, table=f'"{name}"', split=(splits or {}).get(name))
            loaded[name] = conform(spark.read.format("jdbc").options(**options).load(), TABLES[name])
        return cls(**loaded)


def _since(rows: DataFrame, time: str, day: str | None, as_of: AsOf, days: int) -> DataFrame:
    recent = rows.filter(since(time, as_of, days))
    return recent if day is None else recent.filter(since(day, as_of, days)).drop(day)


def jdbc_options(
    connection: Mapping[str, str],
    *,
    table: str | None = None,
    query: str | None = None,
    split: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of a JDBC read of one table or one SQL query."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    # Spark takes read ranges only together with dbtable.
    source = table if table is not None else f"({query}) AS source_query"
    ranges = dict(split or {})
    needed = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
    if ranges and set(ranges) != needed:
        raise ValueError(f"a split needs exactly {sorted(needed)}")
    return {"preferTimestampNTZ": "true", "fetchsize": "10000", **connection, "dbtable": source, **ranges}


def read_query(
    spark: SparkSession, connection: Mapping[str, str], query: str, split: Mapping[str, str] | None = None
) -> DataFrame:
    """Result of a SQL query run by the database, as a DataFrame."""
    return spark.read.format("jdbc").options(**jdbc_options(connection, query=query, split=split)).load()


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema`` and cast them to its types."""
    return df.select(*[F.col(field.name).cast(field.dataType) for field in schema.fields])
