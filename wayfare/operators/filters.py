"""Session filters the analyses start from. A missing figure fails a filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The funnels under study, seconds in product that count as
# engaged, and the number of sessions looked at per user.
STUDIED_FUNNELS = (1, 8)
MAIN_FUNNEL = 8
ENGAGED_SECONDS = 9
SESSION_CAP = 5


def converted(funnels: Sequence[int] = STUDIED_FUNNELS, max_session: int | None = None) -> Column:
    """Engaged sessions with a redirect to an offer, in the given funnels."""
    kept = _engaged() & (F.col("redirected") > 0) & F.col("funnel_id").isin(*funnels)
    return kept if max_session is None else kept & (F.col("session_number") <= max_session)


def redirected(funnels: Sequence[int] = STUDIED_FUNNELS) -> Column:
    """Sessions with a redirect to an offer, in the given funnels, however long they were."""
    return (F.col("redirected") > 0) & F.col("funnel_id").isin(*funnels)


def not_converted(funnels: Sequence[int] | None = None, max_session: int | None = None) -> Column:
    """Engaged sessions without any click or redirect."""
    kept = _engaged() & (F.col("redirected") == 0) & (F.col("banner_clicks") == 0) & (F.col("attr_clicks") == 0)
    if funnels is not None:
        kept = kept & F.col("funnel_id").isin(*funnels)
    return kept if max_session is None else kept & (F.col("session_number") <= max_session)


def fill_missing(sessions: DataFrame) -> DataFrame:
    """Missing figures become 0 and missing texts ``'0'``."""
    texts = [name for name, kind in sessions.dtypes if kind == "string"]
    return sessions.na.fill(0).na.fill("0", texts)


def _engaged() -> Column:
    return F.col("product_time") > ENGAGED_SECONDS
