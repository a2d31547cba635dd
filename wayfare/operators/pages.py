"""Counts of pages over sessions.

Inputs are the session summary (``first_page, second_page, last_page,
journey_len``) and the page rows ``user_id, session_number, page, visits``.
Both come from events (``operators.journeys``) or from journey strings
(``operators.exports``). Sessions that carry their pages (``shown``) need no
page rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.pages import general_page, tokens
from wayfare.operators.keys import SESSION

# How the analyses spell the journey of a session without pages.
TOKEN_AS_NULL = "Null"
TOKEN_AS_ZERO = "0"
TOKEN_AS_NAN = "nan"


def second_page_counts(sessions: DataFrame) -> DataFrame:
    """Sessions per funnel, session and second page.

    Counts journeys of more than one page that end on another page than they
    start on. Page ids are dropped from the second page. The session number is
    text, and sorts as text.
    """
    kept = sessions.filter(
        (F.col("journey_len") != 1)
        & (F.col("first_page") != F.col("last_page"))
        & F.col("redirected").try_cast("int").isNotNull()
    )
    return _step_counts(kept, general_page("second_page"))


def last_page_counts(sessions: DataFrame) -> DataFrame:
    """Sessions per funnel, session and last page, ids dropped.

    One-page journeys count; longer ones only when they end elsewhere than
    they start. A session without pages counts as page ``nan``.
    """
    empty = F.col("journey_len") == 0
    kept = sessions.filter(empty | (F.col("journey_len") == 1) | (F.col("first_page") != F.col("last_page")))
    return _step_counts(kept, F.when(empty, F.lit(TOKEN_AS_NAN)).otherwise(general_page("last_page")))


def ending_counts(sessions: DataFrame, ending: str = "chats[") -> DataFrame:
    """Sessions per funnel, session and last page, where that page contains ``ending``."""
    kept = sessions.filter(F.col("last_page").contains(ending))
    return _step_counts(kept, general_page("last_page"))


def page_visits(sessions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``page, visits`` over the given sessions, ids dropped, most visited first.

    A session without pages adds nothing.
    """
    return most_visited(_counted(_pages_of(sessions, pages), F.trim(general_page("page"))))


def popular_interactions(sessions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``page, visits`` over the given sessions, ids kept, most visited first.

    A session without pages counts once, as page ``Null``.
    """
    return most_visited(_counted(_tokens_of(sessions, pages, TOKEN_AS_NULL), F.col("page")))


def all_pages(sessions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Distinct pages of the given sessions, with and without ids."""
    raw = _tokens_of(sessions, pages, TOKEN_AS_ZERO)
    return raw.select(F.explode(F.array("page", general_page("page"))).alias("page")).distinct()


def average_page_per_user(sessions: DataFrame, pages: DataFrame | None = None, page: str = "browse") -> DataFrame:
    """One row: visits of a page in the given sessions over their distinct users."""
    if pages is None:
        wanted = F.filter(_shown_tokens(), lambda t: t["page"] == page)
        visits = F.aggregate(wanted, F.lit(0).cast("bigint"), lambda n, t: n + t["visits"])
        each = sessions.select("user_id", F.when(F.col("journey_len") > 0, visits).alias("seen"))
        counted = each.agg(F.sum("seen").alias("seen"), F.count_distinct("user_id").alias("users"))
        mean = F.coalesce("seen", F.lit(0)) / F.nullif(F.col("users"), F.lit(0))
        return counted.select(mean.alias("average_visits"))
    seen = _pages_of(sessions, pages.filter(F.col("page") == page)).agg(F.sum("visits").alias("seen"))
    users = sessions.agg(F.count_distinct("user_id").alias("users"))
    mean = F.coalesce(seen.scalar(), F.lit(0)) / F.nullif(F.col("users"), F.lit(0))
    return users.select(mean.alias("average_visits"))


def most_visited(counts: DataFrame, top: int | None = None) -> DataFrame:
    """Most visited first, equal counts by name; ``top`` keeps the head."""
    ordered = counts.orderBy(F.col("visits").desc(), F.col("page").asc())
    return ordered if top is None else ordered.limit(top)


def _counted(pages: DataFrame, page: Column) -> DataFrame:
    return pages.groupBy(page.alias("page")).agg(F.sum("visits").alias("visits"))


def _pages_of(sessions: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Page rows of the sessions that have a journey."""
    if pages is None:
        return sessions.filter(F.col("journey_len") > 0).select(F.explode(_shown_tokens()).alias("t")).select("t.*")
    kept = sessions.filter(F.col("journey_len") > 0).select(*SESSION)
    return pages.join(kept, SESSION, "left_semi")


def _shown_tokens() -> Column:
    """The tokens of the pages that a session shows, with how often it shows them."""
    return F.flatten(
        F.transform(
            "shown",
            lambda s: F.transform(tokens(s["page_text"]), lambda t: F.struct(t.alias("page"), s["visits"].alias("visits"))),
        )
    )


def _tokens_of(sessions: DataFrame, pages: DataFrame | None, empty_token: str) -> DataFrame:
    """Page rows of the sessions, empty journeys spelled ``empty_token``."""
    if pages is None:
        blank = F.array(F.struct(F.lit(empty_token).alias("page"), F.lit(1).cast("bigint").alias("visits")))
        spelled = F.when(F.col("journey_len") == 0, blank).otherwise(_shown_tokens())
        return sessions.select(F.explode(spelled).alias("t")).select("t.*")
    empty = sessions.filter(F.col("journey_len") == 0).select(
        F.lit(empty_token).alias("page"), F.lit(1).cast("bigint").alias("visits")
    )
    return _pages_of(sessions, pages).select("page", "visits").unionByName(empty)


def _step_counts(sessions: DataFrame, page: Column) -> DataFrame:
    counts = sessions.groupBy(
        "funnel_id", F.col("session_number").cast("string").alias("session"), page.alias("page_name")
    ).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(
        F.col("funnel_id").asc_nulls_last(), F.col("session").asc(), F.col("count").desc(), F.col("page_name").asc()
    )
