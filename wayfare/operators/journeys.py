"""Sessions rolled up from events: counts, end pages, and journey strings.

Two roll-ups give the same figures:

``session_measures``  fixed-size figures only. Events are aggregated per
    (user, visit) before they meet a session number, so raw events are
    shuffled once, after map-side aggregation, and no page list is built.

``session_texts``  also the ordered journey string, which is one cell per
    session by definition. The string is put together in two steps: sorted
    pieces per (session, time slice), then pieces in slice order. No task
    sorts more than one slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.functions.pages import general_page, journey_text, occurrences, page_name, tokens
from wayfare.functions.references import (
    OFFER_REDIRECT,
    PAGE_EVENTS,
    banner_ref,
    is_attribute_click,
    is_banner_click,
    offer_ref,
    screen_size,
    visit_key,
)
from wayfare.functions.times import SLICE_SECONDS, VISIT_SLICE_SECONDS, AsOf, slice_of
from wayfare.operators.gaps import early_events, joined_presence, product_time
from wayfare.operators.keys import SESSION, VISIT
from wayfare.operators.slices import with_slices
from wayfare.operators.visits import known_visits, number_visits
from wayfare.sources.tables import Tables


@dataclass(frozen=True)
class JourneyOptions:
    """What differs between journey reports."""

    page_rule: str = "bracketed"
    as_of: AsOf = None
    lookback_days: int = 7
    filter_visits: bool = True
    max_session: int | None = None
    gap_cap_seconds: int = 900
    horizon_hours: int = 24
    device: str = "mobile"
    slice_seconds: int = SLICE_SECONDS
    visit_slice_seconds: int = VISIT_SLICE_SECONDS


def recent_events(tables: Tables, options: JourneyOptions) -> DataFrame:
    return tables.events_since(options.as_of, options.lookback_days)


def numbered_visits(tables: Tables, options: JourneyOptions, with_category: bool = False) -> DataFrame:
    """``user_id, visit_id, session_number, offer_category_id`` of the visits a report covers.

    The category is the largest among the offers a visit led to; it is NULL
    throughout unless asked for.
    """
    recent = options.filter_visits
    visits = tables.visits_since(options.as_of, options.lookback_days) if recent else tables.user_visit
    active = known_visits(visit_pairs(tables, options), tables.user, visits)
    # Categories join before the numbering, not after it: event rows join the
    # result by visit, and Spark can split a busy visit only in a join whose
    # sides come straight from a shuffle.
    if with_category:
        active = active.join(visit_categories(tables, options), VISIT, "left")
    else:
        active = active.withColumn("offer_category_id", F.lit(None).cast("int"))
    return number_visits(active, options.max_session, options.visit_slice_seconds)


def visit_pairs(tables: Tables, options: JourneyOptions) -> DataFrame:
    """Distinct (user, visit) pairs of the recent events."""
    if tables.days is not None:
        return _stored(tables, options, "visits").select(*VISIT).distinct()
    return recent_events(tables, options).select("user_id", visit_key("user_visit_id").alias("visit_id")).distinct()


def _stored(tables: Tables, options: JourneyOptions, part: str) -> DataFrame:
    """One of the tables by day, for the days of a report."""
    tables.days.check(options)
    return tables.days.read(part, options.as_of, options.lookback_days)


def visit_categories(tables: Tables, options: JourneyOptions) -> DataFrame:
    """Largest offer category per (user, visit).

    Offers are looked up for the distinct offers of a visit, so the event rows,
    most of which lead to no offer, never join on an offer id.
    """
    if tables.days is not None:
        led = _stored(tables, options, "offers").select(*VISIT, "offer_id").distinct()
    else:
        led = (
            recent_events(tables, options)
            .filter(F.col("event") == OFFER_REDIRECT)
            .select("user_id", visit_key("user_visit_id").alias("visit_id"), offer_ref().alias("offer_id"))
            .distinct()
        )
    offers = tables.offer.select(F.col("id").alias("offer_id"), "offer_category_id")
    return led.join(offers, "offer_id").groupBy(*VISIT).agg(F.max("offer_category_id").alias("offer_category_id"))


def journey_events(tables: Tables, options: JourneyOptions) -> DataFrame:
    """One narrow row per recent event, with page name and references resolved.

    Clicks and redirects become flags where the event is read, so the shuffles
    after it do not carry the texts they come from.
    """
    return journey_rows(recent_events(tables, options), options.page_rule)


def journey_rows(events: DataFrame, page_rule: str) -> DataFrame:
    """The same of the given events."""
    rows = events.select(
        "user_id",
        visit_key("user_visit_id").alias("visit_id"),
        "created",
        "id",
        "event",
        page_name(page_rule).alias("page_name"),
        is_banner_click("event", banner_ref()).alias("on_banner"),
        is_attribute_click("event", banner_ref()).alias("on_attribute"),
        (F.col("event") == OFFER_REDIRECT).alias("to_offer"),
        offer_ref().alias("offer_id"),
    )
    return rows.withColumn("page_text", journey_text("page_name"))


def session_measures(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """Figures per session, without journey strings."""
    return merged_measures(visit_figures(rows), numbered)


def visit_figures(rows: DataFrame, also: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """Figures that merge, per user and visit (and the keys ``also``), and ``more`` aggregates."""
    return rows.groupBy(*also, *VISIT).agg(*_row_figures(), *more)


def merged_measures(figures: DataFrame, numbered: DataFrame) -> DataFrame:
    """Figures per session from any number of partial figures per visit."""
    return _finish(figures.join(numbered, VISIT).groupBy(*SESSION).agg(*_merged_figures()))


def visit_folds(rows: DataFrame) -> DataFrame:
    """Per user and visit the figures that merge, and ``shown``: its distinct page texts, how often and when first.

    Both come from one pass over the events, which are counted per page text first.
    """
    seen = F.min(F.struct("created", "id")).alias("seen")
    per_page = rows.groupBy(*VISIT, "page_text").agg(*_row_figures(), seen)
    shown = F.when(_paged(), F.struct("page_text", F.col("pages").alias("visits"), "seen"))
    return per_page.groupBy(*VISIT).agg(*_merges(), F.collect_list(shown).alias("shown"))


def session_folds(folds: DataFrame, numbered: DataFrame) -> DataFrame:
    """Figures per session, with the pages it shows."""
    shown = F.flatten(F.collect_list("shown")).alias("shown")
    return _finish(folds.join(numbered, VISIT).groupBy(*SESSION).agg(*_merged_figures(), shown), ["shown"])


def recent_session_folds(tables: Tables, options: JourneyOptions, numbered: DataFrame) -> DataFrame:
    """``session_folds`` of the recent events, or the same from the tables by day."""
    if tables.days is None:
        return session_folds(visit_folds(journey_events(tables, options)), numbered)
    measures = merged_measures(recent_figures(tables, options), numbered)
    shown = F.collect_list(F.struct("page_text", "visits", "seen")).alias("shown")
    pages = _stored(tables, options, "pages").join(numbered, VISIT).groupBy(*SESSION).agg(shown)
    none = F.array().cast(pages.schema["shown"].dataType)
    return measures.join(pages, SESSION, "left").withColumn("shown", F.coalesce("shown", none))


def recent_figures(tables: Tables, options: JourneyOptions) -> DataFrame:
    """Partial figures per visit: those stored by day, or one row a visit from events."""
    if tables.days is not None:
        return _stored(tables, options, "visits")
    return visit_figures(journey_events(tables, options))


def session_texts(
    rows: DataFrame, numbered: DataFrame, with_page_info: bool = False, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Figures per session plus ``journey_pages`` (and ``page_info_array``)."""
    return roll_up_texts(rows.join(numbered, VISIT), with_page_info, slice_seconds)


def roll_up_texts(rows: DataFrame, with_page_info: bool = False, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """As ``session_texts``, for rows that carry their session number."""
    step = F.when(_paged(), F.struct("created", "id", "page_text"))
    partial = [*_row_figures(), _category(), _ordered(step).alias("steps")]
    if with_page_info:
        partial.append(_ordered(F.struct("created", "id", "event", "page_name")).alias("infos"))
    sliced = rows.groupBy(*SESSION, slice_of("created", slice_seconds).alias("slice")).agg(*partial)
    piece = F.array_join(F.transform("steps", lambda step: step["page_text"]), ",")
    sliced = sliced.withColumn("piece", F.when(F.size("steps") > 0, F.struct("slice", piece.alias("text"))))

    whole = [
        *_merged_figures(),
        F.array_join(F.transform(_ordered(F.col("piece")), lambda part: part["text"]), ",").alias("journey_pages"),
    ]
    if with_page_info:
        whole.append(_page_info())
    kept = ["journey_pages", "page_info_array"] if with_page_info else ["journey_pages"]
    return _finish(sliced.groupBy(*SESSION).agg(*whole), kept)


def recent_texts(tables: Tables, options: JourneyOptions, numbered: DataFrame, with_page_info: bool = False) -> DataFrame:
    """``session_texts`` of the recent events, or the same from the tables by day."""
    if tables.days is None:
        return session_texts(journey_events(tables, options), numbered, with_page_info, options.slice_seconds)
    measures = merged_measures(recent_figures(tables, options), numbered)
    named = F.filter("steps", lambda step: step["page_name"].isNotNull())
    pieces = _merged_slices(_stored(tables, options, "steps").withColumn("steps", named), numbered, "steps")
    text = F.array_join(F.transform("steps", lambda step: journey_text(step["page_name"])), ",")
    pieces = pieces.select(*SESSION, F.when(F.size("steps") > 0, F.struct("slice", text.alias("text"))).alias("piece"))
    texts = pieces.groupBy(*SESSION).agg(
        F.array_join(F.transform(_ordered(F.col("piece")), lambda part: part["text"]), ",").alias("journey_pages")
    )
    found = measures.join(texts, SESSION, "left").withColumn("journey_pages", F.coalesce("journey_pages", F.lit("")))
    if with_page_info:
        infos = _merged_slices(_stored(tables, options, "infos"), numbered, "infos")
        found = found.join(infos.groupBy(*SESSION).agg(_page_info()), SESSION, "left")
    return found


def _merged_slices(stored: DataFrame, numbered: DataFrame, name: str) -> DataFrame:
    """Sorted arrays per (session, slice) from those per (visit, slice)."""
    merged = F.sort_array(F.flatten(F.collect_list(name)))
    return stored.join(numbered, VISIT).groupBy(*SESSION, "slice").agg(merged.alias(name))


def _page_info() -> Column:
    infos = F.flatten(F.transform(_ordered(F.struct("slice", "infos")), lambda part: part["infos"]))
    return F.transform(
        infos,
        lambda info: F.struct(
            info["event"].alias("event"),
            info["page_name"].alias("page_name"),
            F.to_date(info["created"]).alias("created_date"),
        ),
    ).alias("page_info_array")


def slice_steps(rows: DataFrame, value: Column, name: str, slice_seconds: int) -> DataFrame:
    """``day, user_id, visit_id, slice`` and the sorted array ``name`` of ``value`` for stored days."""
    return rows.groupBy("day", *VISIT, slice_of("created", slice_seconds).alias("slice")).agg(_ordered(value).alias(name))


def user_profile(users: DataFrame) -> DataFrame:
    return users.select(
        F.col("id").alias("user_id"),
        "os",
        "device_vendor",
        F.col("conversion_funnel_id").alias("funnel_id"),
        "user_source",
        screen_size().alias("screen_size"),
    )


def with_users(sessions: DataFrame, tables: Tables, options: JourneyOptions | None = None) -> DataFrame:
    """Add user attributes and, when options are given, the user's product time.

    Both are constant per user, so they repeat on each of the user's sessions
    and meet the sessions in one join.
    """
    profile = user_profile(tables.user)
    if options is not None:
        profile = profile.join(user_product_time(tables, options), "user_id", "left")
    return sessions.join(profile, "user_id")


def user_product_time(tables: Tables, options: JourneyOptions) -> DataFrame:
    if tables.days is not None:
        devices = tables.user.filter(F.col("device") == options.device).select(F.col("id").alias("user_id"))
        slices = _stored(tables, options, "presence").join(devices, "user_id", "left_semi")
        return joined_presence(slices, options.gap_cap_seconds)
    events = early_events(
        tables.events_since(options.as_of, options.lookback_days),
        tables.user,
        as_of=options.as_of,
        lookback_days=options.lookback_days,
        horizon_hours=options.horizon_hours,
        device=options.device,
    )
    return product_time(events, options.gap_cap_seconds, options.slice_seconds)


def session_summary(tables: Tables, options: JourneyOptions, with_category: bool = True) -> DataFrame:
    """One fixed-size row per session, the input of the analyses.

    Has every column of a journey report but the journey string, and in its
    place ``first_page`` and ``last_page``. Unused columns are pruned.
    """
    numbered = numbered_visits(tables, options, with_category)
    return with_users(merged_measures(recent_figures(tables, options), numbered), tables, options)


def page_events(rows: DataFrame) -> DataFrame:
    """Rows that can name a page.

    A test on the event is cheap and reaches the scan. Which of them do name
    one is tested on aggregates and window results only, so that no row's name
    is worked out a second time for a filter.
    """
    return rows.filter(F.col("event").isin(*PAGE_EVENTS))


def page_counts(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """``user_id, session_number, page, visits``: how often a session shows a page.

    A page may repeat over rows; pages are raw journey tokens.
    """
    return counted_pages(visit_pages(rows), numbered)


def visit_pages(rows: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """How often a visit shows a page text, and when first, as figures that merge."""
    return (
        page_events(rows)
        .groupBy(*also, *VISIT, "page_text")
        .agg(F.count("page_text").alias("visits"), F.min(F.struct("created", "id")).alias("seen"))
        .filter(F.col("visits") > 0)
    )


def counted_pages(pages: DataFrame, numbered: DataFrame) -> DataFrame:
    """As ``page_counts``, from the rows of ``visit_pages``."""
    return pages.join(numbered, VISIT).select(*SESSION, F.explode(tokens("page_text")).alias("page"), "visits")


def recent_page_rows(tables: Tables, options: JourneyOptions) -> DataFrame:
    """``journey_events`` of the events that can name a page; from the stored steps where there are any."""
    if tables.days is None:
        return page_events(journey_events(tables, options))
    steps = _stored(tables, options, "steps").select(*VISIT, F.explode("steps").alias("step")).select(*VISIT, "step.*")
    flags = [F.lit(False).alias(name) for name in ("on_banner", "on_attribute", "to_offer")]
    no_offer = F.lit(None).cast("int").alias("offer_id")
    return steps.select("*", journey_text("page_name").alias("page_text"), *flags, no_offer)


def second_pages(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """``user_id, session_number, second_page`` of sessions with two tokens or more."""
    by_time = [F.col("page_text").isNull(), F.col("created"), F.col("id")]
    # Two rows per visit hold the first two of the session. Spark cuts to them
    # before the shuffle, so long visits shrink where they are read.
    in_visit = W.partitionBy("user_id", "visit_id").orderBy(*by_time)
    heads = (
        page_events(rows)
        .select("user_id", "visit_id", "created", "id", "page_text")
        .withColumn("place", F.row_number().over(in_visit))
        .filter(F.col("place") <= 2)
    )
    in_session = W.partitionBy(*SESSION).orderBy(*by_time)
    heads = (
        heads.join(numbered, VISIT)
        .withColumn("place", F.row_number().over(in_session))
        .filter(F.col("place") <= 2)
    )
    texts = heads.groupBy(*SESSION).agg(
        F.max(F.when(F.col("place") == 1, F.col("page_text"))).alias("one"),
        F.max(F.when(F.col("place") == 2, F.col("page_text"))).alias("two"),
    )
    second = F.try_element_at(tokens(F.concat_ws(",", "one", "two")), F.lit(2))
    return texts.select(*SESSION, second.alias("second_page")).filter(F.col("second_page").isNotNull())


def session_items(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """``user_id, session_number, items``: page set up to the first bracketed page, of sessions with pages."""
    sessions = session_folds(visit_folds(rows), numbered).filter(F.size("shown") > 0)
    return sessions.select(*SESSION, shown_items().alias("items"))


def shown_items(shown: str | Column = "shown") -> Column:
    """The distinct tokens of the journey string cut at its first ``[``, from the pages a session shows.

    Each page counts from its first time on, so this is a set of page names, not of events.
    """
    found = F.flatten(
        F.transform(
            shown,
            lambda s: F.transform(
                tokens(s["page_text"]),
                lambda token, place: F.struct(F.struct(s["seen"].alias("seen"), place.alias("place")).alias("at"), token.alias("token")),
            ),
        )
    )
    cut_at = F.array_min(F.transform(F.filter(found, lambda f: f["token"].contains("[")), lambda f: f["at"]))
    before_cut = F.filter(found, lambda f: cut_at.isNull() | (f["at"] <= cut_at))

    def item(token: Column) -> Column:
        # The cut token ends the string, so blanks before its bracket are trimmed.
        return F.when(token.contains("["), F.rtrim(general_page(token))).otherwise(token)

    # The string as a whole is stripped, so its first page loses blanks in front.
    in_order = F.array_sort(F.transform(before_cut, lambda f: F.struct(f["at"].alias("at"), item(f["token"]).alias("item"))))
    stripped = F.transform(in_order, lambda f, i: F.when(i == 0, F.ltrim(f["item"])).otherwise(f["item"]))
    return F.array_sort(F.array_distinct(stripped))


def ordered_steps(
    rows: DataFrame,
    keys: Sequence[str],
    page: str = "page_name",
    slice_seconds: int = SLICE_SECONDS,
    parts: int | None = None,
) -> DataFrame:
    """Pages in row form: ``keys..., position, page``, counted from 1.

    The row form of an ordered page array, without limit per key.
    """
    steps = page_events(rows).select(*keys, "created", "id", page)
    return _placed(steps, keys, F.col(page).isNotNull(), slice_seconds, parts).select(*keys, "position", page)


def ordered_events(
    rows: DataFrame, keys: Sequence[str], slice_seconds: int = SLICE_SECONDS, parts: int | None = None
) -> DataFrame:
    """All events in row form: ``keys..., position, event, page_name, created_date``, counted from 1.

    The row form of the array of all events, without limit per key.
    """
    events = rows.select(*keys, "created", "id", "event", "page_name")
    placed = _placed(events, keys, F.lit(True), slice_seconds, parts)
    return placed.select(*keys, "position", "event", "page_name", F.to_date("created").alias("created_date"))


def _placed(rows: DataFrame, keys: Sequence[str], counted: Column, slice_seconds: int, parts: int | None) -> DataFrame:
    """The ``counted`` rows with their ``position`` per key, by time and id.

    Positions are counts inside a time slice plus the counts of earlier slices of
    the same key; slices with many rows are cut by count.
    """
    sliced = with_slices(rows.withColumn("counted", counted), keys, slice_seconds, parts)
    earlier = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "slice")
        .agg(F.count_if("counted").alias("steps"))
        .select(*keys, "slice", F.coalesce(F.sum("steps").over(earlier), F.lit(0)).alias("before"))
    )
    inside = W.partitionBy(*keys, "slice").orderBy("created", "id").rowsBetween(W.unboundedPreceding, 0)
    places = sliced.withColumn("place", F.count_if("counted").over(inside)).filter("counted")
    return places.join(offsets, [*keys, "slice"]).withColumn("position", F.col("before") + F.col("place"))


def chunked_pages(steps: DataFrame, keys: Sequence[str], size: int, page: str = "page_name") -> DataFrame:
    """``keys..., chunk, pages, journey_pages``: a journey string in pieces of ``size`` pages, counted from 0.

    Joined by commas in order, the pieces are the whole string. No cell holds more
    than ``size`` pages, however long a journey is.
    """
    parts = F.transform(_ordered(F.struct("position", journey_text(page).alias("text"))), lambda step: step["text"])
    return _chunks(steps, keys, size).agg(F.count(F.lit(1)).alias("pages"), F.array_join(parts, ",").alias("journey_pages"))


def chunked_events(events: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """``keys..., chunk, page_info_array``: all events of a journey in arrays of ``size``, counted from 0."""
    infos = _ordered(F.struct("position", "event", "page_name", "created_date"))
    infos = F.transform(infos, lambda i: F.struct(*(i[name].alias(name) for name in ("event", "page_name", "created_date"))))
    return _chunks(events, keys, size).agg(infos.alias("page_info_array"))


def _chunks(placed: DataFrame, keys: Sequence[str], size: int) -> GroupedData:
    return placed.groupBy(*keys, F.floor((F.col("position") - 1) / F.lit(size)).alias("chunk"))


def visit_anchors(tables: Tables, options: JourneyOptions, anchor_event: str) -> DataFrame:
    """``user_id, visit_id, anchor_time`` of all active pairs: the first anchor event, NULL without one."""
    if tables.days is not None:
        tables.days.check(options, anchor_event)
        return _stored(tables, options, "visits").groupBy(*VISIT).agg(F.min("anchor_time").alias("anchor_time"))
    return (
        recent_events(tables, options)
        .groupBy("user_id", visit_key("user_visit_id").alias("visit_id"))
        .agg(F.min(F.when(F.col("event") == anchor_event, F.col("created"))).alias("anchor_time"))
    )


def anchored_visits(tables: Tables, options: JourneyOptions, anchor_event: str) -> DataFrame:
    """``user_id, visit_id, session_number, anchor_time`` of sessions with an anchor event.

    One fold per visit finds the pairs and their anchors, so visits are numbered
    once. A session has the first anchor of its visits.
    """
    recent = options.filter_visits
    visits = tables.visits_since(options.as_of, options.lookback_days) if recent else tables.user_visit
    active = known_visits(visit_anchors(tables, options, anchor_event), tables.user, visits)
    numbered = number_visits(active, options.max_session, options.visit_slice_seconds)
    first = F.min("anchor_time").over(W.partitionBy(*SESSION))
    return numbered.withColumn("anchor_time", first).filter(F.col("anchor_time").isNotNull())


def anchor_times(anchored: DataFrame) -> DataFrame:
    """``user_id, session_number, anchor_time``: first anchor event per session."""
    return anchored.groupBy(*SESSION).agg(F.min("anchor_time").alias("anchor_time"))


def rows_after_anchor(rows: DataFrame, anchored: DataFrame, kept_event: str) -> DataFrame:
    """Rows of one event type strictly after their session's first anchor."""
    after = rows.filter(F.col("event") == kept_event).join(anchored, VISIT)
    no_offer = F.lit(None).cast("int").alias("offer_category_id")
    return after.filter(F.col("created") > F.col("anchor_time")).select("*", no_offer)


def roll_up_measures(rows: DataFrame) -> DataFrame:
    """As ``session_measures``, for rows that carry their session number."""
    return _finish(rows.groupBy(*SESSION).agg(*_row_figures(), _category()))


def user_page_arrays(rows: DataFrame, users: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``user_id, journey_pages``: all non-NULL page names of the given users, in order.

    Users are looked up per slice, not per event. Spark moves the lookup in
    front of the aggregation when the users are few enough to broadcast.
    """
    step = F.when(F.col("page_name").isNotNull(), F.struct("created", "id", "page_name"))
    sliced = (
        page_events(rows)
        .groupBy("user_id", slice_of("created", slice_seconds).alias("slice"))
        .agg(_ordered(step).alias("steps"))
        .filter(F.size("steps") > 0)
        .join(users.select("user_id"), "user_id", "left_semi")
    )
    sliced = sliced.withColumn("pages", F.transform("steps", lambda step: step["page_name"]))
    pages = F.flatten(F.transform(_ordered(F.struct("slice", "pages")), lambda part: part["pages"]))
    return sliced.groupBy("user_id").agg(pages.alias("journey_pages"))


def _paged() -> Column:
    return F.col("page_text").isNotNull()


def _ordered(value: Column) -> Column:
    return F.sort_array(F.collect_list(value))


def _row_figures() -> list[Column]:
    step = F.when(_paged(), F.struct("created", "id", "page_text"))
    return [
        F.count("page_text").alias("pages"),
        F.sum(F.length("page_text")).alias("chars"),
        F.sum(occurrences("page_text", ",")).alias("commas"),
        F.max("offer_id").alias("offer_id"),
        F.count_if("on_banner").alias("banner_clicks"),
        F.count_if("on_attribute").alias("attr_clicks"),
        F.count_if("to_offer").alias("redirected"),
        F.min(step).alias("head"),
        F.max(step).alias("tail"),
    ]


def _merged_figures() -> list[Column]:
    return [*_merges(), _category()]


def _merges() -> list[Column]:
    added = ["pages", "chars", "commas", "banner_clicks", "attr_clicks", "redirected"]
    largest = ["offer_id", "tail"]
    return [
        *[F.sum(name).alias(name) for name in added],
        *[F.max(name).alias(name) for name in largest],
        F.min("head").alias("head"),
    ]


def _category() -> Column:
    return F.max("offer_category_id").alias("offer_category_id")


def _finish(merged: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Turn added figures into the session columns."""
    blank = (F.col("pages") == 0) | ((F.col("pages") == 1) & (F.col("chars") == 0))
    return merged.select(
        *SESSION,
        "offer_id",
        "offer_category_id",
        F.when(blank, F.lit(0)).otherwise(F.col("pages") + F.col("commas")).alias("journey_len"),
        "banner_clicks",
        "attr_clicks",
        "redirected",
        F.when(~blank, F.element_at(tokens("head.page_text"), 1)).alias("first_page"),
        F.when(~blank, F.element_at(tokens("tail.page_text"), -1)).alias("last_page"),
        *extra,
    )
