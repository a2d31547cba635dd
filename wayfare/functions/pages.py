"""Page names from URLs, and the tokens of a journey."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.functions.references import ROUTE, USER_VISIT

# Page URLs are named only when longer than 19 and shorter than
# 50 characters; sections that are never split by their child segment.
MIN_URL_CHARS = 20
MAX_URL_CHARS = 49
PROFILE_SECTIONS = ("profile", "matches")


@dataclass(frozen=True)
class PageRule:
    """How one report names pages.

    ``visits_too``      name ``user_visit`` pages as well; the length limits
                        then hold for those only, and ``route`` has none
    ``keep_id``         ``section?id=7`` becomes ``section[7]``
    ``child_sections``  which ``/section/child`` pages become
                        ``section[child]``: "other" (all but profile
                        sections), "profile" (only those) or "none"
    """

    visits_too: bool
    keep_id: bool
    child_sections: str


PAGE_RULES = {
    "bracketed": PageRule(visits_too=False, keep_id=True, child_sections="other"),
    "with_visits": PageRule(visits_too=True, keep_id=True, child_sections="other"),
    "plain_id": PageRule(visits_too=False, keep_id=False, child_sections="other"),
    "inverted": PageRule(visits_too=False, keep_id=True, child_sections="profile"),
    "generic": PageRule(visits_too=True, keep_id=False, child_sections="none"),
}


def first_segment(page: str | Column) -> Column:
    """First path segment of a URL without its query string."""
    return F.trim(_part(_part(_col(page), "/", 4), "?", 1))


def page_name(rule: str | PageRule, event: str = "event", page: str = "page") -> Column:
    """Name of the page an event happened on, NULL when it has none.

    Only URLs with three or four slashes have a name. Cuts by
    ``substring_index`` build no arrays, which matters on every event row.
    """
    rule = PAGE_RULES[rule] if isinstance(rule, str) else rule
    url, kind = F.col(page), F.col(event)
    section = F.substring_index(F.substring_index(url, "/", 4), "/", -1)
    plain = F.trim(F.substring_index(section, "?", 1))
    usable_length = F.length(url).between(MIN_URL_CHARS, MAX_URL_CHARS)
    if rule.visits_too:
        named = (kind == ROUTE) | ((kind == USER_VISIT) & usable_length)
    else:
        named = (kind == ROUTE) & usable_length

    flat = plain
    if rule.keep_id:
        flat = F.when(url.contains("id="), _bracket(plain, _part(section, "id=", 2))).otherwise(plain)

    nested = plain
    if rule.child_sections != "none":
        profile = F.lit(False)
        for name in PROFILE_SECTIONS:
            profile = profile | section.contains(name)
        split = profile if rule.child_sections == "profile" else ~profile
        child = F.substring_index(url, "/", -1)
        nested = F.when(split, _bracket(F.trim(section), child)).otherwise(plain)

    four, five = _has_slashes(url, 4), _has_slashes(url, 5)
    return F.when(named & _has_slashes(url, 3) & ~five, F.when(four, nested).otherwise(flat))


def _has_slashes(url: Column, count: int) -> Column:
    """At least ``count`` slashes: the cut at that slash leaves something off."""
    return F.substring_index(url, "/", count) != url


def occurrences(text: str | Column, char: str) -> Column:
    """How often a single character occurs."""
    text = _col(text)
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def journey_text(name: str | Column) -> Column:
    """A page name as it reads inside a journey string: every 'null' removed.

    Names are joined by commas and 'null' holds none, so removing it name by
    name equals removing it from the joined string.
    """
    return F.replace(_col(name), F.lit("null"), F.lit(""))


def tokens(journey: str | Column) -> Column:
    return F.split(_col(journey), ",", -1)


def general_page(token: str | Column) -> Column:
    """A page token without its bracketed id."""
    return _part(_col(token), "[", 1)


def journey_length(journey: str | Column) -> Column:
    """Length of a finished journey string: 0 when blank, else commas + 1."""
    journey = _col(journey)
    return F.when(journey == "", F.lit(0)).otherwise(occurrences(journey, ",") + 1)


def _bracket(head: Column, inner: Column) -> Column:
    return F.concat_ws("", head, F.lit("["), F.trim(inner), F.lit("]"))


def _part(text: Column, delimiter: str, index: int) -> Column:
    return F.split_part(text, F.lit(delimiter), F.lit(index))


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
