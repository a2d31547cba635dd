"""What an event refers to: banners, offers, screens, visits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANNER_CLICK = "bnr_click"
BANNER_SHOW = "banner_show"
OFFER_REDIRECT = "redirected_to_offer"
ROUTE = "route"
USER_VISIT = "user_visit"
PAGE_EVENTS = (ROUTE, USER_VISIT)
CHAT_LIMIT = "chat_message_limit_reached"
IDLE_EVENTS = ("user_afk", "user_socket_disconnect")


def visit_key(visit_id: str | Column) -> Column:
    """Visit ids compare as UUIDs: case and outer blanks do not matter."""
    return F.lower(F.trim(visit_id))


def banner_ref(event: str = "event", attr_1: str = "attr_1", attr_2: str = "attr_2") -> Column:
    """Clicked banner or attribute; everything else falls back to ``attr_2``."""
    first = (F.col(event) == BANNER_CLICK) & (F.col(attr_1) != "null")
    return F.when(first, F.col(attr_1)).otherwise(F.col(attr_2))


def offer_ref(event: str = "event", attr_1: str = "attr_1") -> Column:
    """Offer a redirect leads to; malformed ids give NULL."""
    return F.when(F.col(event) == OFFER_REDIRECT, F.col(attr_1)).try_cast("int")


def is_banner_click(event: str, ref: str | Column) -> Column:
    # \z, not $: Java's $ also matches before a final line break.
    return (F.col(event) == BANNER_CLICK) & _col(ref).rlike(r"^[0-9]+\z")


def is_attribute_click(event: str, ref: str | Column) -> Column:
    return (F.col(event) == BANNER_CLICK) & _col(ref).rlike("[A-Za-z]")


def screen_size(user_info: str | Column = "user_info") -> Column:
    """``WxH`` with both sides floored to tens; a missing side stays blank."""
    return F.concat_ws("", _tens(user_info, "screen_size_width"), F.lit("x"), _tens(user_info, "screen_size_height"))


def banner_url(base_url: str, image_url: str | Column = "image_url") -> Column:
    return F.concat_ws("", F.lit(base_url), _col(image_url))


def _tens(user_info: str | Column, key: str) -> Column:
    side = F.get_json_object(_col(user_info), f"$.{key}").try_cast("int")
    return F.call_function("div", side, F.lit(10)) * 10


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
