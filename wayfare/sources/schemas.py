"""Explicit schemas of every input; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_INT, _LONG, _TEXT = T.IntegerType(), T.LongType(), T.StringType()
_DOUBLE, _FLAG, _TIME = T.DoubleType(), T.BooleanType(), T.TimestampNTZType()

USER_EVENT = _schema(
    id=_LONG, user_id=_LONG, created=_TIME, event=_TEXT, page=_TEXT, attr_1=_TEXT, attr_2=_TEXT, user_visit_id=_TEXT
)
USER = _schema(
    id=_LONG,
    created=_TIME,
    device=_TEXT,
    os=_TEXT,
    device_vendor=_TEXT,
    user_info=_TEXT,
    conversion_funnel_id=_INT,
    user_source=_TEXT,
)
USER_VISIT = _schema(id=_TEXT, user_id=_LONG, session_start=_TIME)
OFFER = _schema(id=_INT, offer_category_id=_INT, conversion_type=_TEXT)
BANNER = _schema(id=_INT, device=_TEXT, placement=_TEXT, image_url=_TEXT, priority=_INT)
BANNER_CLICK = _schema(
    id=_LONG,
    user_id=_LONG,
    banner_id=_INT,
    offer_id=_INT,
    page=_TEXT,
    created=_TIME,
    redirected_to_offer=_FLAG,
    cpc_revenue=MONEY,
)
POSTBACK = _schema(banner_click_id=_LONG, payout=MONEY)
ASSETS = _schema(image_url=_TEXT, size_bytes=_LONG)

TABLES = {
    "user_event": USER_EVENT,
    "user": USER,
    "user_visit": USER_VISIT,
    "offer": OFFER,
    "banner": BANNER,
    "banner_click": BANNER_CLICK,
    "postback": POSTBACK,
    "assets": ASSETS,
}

# Journey exports, in the column order their SQL emits.
JOURNEY_EXPORT = _schema(
    user_id=_LONG,
    session_number=_INT,
    product_time=_DOUBLE,
    offer_id=_INT,
    offer_category_id=_INT,
    os=_TEXT,
    device_vendor=_TEXT,
    funnel_id=_INT,
    screen_size=_TEXT,
    journey_len=_LONG,
    journey_pages=_TEXT,
    banner_clicks=_LONG,
    attr_clicks=_LONG,
    redirected=_LONG,
)
USERS_ANALYTICS_EXPORT = T.StructType([*JOURNEY_EXPORT.fields, T.StructField("user_source", _TEXT)])
AFTER_EVENT_EXPORT = _schema(user_id=_LONG, session_number=_INT, funnel_id=_INT, journey_pages=_TEXT)
FEEDBACK = _schema(text=_TEXT)
LEXICON = _schema(word=_TEXT, polarity=T.DecimalType(4, 2))
