"""The checked queries once more, as SQL for DuckDB over the driver's tables.

Written from the meaning of each report: joins and windows over event rows,
and journey strings that are split again. The Spark side works on sums and
slices instead, so the two agree only if both are right.
"""

from __future__ import annotations

AS_OF = "DATE '2024-01-31'"
SITE = "https://app.example.com"
IMAGES = "https://img.example.com/b/"

_TABLES = f"""
src AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
user_event AS (
  SELECT event_id AS id, user_id, ts AS created, k, value,
    CASE event_type
      WHEN 'view' THEN 'route'
      WHEN 'signup' THEN CASE WHEN k % 5 = 0 THEN 'chat_message_limit_reached' ELSE 'user_visit' END
      WHEN 'click' THEN 'bnr_click'
      WHEN 'purchase' THEN 'redirected_to_offer'
      WHEN 'error' THEN
        CASE k % 4 WHEN 0 THEN 'user_afk' WHEN 1 THEN 'user_socket_disconnect' ELSE 'banner_show' END
    END AS event,
    CASE k % 10
      WHEN 0 THEN '{SITE}/browse'
      WHEN 1 THEN '{SITE}/chats?id=' || (k % 7)
      WHEN 2 THEN '{SITE}/profile/' || (k % 7)
      WHEN 3 THEN '{SITE}/matches/' || (k % 7) || '?p=1'
      WHEN 4 THEN '{SITE}/chats/' || (k % 7)
      WHEN 5 THEN '{SITE}/feed?x=1'
      WHEN 6 THEN 'https://a.io/b'
      WHEN 7 THEN '{SITE}/settings/' || repeat('z', 40)
      WHEN 8 THEN CASE WHEN k = 8 THEN NULL ELSE '{SITE}/' END
      ELSE '{SITE}/a/b/c'
    END AS page,
    CASE event_type
      WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'attr' || (k % 9) ELSE CAST(k AS VARCHAR) END
      WHEN 'purchase' THEN CAST(k AS VARCHAR)
      WHEN 'error' THEN CAST(k % 20 AS VARCHAR)
    END AS attr_1,
    CASE WHEN event_type = 'click' THEN
      CASE WHEN k % 3 = 0 THEN 'btn' || (k % 5) ELSE CAST(k % 10 AS VARCHAR) END
    END AS attr_2,
    CAST(user_id * 100 + (CAST(ts AS DATE) - DATE '2024-01-01') // 7 AS VARCHAR) AS user_visit_id
  FROM src
),
user_visit AS (
  SELECT user_visit_id AS id, user_id, min(created) AS session_start FROM user_event GROUP BY ALL
),
app_user AS (
  SELECT c_custkey AS id, coalesce(f.first_ts, TIMESTAMP '2024-01-01') AS created,
    CASE WHEN c_custkey % 3 = 2 THEN 'desktop' ELSE 'mobile' END AS device,
    CASE c_custkey % 3 WHEN 0 THEN 'iOS' WHEN 1 THEN 'Android' ELSE 'Windows' END AS os,
    c_mktsegment AS device_vendor,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 320 + c_custkey % 97 END AS width,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 640 + c_custkey % 203 END AS height,
    CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 8 END AS conversion_funnel_id,
    CASE WHEN c_custkey % 13 <> 0 THEN 'src' || (c_nationkey % 4) END AS user_source
  FROM customer LEFT JOIN (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id) f ON f.user_id = c_custkey
),
offer AS (
  SELECT CAST(p_partkey AS INTEGER) AS id, CAST(p_size % 7 AS INTEGER) AS offer_category_id,
    CASE p_partkey % 3 WHEN 0 THEN 'cpc' WHEN 1 THEN 'cpa' END AS conversion_type
  FROM part
),
banner AS (
  SELECT CAST(s_suppkey AS INTEGER) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device,
    'slot' || (s_suppkey % 3) AS placement, 'b' || s_suppkey || '.gif' AS image_url, s_suppkey % 5 AS priority
  FROM supplier
),
banner_click AS (
  SELECT id, user_id, created, page,
    CASE WHEN id % 17 <> 0 THEN TRY_CAST(attr_1 AS INTEGER) % 10 END AS banner_id,
    TRY_CAST(right(attr_1, 1) AS INTEGER) + k AS offer_id,
    id % 3 = 0 AS redirected_to_offer,
    CASE WHEN id % 2 = 0 THEN CAST(value AS DECIMAL(18, 2)) END AS cpc_revenue
  FROM user_event WHERE event = 'bnr_click'
),
postback AS (
  SELECT id AS banner_click_id, CAST(1.25 AS DECIMAL(18, 2)) AS payout FROM banner_click WHERE id % 3 = 0
  UNION ALL
  SELECT id, CAST(2.50 AS DECIMAL(18, 2)) FROM banner_click WHERE id % 6 = 0
),
assets AS (
  SELECT image_url, (id + 1) * 1000 + 500 AS size_bytes FROM banner
)"""

_SECTION = "split_part(e.page, '/', 4)"
_PLAIN = f"trim(split_part({_SECTION}, '?', 1))"
_DEPTH = "length(e.page) - length(replace(e.page, '/', ''))"
_SIZED = "length(e.page) > 19 AND length(e.page) < 50"
_PROFILE = f"({_SECTION} LIKE '%profile%' OR {_SECTION} LIKE '%matches%')"
_WITH_ID = f"concat({_PLAIN}, '[', trim(split_part({_SECTION}, 'id=', 2)), ']')"
_WITH_CHILD = f"concat(trim({_SECTION}), '[', trim(split_part(e.page, '/', 5)), ']')"


def _page(rule: str) -> str:
    gate = {"with_visits": True, "generic": True}.get(rule, False)
    named = f"e.event = 'route' AND {_SIZED}"
    if gate:
        named = f"e.event = 'route' OR (e.event = 'user_visit' AND {_SIZED})"
    flat = _PLAIN
    if rule in ("bracketed", "with_visits", "inverted"):
        flat = f"CASE WHEN e.page LIKE '%id=%' THEN {_WITH_ID} ELSE {_PLAIN} END"
    nested = f"CASE WHEN {_PROFILE} THEN {_PLAIN} ELSE {_WITH_CHILD} END"
    if rule == "inverted":
        nested = f"CASE WHEN {_PROFILE} THEN {_WITH_CHILD} ELSE {_PLAIN} END"
    if rule == "generic":
        nested = _PLAIN
    return f"CASE WHEN {named} THEN CASE {_DEPTH} WHEN 3 THEN {flat} WHEN 4 THEN {nested} END END"


_BANNER_REF = "CASE WHEN e.event = 'bnr_click' AND e.attr_1 <> 'null' THEN e.attr_1 ELSE e.attr_2 END"
_OFFER_REF = "CASE WHEN e.event = 'redirected_to_offer' THEN TRY_CAST(e.attr_1 AS INTEGER) END"
_SCREEN = "concat(CAST(width // 10 * 10 AS VARCHAR), 'x', CAST(height // 10 * 10 AS VARCHAR))"


def _since(column: str, days: int) -> str:
    return f"CAST({column} AS DATE) >= {AS_OF} - {days}"


def _base(rule: str = "bracketed", days: int = 31, filter_visits: bool = True) -> str:
    """Event rows with user, visit, session number and page name."""
    visits = f"AND {_since('v.session_start', days)}" if filter_visits else ""
    return f"""
base AS (
  SELECT e.id, e.user_id, e.created, e.event, u.os, u.device_vendor, u.width, u.height, u.conversion_funnel_id,
    u.user_source, v.id AS visit_id, v.user_id AS owner_id, v.session_start,
    CAST(dense_rank() OVER (PARTITION BY v.user_id ORDER BY v.session_start) AS INTEGER) AS session_number,
    {_page(rule)} AS page_name, {_BANNER_REF} AS banner_ref, {_OFFER_REF} AS offer_id
  FROM user_event e JOIN app_user u ON u.id = e.user_id JOIN user_visit v ON v.id = e.user_visit_id
  WHERE {_since("e.created", days)} {visits}
)"""


def _time(days: int = 31) -> str:
    return f"""
early AS (
  SELECT e.id, e.user_id, e.created, lag(e.created) OVER (PARTITION BY e.user_id ORDER BY e.created, e.id) AS previous
  FROM user_event e JOIN app_user u ON u.id = e.user_id
  WHERE {_since("e.created", days)} AND e.created <= u.created + INTERVAL 744 HOUR AND u.device = 'mobile'
    AND e.event NOT IN ('user_afk', 'user_socket_disconnect')
),
gaps AS (SELECT id, user_id, epoch_us(created) - epoch_us(previous) AS gap_us FROM early),
spent AS (
  SELECT user_id, CAST(sum(gap_us) AS BIGINT) / 1000000.0 AS product_time
  FROM gaps WHERE gap_us <= 86400000000 GROUP BY user_id
)"""


def _journeys(rule: str = "bracketed", days: int = 31, cap: int | None = None) -> str:
    capped = f"WHERE b.session_number <= {cap}" if cap else ""
    return f"""{_base(rule, days)}, {_time(days)},
texts AS (
  SELECT b.user_id, b.session_number, CAST(max(s.product_time) AS DOUBLE) AS product_time, max(b.offer_id) AS offer_id,
    max(o.offer_category_id) AS offer_category_id, max(b.os) AS os, max(b.device_vendor) AS device_vendor,
    max(b.conversion_funnel_id) AS funnel_id, max(b.user_source) AS user_source,
    max({_SCREEN}) AS screen_size,
    replace(coalesce(string_agg(b.page_name, ',' ORDER BY b.created, b.id), ''), 'null', '') AS journey_pages,
    string_agg(concat(b.event, '|', coalesce(b.page_name, '~'), '|', CAST(b.created AS DATE)), ';'
      ORDER BY b.created, b.id) AS page_info,
    count(*) FILTER (b.event = 'bnr_click' AND regexp_full_match(b.banner_ref, '[0-9]+')) AS banner_clicks,
    count(*) FILTER (b.event = 'bnr_click' AND regexp_matches(b.banner_ref, '[A-Za-z]')) AS attr_clicks,
    count(*) FILTER (b.event = 'redirected_to_offer') AS redirected
  FROM base b LEFT JOIN offer o ON o.id = b.offer_id LEFT JOIN spent s ON s.user_id = b.user_id
  {capped}
  GROUP BY b.user_id, b.session_number
),
journeys AS (
  SELECT *, CASE WHEN journey_pages = '' THEN 0
    ELSE length(journey_pages) - length(replace(journey_pages, ',', '')) + 1 END AS journey_len,
    string_split(nullif(journey_pages, ''), ',') AS pages
  FROM texts
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join([_TABLES, *parts])


_CONVERTED = "product_time > 9 AND redirected > 0 AND funnel_id IN (1, 8)"
_PATTERN = "product_time > 9 AND redirected > 0 AND session_number <= 5 AND funnel_id = 8"
_IDLE = "product_time > 9 AND redirected = 0 AND banner_clicks = 0 AND attr_clicks = 0"

_HEAD = "user_id, session_number"
_OFFER = "offer_id, offer_category_id, os, device_vendor, funnel_id"
_CLICKS = "banner_clicks, attr_clicks, redirected"
_JOURNEY = f"{_HEAD}, product_time, {_OFFER}, screen_size, journey_len, journey_pages, {_CLICKS}"

_FIGURES = """
  count(DISTINCT user_id) AS total_user, CAST(sum(banner_clicks) AS BIGINT) AS banner_click,
  CAST(sum(attr_clicks) AS BIGINT) AS attribute_click, CAST(sum(redirected) AS BIGINT) AS redirected,
  avg(journey_len) AS journey_len,
  CAST(sum(CAST(product_time AS DECIMAL(18, 6))) AS DOUBLE) / count(product_time) AS product_time"""

_FILLED = f"""
filled AS (
  SELECT * REPLACE (coalesce(offer_category_id, 0) AS offer_category_id) FROM journeys WHERE {_CONVERTED}
)"""


def _stats(keys: str, source: str = "filled", grouping: str | None = None) -> str:
    by = grouping or keys
    return f"""
  SELECT {keys}, banner_click, attribute_click, redirected, journey_len, product_time, total_user,
    banner_click + attribute_click AS total_click,
    round_even(banner_click / total_user * 100, 0) AS banner_click_pct,
    round_even(attribute_click / total_user * 100, 0) AS attribute_click_pct,
    round_even((banner_click + attribute_click) / total_user * 100, 0) AS total_click_pct
  FROM (SELECT {keys}, {_FIGURES} FROM {source} GROUP BY {by})"""


_SETS = [
    "funnel_id",
    "offer_category_id",
    "session_number",
    "funnel_id, session_number",
    "screen_size",
    "funnel_id, session_number, offer_category_id",
]


def _stat_sets() -> str:
    columns = ["funnel_id", "offer_category_id", "session_number", "screen_size"]
    parts = []
    for keys in _SETS:
        used = keys.split(", ")
        # Columns take their place in the order the groupings first name them.
        label = "+".join(c for c in columns if c in used)
        shown = ", ".join(c if c in used else f"NULL AS {c}" for c in columns)
        parts.append(f"SELECT '{label}' AS grouping, {shown}, * EXCLUDE ({keys}) FROM ({_stats(keys)})")
    return " UNION ALL BY NAME ".join(parts)


def _steps(page: str, where: str, source: str = "journeys") -> str:
    return f"""SELECT funnel_id, CAST(session_number AS VARCHAR) AS session, {page} AS page_name, count(*) AS count
  FROM {source} WHERE {where} GROUP BY ALL"""


_AFTER = f"""{_base("inverted", 31, filter_visits=False)},
anchors AS (
  SELECT user_id, session_number, max(conversion_funnel_id) AS funnel_id, min(created) AS anchor_time
  FROM base WHERE event = 'chat_message_limit_reached' GROUP BY user_id, session_number
),
after_anchor AS (
  SELECT b.user_id, b.session_number, max(b.conversion_funnel_id) AS funnel_id,
    replace(coalesce(string_agg(b.page_name, ',' ORDER BY b.created, b.id), ''), 'null', '') AS journey_pages
  FROM base b JOIN anchors a ON a.user_id = b.user_id AND a.session_number = b.session_number
  WHERE b.event = 'route' AND b.created > a.anchor_time AND b.session_number <= 5
  GROUP BY b.user_id, b.session_number
)"""

_ITEMS = f"""
baskets AS (
  SELECT row_number() OVER () AS basket,
    list_distinct(string_split(trim(split_part(journey_pages, '[', 1)), ',')) AS items
  FROM journeys WHERE {_PATTERN}
),
singles AS (SELECT basket, unnest(items) AS item FROM baskets)"""

_SHOWS = f"""
shows AS (
  SELECT b.id AS banner_id, u.id AS user_id, CAST(e.created AS DATE) AS shown, CAST(u.created AS DATE) AS signed
  FROM user_event e JOIN app_user u ON u.id = e.user_id LEFT JOIN banner b ON CAST(b.id AS VARCHAR) = e.attr_1
  WHERE {_since("e.created", 31)} AND e.event = 'banner_show'
),
shown AS (SELECT banner_id, count(*) AS impressions, count(DISTINCT user_id) AS users FROM shows GROUP BY banner_id),
shown_24h AS (
  SELECT banner_id, count(*) AS impressions_24hours FROM shows
  WHERE banner_id IS NOT NULL AND shown <= signed + 1 GROUP BY banner_id
)"""


def _clicks(postbacks: str) -> str:
    return f"""
clicked AS (
  SELECT c.banner_id, concat('{IMAGES}', b.image_url) AS banner_url, count(*) AS clicks,
    count(*) FILTER (c.redirected_to_offer) AS redirects,
    count(*) FILTER (o.conversion_type <> 'cpc') AS cpa_clicks,
    CAST(coalesce(sum(p.payout), 0) + coalesce(sum(c.cpc_revenue), 0) AS DOUBLE) AS revenue,
    CAST(coalesce(sum(p.payout), 0) AS DOUBLE) AS cpa_revenue
  FROM banner_click c JOIN app_user u ON u.id = c.user_id JOIN offer o ON o.id = c.offer_id
    JOIN banner b ON b.id = c.banner_id LEFT JOIN {postbacks} p ON p.banner_click_id = c.id
  WHERE {_since("c.created", 31)}
  GROUP BY c.banner_id, b.priority, b.image_url
)"""


_SUMMED = "(SELECT banner_click_id, sum(payout) AS payout FROM postback GROUP BY banner_click_id)"
_REPORT = """
report AS (
  SELECT s.banner_id, c.banner_url, s.users, s.impressions, d.impressions_24hours, c.clicks, c.redirects, c.cpa_clicks,
    c.revenue, c.cpa_revenue
  FROM shown s LEFT JOIN clicked c ON c.banner_id = s.banner_id LEFT JOIN shown_24h d ON d.banner_id = s.banner_id
)"""

_SCORES = """WITH lexicon AS (
  SELECT * FROM (VALUES ('for', 0.6), ('with', 0.9), ('this', 0.3), ('by', 0.1), ('was', -0.4), ('from', -0.9),
    ('on', -0.2), ('as', 0.8)) t (word, weight)
),
words AS (
  SELECT conv_id, turn, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS word FROM conversations
),
scores AS (
  SELECT c.conv_id, c.turn, coalesce(s.polarity, 0.0) AS polarity
  FROM conversations c LEFT JOIN (
    SELECT conv_id, turn, CAST(sum(CAST(weight AS DECIMAL(4, 2))) AS DOUBLE) / count(*) AS polarity
    FROM words JOIN lexicon USING (word) GROUP BY conv_id, turn
  ) s ON s.conv_id = c.conv_id AND s.turn = c.turn
),
labelled AS (
  SELECT *, CASE WHEN polarity > 0.5 THEN 'very good' WHEN polarity > 0 THEN 'good' WHEN polarity < 0 THEN 'bad'
    ELSE 'normal' END AS sentiment_label
  FROM scores
),
sizes AS (SELECT sentiment_label, count(*) AS size FROM labelled GROUP BY sentiment_label),
shares AS (SELECT sentiment_label, size / (SELECT max(size) FROM sizes) AS share FROM sizes),
recalibrated AS (
  SELECT conv_id, turn, polarity,
    CASE l.sentiment_label
      WHEN 'very good' THEN CASE WHEN share > 0.1 THEN 'very good' ELSE 'good' END
      WHEN 'good' THEN CASE WHEN share > 0.2 THEN 'good' ELSE 'normal' END
      WHEN 'normal' THEN CASE WHEN share > 0.6 THEN 'normal' ELSE 'bad' END
      ELSE CASE WHEN share > 0.1 THEN 'bad' ELSE 'hate' END
    END AS sentiment_label
  FROM labelled l JOIN shares s ON s.sentiment_label = l.sentiment_label
)
"""

_GROUP_KEYS = "funnel_id, session_number, offer_category_id, offer_id"
_TOP = f"""
sums AS (
  SELECT {_GROUP_KEYS}, CAST(sum(redirected) AS BIGINT) AS redirected FROM journeys
  WHERE offer_category_id IS NOT NULL AND offer_id IS NOT NULL AND funnel_id IS NOT NULL GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (ORDER BY redirected DESC, {_GROUP_KEYS}) AS place FROM sums),
top AS (
  SELECT {_GROUP_KEYS}, redirected FROM ranked
  WHERE place <= (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM journeys)
)"""
_IN_TOP = (
    "EXISTS (SELECT 1 FROM top t WHERE t.funnel_id = j.funnel_id AND t.session_number = j.session_number "
    "AND t.offer_category_id = j.offer_category_id AND t.offer_id = j.offer_id)"
)

_USER_PAGES = f"""
paged AS (
  SELECT e.user_id, e.id, e.created, {_page("generic")} AS page_name FROM user_event e
  JOIN app_user u ON u.id = e.user_id WHERE {_since("e.created", 31)} AND u.conversion_funnel_id = 1
)"""


_EVENT_ROWS = """
event_rows AS (
  SELECT user_id, session_number, row_number() OVER (PARTITION BY user_id, session_number ORDER BY created, id) AS position,
    event, page_name, strftime(created, '%Y-%m-%d') AS created_date
  FROM base
)"""

# Reports that are also made from tables stored by day, with the same result.
BY_DAY = [
    "user_journey",
    "user_journey_detailed",
    "journey_after_event",
    "popular_interactions",
    "page_visits",
    "funnel_stats_by_funnel_session_category",
]


def oracle_sql() -> dict[str, str]:
    sql = {
        "events_lookback": f"""{_with()}
  SELECT id AS event_id, user_id, event FROM user_event WHERE {_since("created", 7)}""",
        "banner_ref": f"""{_with()}, refs AS (SELECT id, event, {_BANNER_REF} AS banner_ref FROM user_event e)
  SELECT id AS event_id, banner_ref,
    coalesce(event = 'bnr_click' AND regexp_full_match(banner_ref, '[0-9]+'), false) AS is_banner_click,
    coalesce(event = 'bnr_click' AND regexp_matches(banner_ref, '[A-Za-z]'), false) AS is_attribute_click
  FROM refs""",
        "offer_ref": f"{_with()} SELECT id AS event_id, {_OFFER_REF} AS offer_id FROM user_event e",
        "banner_event_pages": f"""{_with()}
  SELECT e.id, e.user_id, e.event, b.id AS banner_id, b.device, b.placement, {_PLAIN} AS page_name
  FROM user_event e JOIN app_user u ON u.id = e.user_id LEFT JOIN banner b ON CAST(b.id AS VARCHAR) = e.attr_1
  WHERE {_since("e.created", 31)} AND e.event IN ('banner_show', 'bnr_click')""",
        "session_number": f"{_with(_base())} SELECT DISTINCT user_id, visit_id, session_number FROM base",
        "session_bounds": f"""{_with(_base())},
starts AS (SELECT DISTINCT owner_id, session_number, session_start FROM base)
  SELECT owner_id, session_number, strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start,
    strftime(lead(session_start) OVER (PARTITION BY owner_id ORDER BY session_start), '%Y-%m-%d %H:%M:%S.%f')
      AS session_end
  FROM starts""",
        "event_gaps": f"""{_with(_time())}
  SELECT id AS event_id, user_id, CAST(gap_us / 1000000.0 AS DOUBLE) AS gap_seconds FROM gaps""",
        "product_time": f"{_with(_time())} SELECT user_id, CAST(product_time AS DOUBLE) AS product_time FROM spent",
        "screen_size": f"{_with()} SELECT id AS user_id, {_SCREEN} AS screen_size FROM app_user",
        "user_journey": f"{_with(_journeys())} SELECT {_JOURNEY} FROM journeys",
        "user_journey_recent": f"{_with(_journeys(days=7))} SELECT {_JOURNEY} FROM journeys",
        "user_journey_first5": f"{_with(_journeys('inverted', 31, 5))} SELECT {_JOURNEY} FROM journeys",
        "user_journey_first2": f"{_with(_journeys('inverted', 31, 2))} SELECT {_JOURNEY} FROM journeys",
        "user_journey_basic": f"""{_with(_journeys("with_visits"))}
  SELECT {_HEAD}, {_OFFER}, journey_len, journey_pages, {_CLICKS} FROM journeys""",
        "user_journey_detailed": f"{_with(_journeys('plain_id'))} SELECT {_JOURNEY}, page_info FROM journeys",
        "session_summary": f"""{_with(_journeys())}
  SELECT {_HEAD}, product_time, {_OFFER}, screen_size, journey_len, pages[1] AS first_page, pages[-1] AS last_page,
    {_CLICKS}, user_source
  FROM journeys""",
        "journey_steps": f"""{_with(_base())}
  SELECT user_id, session_number, page_name,
    row_number() OVER (PARTITION BY user_id, session_number ORDER BY created, id) AS position
  FROM base WHERE page_name IS NOT NULL""",
        "journey_chunks": f"""{_with(_base())}, steps AS (
    SELECT user_id, session_number, replace(page_name, 'null', '') AS page,
      row_number() OVER (PARTITION BY user_id, session_number ORDER BY created, id) AS position
    FROM base WHERE page_name IS NOT NULL
  )
  SELECT user_id, session_number, (position - 1) // 2 AS chunk, count(*) AS pages,
    string_agg(page, ',' ORDER BY position) AS journey_pages FROM steps GROUP BY ALL""",
        "journey_event_rows": f"{_with(_base('plain_id'), _EVENT_ROWS)} SELECT * FROM event_rows",
        "journey_event_chunks": f"""{_with(_base('plain_id'), _EVENT_ROWS)}
  SELECT user_id, session_number, (position - 1) // 3 AS chunk,
    string_agg(concat(event, '|', coalesce(page_name, '~'), '|', created_date), ';' ORDER BY position) AS page_info
  FROM event_rows GROUP BY ALL""",
        "anchor_times": f"""{_with(_AFTER)}
  SELECT user_id, session_number, funnel_id, strftime(anchor_time, '%Y-%m-%d %H:%M:%S.%f') AS anchor_time
  FROM anchors WHERE session_number <= 5""",
        "journey_after_event": f"""{_with(_AFTER)}
  SELECT user_id, session_number, funnel_id, journey_pages FROM after_anchor""",
        "user_pages_array": f"""{_with(_USER_PAGES)}
  SELECT user_id, 1 AS funnel_id, string_agg(page_name, '|' ORDER BY created, id) AS journey_pages, count(*) AS pages
  FROM paged WHERE page_name IS NOT NULL GROUP BY user_id""",
        "user_page_steps": f"""{_with(_USER_PAGES)}
  SELECT user_id, page_name, row_number() OVER (PARTITION BY user_id ORDER BY created, id) AS position
  FROM paged WHERE page_name IS NOT NULL""",
        "funnel_stats_grouping_sets": f"{_with(_journeys(), _FILLED)} {_stat_sets()}",
        "second_page_counts": _with(_journeys())
        + _steps("split_part(pages[2], '[', 1)", f"{_CONVERTED} AND journey_len <> 1 AND pages[1] <> pages[-1]"),
        "last_page_after_event": f"""{_with(_AFTER)},
  ends AS (SELECT *, string_split(coalesce(nullif(journey_pages, ''), 'nan'), ',') AS pages FROM after_anchor)
  {_steps("split_part(pages[-1], '[', 1)", "len(pages) = 1 OR pages[1] <> pages[-1]", "ends")}""",
        "nonconverted_by_source": f"""{_with(_journeys())}
  SELECT funnel_id, coalesce(user_source, '0') AS user_source, CAST(sum(redirected) AS BIGINT) AS redirected_sum,
    CAST(avg(redirected) AS DOUBLE) AS redirected_mean, count(DISTINCT user_id) AS users
  FROM journeys WHERE {_IDLE} AND funnel_id = 8 AND coalesce(pages[-1], '') NOT LIKE '%chats%' GROUP BY ALL""",
        "page_visits": f"""{_with(_journeys())}, visited AS (SELECT unnest(pages) AS page FROM journeys)
  SELECT trim(split_part(page, '[', 1)) AS page, count(*) AS visits FROM visited GROUP BY ALL""",
        "page_visits_top5": f"""{_with(_journeys())}, visited AS (SELECT unnest(pages) AS page FROM journeys)
  SELECT trim(split_part(page, '[', 1)) AS page, count(*) AS visits FROM visited
  GROUP BY ALL ORDER BY visits DESC, page LIMIT 5""",
        "popular_interactions": f"""{_with(_journeys())},
  visited AS (
    SELECT unnest(coalesce(pages, ['Null'])) AS page FROM journeys WHERE {_IDLE} AND session_number <= 5
  )
  SELECT page, count(*) AS visits FROM visited GROUP BY page""",
        "all_pages": f"""{_with(_journeys())},
  visited AS (SELECT unnest(coalesce(pages, ['0'])) AS page FROM journeys WHERE {_CONVERTED})
  SELECT page FROM visited UNION SELECT split_part(page, '[', 1) FROM visited""",
        "avg_page_per_user": f"""{_with(_journeys())},
  idle AS (SELECT * FROM journeys WHERE {_IDLE} AND session_number <= 5)
  SELECT CAST(sum(coalesce(len(list_filter(pages, lambda p: p = 'browse')), 0)) AS DOUBLE)
    / count(DISTINCT user_id) AS average_visits
  FROM idle""",
        "frequent_pairs": f"""{_with(_journeys(), _ITEMS)},
  found AS (
    SELECT item AS items, 1 AS size, basket FROM singles
    UNION ALL
    SELECT a.item || '|' || b.item, 2, a.basket FROM singles a JOIN singles b ON a.basket = b.basket AND a.item < b.item
  )
  SELECT items, size, count(*) AS freq, round(count(*) / (SELECT count(*) FROM baskets), 9) AS support
  FROM found GROUP BY items, size HAVING support >= 0.01""",
        "frequent_itemsets": f"""WITH RECURSIVE {_with(_journeys(), _ITEMS)[5:]},
  subsets AS (
    SELECT basket, item AS items, item AS last, 1 AS size FROM singles
    UNION ALL
    SELECT s.basket, s.items || '|' || i.item, i.item, s.size + 1
    FROM subsets s JOIN singles i ON i.basket = s.basket AND i.item > s.last
  )
  SELECT items, size, count(*) AS freq, round(count(*) / (SELECT count(*) FROM baskets), 9) AS support
  FROM subsets GROUP BY items, size HAVING count(*) / (SELECT count(*) FROM baskets) >= 0.01""",
        "banner_impressions": f"""{_with(_SHOWS)}
  SELECT s.banner_id, s.users, s.impressions, d.impressions_24hours
  FROM shown s LEFT JOIN shown_24h d ON d.banner_id = s.banner_id""",
        "banner_impressions_24h": f"{_with(_SHOWS)} SELECT banner_id, impressions_24hours FROM shown_24h",
        "banner_click_pages": f"""{_with()}
  SELECT c.id, c.user_id, c.banner_id, c.offer_id, b.device, b.placement,
    trim(split_part(split_part(c.page, '/', 4), '?', 1)) AS page_name, o.conversion_type
  FROM banner_click c JOIN app_user u ON u.id = c.user_id JOIN offer o ON o.id = c.offer_id
    JOIN banner b ON b.id = c.banner_id
  WHERE {_since("c.created", 31)}""",
        "banner_clicks": f"{_with(_clicks('postback'))} SELECT * FROM clicked",
        "banner_clicks_dedup": f"{_with(_clicks(_SUMMED))} SELECT * FROM clicked",
        "banner_report": f"{_with(_SHOWS, _clicks('postback'), _REPORT)} SELECT * FROM report",
        "banner_weight": f"""{_with(_SHOWS, _clicks("postback"), _REPORT)}
  SELECT r.*, a.size_bytes / 1000 AS weight_kb
  FROM report r LEFT JOIN assets a ON concat('{IMAGES}', a.image_url) = r.banner_url""",
        "sentiment_polarity": f"{_SCORES} SELECT conv_id, turn, round(polarity, 9) AS polarity FROM scores",
        "sentiment_label": f"{_SCORES} SELECT conv_id, turn, sentiment_label FROM labelled",
        "sentiment_recalibrated": f"{_SCORES} SELECT conv_id, turn, sentiment_label FROM recalibrated",
        "sentiment_counts": f"{_SCORES} SELECT sentiment_label, count(*) AS count FROM recalibrated GROUP BY ALL",
        "feedback_report": f"""{_SCORES}
  SELECT conv_id, turn, c.text, round(r.polarity, 9) AS polarity, r.sentiment_label
  FROM conversations c JOIN recalibrated r USING (conv_id, turn)""",
        "top_groups": f"{_with(_journeys(), _TOP)} SELECT {_GROUP_KEYS}, redirected FROM top",
        "top_group_rows": f"""{_with(_journeys(), _TOP)}
  SELECT {_HEAD}, redirected FROM journeys j WHERE {_IN_TOP} AND redirected > 0""",
        "top_group_all_rows": f"{_with(_journeys(), _TOP)} SELECT {_HEAD}, redirected FROM journeys j WHERE {_IN_TOP}",
        "top_group_page_visits": f"""{_with(_journeys(), _TOP)},
  visited AS (SELECT unnest(pages) AS page FROM journeys j WHERE {_IN_TOP} AND redirected > 0)
  SELECT trim(split_part(page, '[', 1)) AS page, count(*) AS visits FROM visited GROUP BY ALL""",
        "other_rows": f"""{_with(_journeys(), _TOP)}
  SELECT {_HEAD}, redirected FROM journeys j WHERE NOT {_IN_TOP} AND redirected <= 0""",
        "empty_rows": f"""{_with(_journeys(), _TOP)}
  SELECT {_HEAD}, redirected FROM journeys j WHERE NOT {_IN_TOP} AND journey_pages = ''""",
        "single_session_converted": f"""{_with(_journeys(days=7))}
  SELECT {_HEAD}, redirected FROM journeys
  WHERE product_time > 9 AND redirected > 0 AND funnel_id = 1 AND session_number = 1
    AND user_id NOT IN (SELECT user_id FROM journeys WHERE session_number > 1)""",
        "chat_ending_counts": _with(_journeys())
        + _steps("split_part(pages[-1], '[', 1)", "redirected > 0 AND funnel_id IN (1, 8) AND pages[-1] LIKE '%chats[%'"),
    }
    for rule in ("bracketed", "with_visits", "plain_id", "inverted", "generic"):
        sql[f"page_name_{rule}"] = f"{_with()} SELECT id AS event_id, {_page(rule)} AS page_name FROM user_event e"
    names = ["funnel", "category", "session", "funnel_session", "screen", "funnel_session_category"]
    for name, keys in zip(names, _SETS, strict=True):
        sql[f"funnel_stats_by_{name}"] = _with(_journeys(), _FILLED) + _stats(keys)
    sql |= {f"{name}_by_day": sql[name] for name in BY_DAY}
    return sql
