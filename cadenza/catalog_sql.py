"""The same results as :mod:`cadenza.catalog`, as plain SQL over the same tables."""

from __future__ import annotations

_TIME = "'%Y-%m-%d %H:%M:%S'"


def _text(ts: str) -> str:
    return f"strftime({ts}, {_TIME})"


def _bucket(length: str, ts: str) -> str:
    return f"time_bucket(INTERVAL '{length}', {ts})"


def _bounds(length: str, ts: str = "ts") -> str:
    start = _bucket(length, ts)
    return (
        f'{_text(start)} AS "windowStart", '
        f"""{_text(f"{start} + INTERVAL '{length}'")} AS "windowEnd\""""
    )


def _stamps(length: str, ts: str = "ts") -> str:
    start = _bucket(length, ts)
    return f"{start} AS window_start, {start} + INTERVAL '{length}' AS window_end"


_PLAYS = """
plays AS (
  SELECT user_id, regexp_extract(props, '([0-9]+)', 1) AS song_id,
         CASE event_type WHEN 'view' THEN 'play' WHEN 'click' THEN 'pause'
                         WHEN 'error' THEN 'skip' ELSE 'other' END AS action,
         date_trunc('second', ts) AS ts
  FROM events WHERE event_type <> 'signup')"""

_SONGS = """
songs AS (
  SELECT CAST(CASE WHEN p_partkey % 10 = 7 THEN p_partkey + 1000000000 ELSE p_partkey END
              AS VARCHAR) AS source_id, p_name, p_type, p_brand, p_size
  FROM part)"""

_MACHINES = """
machines AS (
  SELECT CASE WHEN c_custkey % 11 = 3 THEN c_custkey + 1000000000 ELSE c_custkey END AS mid, r_name AS province, n_name AS city
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_PLACES = """
regions AS (
  SELECT n_nationkey AS place, r_name AS province, n_name AS city,
         'district ' || CAST(n_nationkey % 5 AS VARCHAR) AS district,
         CASE WHEN n_nationkey % 6 <> 0 THEN 'ad' || CAST(n_nationkey AS VARCHAR) END AS adcode
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

_REGIONS = _PLACES.replace(
    "n_nationkey AS place", "CASE WHEN n_nationkey = 7 THEN 407 ELSE n_nationkey END AS place"
)

_LOGINS = """
logins AS (
  SELECT event_id, user_id, user_id % 25 AS place, ts,
         CAST(CAST(100 + user_id % 25 + 0.0001 * (event_id % 4) AS DECIMAL(9,4)) AS VARCHAR) AS lng,
         CAST(CAST(20 + user_id % 25 - 0.0001 * (event_id % 3) AS DECIMAL(9,4)) AS VARCHAR) AS lat
  FROM events WHERE event_type = 'signup')"""

_CHANGES = """
changes AS (
  SELECT *, CASE WHEN o_orderkey % 10 < 6 THEN 'consume_detail'
                 WHEN o_orderkey % 10 < 9 THEN 'machine_info' ELSE 'audit' END AS tbl,
         CASE o_orderstatus WHEN 'O' THEN 'insert' WHEN 'F' THEN 'update' ELSE 'delete' END AS kind,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders WHERE o_orderkey % 13 <> 0)"""

_FEEDBACK_KIND = """
CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'LIKE'
     WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN ' dislike '
     WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'FollowUp'
     WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'CLICK'
     WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'SHARE' ELSE '-' END"""

_RESPONSES = """
responses AS (
  SELECT o_orderkey, o_custkey, o_orderdate AS ts, o_orderpriority AS intent_type,
         'group ' || o_orderstatus AS intent_group,
         CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS ok,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS latency
  FROM orders)"""

_METRIC_SUMS = """
  CAST(sum(n) AS BIGINT) AS "requestCount", CAST(sum(ok) AS BIGINT) AS "successCount",
  CAST(CASE WHEN count(latency) = 0 THEN 0 ELSE sum(latency) // count(latency) END AS BIGINT)
    AS "avgLatencyMs",
  count(*) FILTER (WHERE kind = 'LIKE') AS "likeCount",
  count(*) FILTER (WHERE kind = 'DISLIKE') AS "dislikeCount",
  count(*) FILTER (WHERE kind = 'FOLLOWUP') AS "followupCount",
  count(*) FILTER (WHERE kind = 'CLICK') AS "clickCount\""""

_METRIC_SERVING = (
    _METRIC_SUMS.replace("requestCount", "request_count").replace("successCount", "success_count")
    .replace("avgLatencyMs", "avg_latency_ms").replace("likeCount", "like_count")
    .replace("disLikeCount", "dislike_count").replace("dislikeCount", "dislike_count")
    .replace("followupCount", "followup_count").replace("clickCount", "click_count")
)


def _attributed(request: str, wait: str) -> str:
    """CTEs giving ``attributed``: each feedback row with its response."""
    owner = "JOIN orders ON l_orderkey = o_orderkey" if request == "o_custkey" else ""
    key = "o_custkey" if request == "o_custkey" else "l_orderkey"
    return f"""{_RESPONSES},
feedback AS (
  SELECT row_number() OVER () AS fid, {key} AS request, l_shipdate AS fed_at,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS event_id,
         {_FEEDBACK_KIND} AS raw_kind
  FROM lineitem {owner}),
candidates AS (
  SELECT f.*, r.intent_type, r.intent_group,
         row_number() OVER (PARTITION BY fid ORDER BY
           CASE WHEN r.ts <= f.fed_at THEN 0 ELSE 1 END,
           CASE WHEN r.ts <= f.fed_at THEN r.ts END DESC,
           CASE WHEN r.ts <= f.fed_at THEN CAST(r.o_orderkey AS VARCHAR) END DESC,
           r.ts, CAST(r.o_orderkey AS VARCHAR)) AS pick
  FROM feedback f JOIN responses r ON f.request = r.{request}
  WHERE r.ts <= f.fed_at + INTERVAL '{wait}'),
attributed AS (SELECT * FROM candidates WHERE pick = 1)"""


def _intent_deltas(wait: str) -> str:
    return f"""{_attributed("o_orderkey", wait)},
deltas AS (
  SELECT ts, intent_type, intent_group, 1 AS n, ok, latency, NULL AS kind FROM responses
  UNION ALL
  SELECT fed_at, intent_type, intent_group, 0, 0, NULL, upper(trim(raw_kind)) FROM attributed)"""


_OVERVIEW_DELTAS = f"""{_RESPONSES},
deltas AS (
  SELECT ts, 1 AS n, ok, latency, NULL AS kind FROM responses
  UNION ALL
  SELECT l_shipdate, 0, 0, NULL, upper(trim({_FEEDBACK_KIND})) FROM lineitem)"""


def _song_hot(length: str) -> str:
    return f"""WITH {_PLAYS},{_SONGS}
SELECT song_id AS "songId", p_name AS "songName", count(*) AS "playCount", {_bounds(length)}
FROM plays LEFT JOIN songs ON song_id = source_id WHERE action = 'play'
GROUP BY song_id, p_name, {_bucket(length, "ts")}"""


def _singer_hot(length: str) -> str:
    return f"""WITH {_PLAYS},{_SONGS}
SELECT p_brand AS "singerInfo", count(*) AS "playCount", {_bounds(length)}
FROM plays JOIN songs ON song_id = source_id WHERE action = 'play' AND p_brand <> ''
GROUP BY p_brand, {_bucket(length, "ts")}"""


def _served_songs(length: str) -> str:
    return f"""WITH {_PLAYS},{_SONGS},
served AS (
  SELECT {_stamps(length)}, song_id, p_name AS song_name, count(*) AS play_count
  FROM plays JOIN songs ON song_id = source_id WHERE action = 'play' GROUP BY ALL)"""


def _served_singers(length: str) -> str:
    return f"""WITH {_PLAYS},{_SONGS},
served AS (
  SELECT {_stamps(length)}, p_brand AS singer_info, count(*) AS play_count
  FROM plays JOIN songs ON song_id = source_id WHERE action = 'play' GROUP BY ALL)"""


_TOP_SONGS = f"""{_served_songs("1 day")}
SELECT {_text("window_start")} AS "windowStart", {_text("window_end")} AS "windowEnd",
       song_id AS "songId", song_name AS "songName", play_count AS "playCount"
FROM served WHERE window_end = (SELECT max(window_end) FROM served)
ORDER BY play_count DESC, song_id, song_name LIMIT 10"""

_TOP_SINGERS = f"""{_served_singers("1 day")}
SELECT {_text("window_start")} AS "windowStart", {_text("window_end")} AS "windowEnd",
       singer_info AS "singerInfo", play_count AS "playCount"
FROM served WHERE window_end = (SELECT max(window_end) FROM served)
ORDER BY play_count DESC, singer_info LIMIT 10"""


def _region_login(length: str) -> str:
    start = _bucket(length, "ts")
    return f"""WITH {_REGIONS},{_LOGINS}
SELECT province, city, district, min(adcode) AS adcode,
       count(DISTINCT user_id) AS "loginUserCount", {_bounds(length)}
FROM logins JOIN regions USING (place) GROUP BY province, city, district, {start}"""


def _region_revenue(length: str) -> str:
    start = _bucket(length, "o_orderdate")
    return f"""WITH {_MACHINES}
SELECT province, city, count(*) AS "orderCount",
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS "totalAmount",
       {_bounds(length, "o_orderdate")}
FROM orders JOIN machines ON o_custkey = mid WHERE o_orderstatus = 'O'
GROUP BY province, city, {start}"""


def _clean(where: str) -> str:
    return f"""WITH {_PLAYS}
SELECT user_id AS "userId", song_id AS "songId", user_id AS "machineId", action,
       epoch_us(ts) // 1000 AS "timestamp", '' AS ip, '' AS city,
       strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour
FROM plays {where}"""


_LOGIN_COLUMNS = """
CAST(event_id AS VARCHAR) AS "eventId", user_id AS "userId",
'USER_LOGIN_LOCATION_LOG' AS "eventType", lng, lat, epoch_us(ts) // 1000 AS "loginDt",
user_id AS "machineId", strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour"""

_CALLS = f"""WITH {_PLACES},{_LOGINS},
calls AS (
  SELECT event_id // 10 AS call, CAST(event_id AS VARCHAR) AS event_id,
         lng || ',' || lat AS point, regions.*
  FROM logins JOIN regions USING (place))"""

_DIMENSION = f"""WITH {_CHANGES},
latest AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)
         AS pick
  FROM changes WHERE tbl = 'machine_info')
SELECT CAST(o_custkey AS VARCHAR) AS mid, CAST(cents AS VARCHAR) AS amount,
       {_text("o_orderdate")} AS action_time, '' AS note
FROM latest WHERE pick = 1 AND kind <> 'delete'"""

_NO_INFO = "无信息"

# --- questions ---------------------------------------------------------------

_QUESTIONS = """
phrases AS (
  SELECT ['现在最火的歌手是谁', '现在最火的歌有哪些', '推荐几首周杰伦的歌', '来点适合跑步的',
          '前5首热歌', '天气', 'top100 歌手榜', '0首 热门歌曲'] AS p),
asked AS (
  SELECT conv_id, turn, conv_id * 8 + turn AS t,
         CASE WHEN (conv_id * 8 + turn) % 2 = 0
              THEN p[CAST((conv_id * 8 + turn) % 8 AS BIGINT) + 1] || ' ' || chr(9) || text
              ELSE ' ' || text || p[CAST((conv_id * 8 + turn) % 8 AS BIGINT) + 1] END AS query_text
  FROM conversations, phrases WHERE role = 'user'),
normal AS (
  SELECT *, regexp_replace(query_text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS q FROM asked),
singers AS (
  SELECT *, nullif(regexp_extract(q,
    '(?:推荐|来几首|来点|想听)(?:几首|一些|点)?([\\p{Han}A-Za-z0-9·]{2,12})的(?:经典歌|歌|歌曲)', 1), '')
    AS singer,
    nullif(regexp_extract(q, '(?:前|top)?[ \\t\\n\\x0B\\f\\r]*([0-9]{1,2})[ \\t\\n\\x0B\\f\\r]*(?:首|个|位|名)?', 1), '')
    AS digits
  FROM normal),
classified AS (
  SELECT *,
    CASE WHEN regexp_matches(q, '热门歌手|歌手榜|最火歌手|最热歌手|最火的歌手|最热的歌手')
         THEN 'HOT_SINGER_QUERY'
         WHEN regexp_matches(q, '热门歌曲|最火的歌|热歌|歌曲榜|热门歌|最热的歌') THEN 'HOT_SONG_QUERY'
         WHEN regexp_matches(q, '推荐|来几首|经典歌|好听的歌|想听|来点')
         THEN CASE WHEN singer IS NOT NULL THEN 'SINGER_RECOMMEND' ELSE 'SCENARIO_RECOMMEND' END
         ELSE 'OTHER' END AS intent,
    least(greatest(coalesce(CAST(digits AS INTEGER), 3), 1), 10) AS row_limit
  FROM singers)"""

_GROUP = "CASE WHEN intent IN ('SINGER_RECOMMEND', 'SCENARIO_RECOMMEND') THEN 'RECOMMEND' ELSE 'DATA_QA' END"

_ANSWERED = f"""{_served_songs("1 day").replace("served AS", "served_songs AS")},
served_singers AS (
  SELECT {_stamps("1 day")}, p_brand AS singer_info, count(*) AS play_count
  FROM plays JOIN songs ON song_id = source_id WHERE action = 'play' GROUP BY ALL),
song_board AS (
  SELECT *, row_number() OVER (ORDER BY play_count DESC, song_id, song_name) AS rank
  FROM served_songs WHERE window_end = (SELECT max(window_end) FROM served_songs)),
singer_board AS (
  SELECT *, row_number() OVER (ORDER BY play_count DESC, singer_info) AS rank
  FROM served_singers WHERE window_end = (SELECT max(window_end) FROM served_singers)),
song_lists AS (
  SELECT l.n, count(*) AS c, string_agg('《' || song_name || '》', '、' ORDER BY rank) AS names,
         '["' || string_agg(song_id, '","' ORDER BY rank) || '"]' AS ids,
         min(song_id) FILTER (WHERE rank = 1) AS first_id
  FROM range(1, 11) l(n) JOIN song_board ON rank <= l.n GROUP BY l.n),
singer_lists AS (
  SELECT l.n, count(*) AS c, string_agg(singer_info, '、' ORDER BY rank) AS names,
         '["' || string_agg(singer_info, '","' ORDER BY rank) || '"]' AS ids,
         min(singer_info) FILTER (WHERE rank = 1) AS first_id
  FROM range(1, 11) l(n) JOIN singer_board ON rank <= l.n GROUP BY l.n),
{_QUESTIONS},
answered AS (
  SELECT classified.*, s.c AS song_c, s.ids AS song_ids, s.names AS song_names,
         s.first_id AS first_song, g.c AS singer_c, g.ids AS singer_ids, g.names AS singer_names,
         g.first_id AS first_singer
  FROM classified LEFT JOIN song_lists s ON s.n = row_limit LEFT JOIN singer_lists g ON g.n = row_limit)"""

_ANSWER_TEXT = """
CASE intent
  WHEN 'HOT_SONG_QUERY'
  THEN '当前最热门的' || CAST(song_c AS VARCHAR) || '首歌曲是：' || song_names || '。'
  WHEN 'HOT_SINGER_QUERY'
  THEN '当前最热门的' || CAST(singer_c AS VARCHAR) || '位歌手是：' || singer_names || '。'
  WHEN 'SINGER_RECOMMEND'
  THEN '第一版歌手推荐还没接真实推荐源。我已经识别到你想听的是“' || singer ||
       '”，你可以先问我“现在最火的歌有哪些”或“现在最火的歌手是谁”。'
  WHEN 'SCENARIO_RECOMMEND'
  THEN '第一版场景推荐还没接真实推荐结果，你可以先问我“现在最火的歌有哪些”或“现在最火的歌手是谁”。'
  ELSE '这个问题我第一版还不支持。你可以先问我热门歌曲、热门歌手，或者让我给你做推荐类问题的占位识别。' END"""

_ENVELOPES = """
turns AS (
  SELECT *, conv_id * 8 + turn AS t,
         CASE role WHEN 'user' THEN 'query' WHEN 'assistant' THEN 'response' ELSE 'unknown' END AS r
  FROM conversations),
checked AS (
  SELECT *, CASE WHEN t % 19 = 0 THEN 'unknown' ELSE r END AS route,
    CASE WHEN t % 19 = 0 OR t % 11 = 0 OR t % 13 = 0 OR (t % 5 <> 0 AND t % 7 = 0)
         THEN 'invalid envelope'
         WHEN r = 'unknown' THEN 'unknown event type'
         WHEN t % 17 = 0 THEN 'bad user id' END AS reason
  FROM turns)"""


def oracles() -> dict[str, str]:
    """Query name -> SQL, of all queries."""
    from cadenza import catalog_stores, catalog_streams

    return plain_oracles() | catalog_stores.SQL | catalog_streams.SQL


def plain_oracles() -> dict[str, str]:
    """Query name -> SQL, of the queries in :mod:`cadenza.catalog` itself."""
    return {
        "ods_decode_roundtrip": """
SELECT event_id // 50 AS message_id,
  CASE WHEN event_type = 'signup' THEN 'USER_LOGIN_LOCATION_LOG'
       ELSE 'MINIK_CLIENT_SONG_PLAY_OPERATE_REQ' END AS event_type,
  CASE WHEN event_type <> 'signup'
       THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR) END AS ts_text,
  CASE WHEN event_type <> 'signup' THEN regexp_extract(props, '([0-9]+)', 1) END AS song_id,
  CAST(user_id AS VARCHAR) AS uid_text,
  CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) END AS login_id
FROM events""",
        "user_log_clean": _clean(""),
        "user_log_other": _clean("WHERE action <> 'play'"),
        "user_log_route_counts": f"""WITH {_PLAYS}
SELECT action AS route, count(*) AS n, CAST(0 AS BIGINT) AS rejected FROM plays GROUP BY action
UNION ALL
SELECT 'login_location', count(*), 0 FROM events WHERE event_type = 'signup'""",
        "user_log_quarantine": """
SELECT conv_id, turn, 'unknown' AS route, 'invalid event' AS reason FROM conversations""",
        "login_events": f"WITH {_LOGINS} SELECT {_LOGIN_COLUMNS} FROM logins",
        "song_play_wide": f"""WITH {_PLAYS},{_SONGS}
SELECT user_id AS "userId", song_id AS "songId", user_id AS "machineId", action,
       epoch_us(ts) // 1000 AS "timestamp", '' AS ip, '' AS city,
       strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour,
       p_name AS "songName", p_type AS album, p_brand AS "singerInfo",
       CAST(p_size AS VARCHAR) AS "postTime", p_type AS "authorizedCompany"
FROM plays LEFT JOIN songs ON song_id = source_id""",
        "song_hot_10s": _song_hot("10 seconds"),
        "song_hot_1h": _song_hot("1 hour"),
        "song_hot_wide_1h": _song_hot("1 hour"),
        "song_hot_from_ods_1h": _song_hot("1 hour"),
        "singer_hot_10s": _singer_hot("10 seconds"),
        "singer_hot_1h": _singer_hot("1 hour"),
        "singer_hot_wide_1h": _singer_hot("1 hour"),
        "dm_song_hot_10s": f"{_served_songs('10 seconds')} SELECT * FROM served",
        "dm_singer_hot_10s": f"{_served_singers('10 seconds')} SELECT * FROM served",
        "song_hot_latest_top10": _TOP_SONGS,
        "singer_hot_latest_top10": _TOP_SINGERS,
        "serving_top_songs": _TOP_SONGS,
        "serving_top_singers": _TOP_SINGERS,
        "serving_window_text": f"""{_served_songs("1 day")}
SELECT {_text("window_start")} AS window_start, {_text("window_end")} AS window_end,
       song_id, song_name, play_count FROM served""",
        "geo_region_enrich": f"""WITH {_REGIONS},{_LOGINS}
SELECT {_LOGIN_COLUMNS}, province, city, district, adcode
FROM logins LEFT JOIN regions USING (place)""",
        "region_login_10s": _region_login("10 seconds"),
        "region_login_1h": _region_login("1 hour"),
        "region_login_wide_1d": _region_login("1 day"),
        "dm_region_user_login_1h": f"""WITH {_REGIONS},{_LOGINS}
SELECT {_stamps("1 hour")}, province, city, district, min(adcode) AS adcode,
       count(DISTINCT user_id) AS login_user_count
FROM logins JOIN regions USING (place)
GROUP BY province, city, district, {_bucket("1 hour", "ts")} HAVING min(adcode) IS NOT NULL""",
        "machine_consume_wide": f"""WITH {_CHANGES},{_MACHINES}
SELECT o_orderkey AS id, o_custkey AS mid, CAST(NULL AS BIGINT) AS uid, cents AS amount,
       CAST(NULL AS INTEGER) AS "pkgId", CAST(NULL AS VARCHAR) AS "pkgName",
       CAST(NULL AS INTEGER) AS "activityId", CAST(NULL AS VARCHAR) AS "activityName",
       {_text("o_orderdate")} AS "actionTime", CAST(NULL AS VARCHAR) AS "billDate", province, city
FROM changes LEFT JOIN machines ON o_custkey = mid
WHERE tbl = 'consume_detail' AND kind = 'insert'""",
        "region_revenue_1d": _region_revenue("1 day"),
        "region_revenue_wide_1d": _region_revenue("1 day"),
        "dm_region_revenue_10s": f"""WITH {_MACHINES}
SELECT {_stamps("10 seconds", "o_orderdate")}, province, city, count(*) AS order_count,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_amount
FROM orders JOIN machines ON o_custkey = mid WHERE o_orderstatus = 'O'
GROUP BY province, city, {_bucket("10 seconds", "o_orderdate")}""",
        "geocode_answers": f"""{_CALLS}
SELECT call, point, replace(province, ' ', '') || 'x' AS province,
       CASE WHEN place % 4 = 0 THEN ' ' || province || ' x ' ELSE city END AS city,
       district, adcode
FROM calls WHERE call % 9 <> 0""",
        "geocode_batch_keys": f"""{_CALLS}
SELECT call, string_agg(point, '|' ORDER BY event_id) AS locations FROM calls GROUP BY call""",
        "geocode_resolver": f"""WITH {_LOGINS}
SELECT {_LOGIN_COLUMNS}, 'province' || CAST(20 + place AS VARCHAR) AS province,
       CASE WHEN place % 2 = 1 THEN 'province ' || CAST(20 + place AS VARCHAR)
            ELSE 'city ' || CAST(100 + place AS VARCHAR) END AS city,
       'd' AS district, CAST(100 + place AS VARCHAR) AS adcode
FROM logins""",
        "cdc_latest_state": f"""
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)
         AS pick FROM orders)
SELECT o_custkey AS mid, o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
       {_text("o_orderdate")} AS "actionTime"
FROM latest WHERE pick = 1 AND o_orderstatus <> 'P'""",
        "cdc_route_counts": f"""WITH {_CHANGES}
SELECT CASE tbl WHEN 'consume_detail' THEN 'dwd_machine_consume_detail_rt'
                ELSE 'dwd_dim_info_rt' END AS sink_topic,
       tbl AS "table", kind AS type, count(*) AS n
FROM changes WHERE tbl <> 'audit' GROUP BY tbl, kind""",
        "cdc_topic_rows": f"""WITH {_CHANGES}
SELECT CASE tbl WHEN 'consume_detail' THEN 'dwd_machine_consume_detail_rt'
                ELSE 'dwd_dim_info_rt' END AS topic,
       CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS mid,
       CAST(cents AS VARCHAR) AS amount, kind AS type,
       CASE tbl WHEN 'consume_detail' THEN 'id' ELSE 'mid' END AS pk_col,
       CASE tbl WHEN 'consume_detail' THEN 'FACT_CONSUME' ELSE 'DIM_MACHINE_LOCAL_INFO' END
         AS phoenix_table_name
FROM changes WHERE tbl <> 'audit'""",
        "cdc_dimension_rows": _DIMENSION,
        "cdc_apply_in_two_steps": _DIMENSION,
        "cdc_schema_changes": """
SELECT o_orderkey, 'no row data' AS reason FROM orders WHERE o_orderkey % 13 = 0""",
        "dim_clean": f"""
SELECT p_partkey,
  CASE p_partkey % 6 WHEN 0 THEN p_brand WHEN 1 THEN p_brand WHEN 2 THEN '{_NO_INFO}'
    WHEN 3 THEN '{_NO_INFO}' WHEN 4 THEN '[x]' ELSE 'spaced' END AS singer_info,
  CASE WHEN p_partkey % 6 = 2 THEN '{_NO_INFO}' ELSE p_name END AS album,
  CASE WHEN p_partkey % 6 = 3 THEN '{_NO_INFO}' ELSE p_type END AS authorized_company,
  CASE WHEN p_type = 'ECONOMY' THEN '{_NO_INFO}' ELSE p_type END AS other_value
FROM part""",
        "ai_validate_counts": f"""WITH {_ENVELOPES}
SELECT route, coalesce(reason, 'ok') AS status, count(*) AS n FROM checked GROUP BY ALL""",
        "ai_query_branch": f"""WITH {_ENVELOPES}
SELECT CAST(t AS VARCHAR) AS "eventId", CAST(conv_id AS VARCHAR) AS "requestId",
       's' || CAST(conv_id AS VARCHAR) AS "sessionId", conv_id AS "userId", text AS "queryText"
FROM checked WHERE route = 'query' AND reason IS NULL""",
        "ai_response_wide": """
WITH lists AS (
  SELECT *, CAST(o_orderkey % 4 AS INTEGER) AS c,
         CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END AS names
  FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS "requestId", o_custkey AS "userId",
  o_orderpriority AS "intentType", 'group ' || o_orderstatus AS "intentGroup",
  CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS success,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS "latencyMs",
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "responseTime",
  CASE c WHEN 1 THEN '["' || (o_custkey + 1) || '"]'
         WHEN 2 THEN '["' || (o_custkey + 1) || '","' || (o_custkey + 2) || '"]'
         WHEN 3 THEN '["' || (o_custkey + 1) || '","' || (o_custkey + 2) || '","'
                     || (o_custkey + 3) || '"]' END AS "resultSongIds",
  c AS "resultSongCount", names AS "resultSingerCount",
  c > 0 AS "hasSongResult", names > 0 AS "hasSingerResult",
  CASE WHEN c > 0 THEN CAST(o_custkey + 1 AS VARCHAR) END AS "firstSongId",
  CASE WHEN names > 0 THEN o_orderpriority END AS "firstSingerName"
FROM lists""",
        "ai_overview_1d": f"""WITH {_OVERVIEW_DELTAS}
SELECT {_bounds("1 day")}, {_METRIC_SUMS}
FROM deltas GROUP BY {_bucket("1 day", "ts")}""",
        "dm_ai_overview_10s": f"""WITH {_OVERVIEW_DELTAS}
SELECT {_stamps("10 seconds")}, {_METRIC_SERVING}
FROM deltas GROUP BY {_bucket("10 seconds", "ts")}""",
        "ai_intent_1d": f"""WITH {_intent_deltas("60 days")}
SELECT {_bounds("1 day")}, intent_type AS "intentType", intent_group AS "intentGroup",
       {_METRIC_SUMS}
FROM deltas GROUP BY intent_type, intent_group, {_bucket("1 day", "ts")}""",
        "dm_ai_intent_10s": f"""WITH {_intent_deltas("60 minutes")}
SELECT {_stamps("10 seconds")}, intent_type, intent_group, {_METRIC_SERVING}
FROM deltas GROUP BY intent_type, intent_group, {_bucket("10 seconds", "ts")}""",
        "feedback_attribution": f"""WITH {_attributed("o_custkey", "60 days")}
SELECT CAST(request AS VARCHAR) AS "requestId", event_id AS "eventId",
       {_text("fed_at")} AS "feedbackTime", raw_kind AS "feedbackType",
       intent_type AS "intentType", intent_group AS "intentGroup"
FROM attributed""",
        "stream_song_hot_10s": f"""WITH {_PLAYS},{_SONGS}
SELECT song_id AS "songId", p_name AS "songName", count(*) AS "playCount",
       {_bounds("10 seconds")}
FROM plays LEFT JOIN songs ON song_id = source_id WHERE action = 'play'
GROUP BY song_id, p_name, {_bucket("10 seconds", "ts")}""",
        "stream_region_login_1h": _region_login("1 hour"),
        "stream_ai_overview_1d": f"""WITH {_OVERVIEW_DELTAS}
SELECT {_bounds("1 day")}, {_METRIC_SUMS}
FROM deltas GROUP BY {_bucket("1 day", "ts")}""",
        "stream_feedback_attribution": f"""WITH {_attributed("o_custkey", "60 days")}
SELECT CAST(request AS VARCHAR) AS "requestId", {_text("fed_at")} AS "feedbackTime",
       raw_kind AS "feedbackType", intent_type AS "intentType", intent_group AS "intentGroup",
       count(*) AS times
FROM attributed GROUP BY ALL""",
        "request_validation": """
SELECT conv_id, turn,
  CASE WHEN conv_id % 7 = 0 THEN 'userId 不能为空'
       WHEN role <> 'user' THEN 'queryText 不能为空' END AS query_reason,
  CASE WHEN turn % 3 = 0 THEN 'requestId 不能为空' WHEN turn = 1 THEN 'sessionId 不能为空'
       WHEN conv_id % 7 = 0 THEN 'userId 不能为空' END AS feedback_reason
FROM conversations""",
        "intent_classify": f"""WITH {_QUESTIONS}
SELECT conv_id, turn, intent AS "intentType", {_GROUP} AS "intentGroup", row_limit AS "rowLimit",
       CASE WHEN intent = 'SINGER_RECOMMEND' THEN singer END AS "singerName"
FROM classified""",
        "hot_answers": f"""{_ANSWERED}
SELECT conv_id, turn, intent AS "intentType", {_ANSWER_TEXT} AS "answerText",
       intent IN ('HOT_SONG_QUERY', 'HOT_SINGER_QUERY') AS success, 'RULE' AS "responseSource",
       CASE WHEN intent = 'HOT_SONG_QUERY' THEN song_ids ELSE '[]' END AS song_ids,
       CASE WHEN intent = 'HOT_SINGER_QUERY' THEN singer_ids ELSE '[]' END AS singer_names
FROM answered""",
        "ods_envelopes": f"""WITH {_QUESTIONS}
SELECT md5(conv_id || '-' || turn) AS "eventId", 'AI_QUERY' AS "eventType",
       '2024-01-01 00:00:00' AS "eventTime", 'r-' || conv_id || '-' || turn AS "requestId",
       CASE WHEN t % 3 <> 0 THEN 's' || conv_id ELSE md5(conv_id || '-' || turn) END AS "sessionId",
       CAST(conv_id AS VARCHAR) AS "userId", query_text AS "queryText", intent AS "intentType",
       {_GROUP} AS "intentGroup", '2024-01-01 00:00:00' AS "queryTime"
FROM classified""",
        "ods_response_envelopes": f"""{_ANSWERED}
SELECT 'r-' || conv_id || '-' || turn AS "requestId", intent AS "intentType",
       intent IN ('HOT_SONG_QUERY', 'HOT_SINGER_QUERY') AS success,
       'mock-rule-v1' AS "modelName", 'tpl_music_001' AS "promptTemplateId",
       CAST(CASE WHEN intent = 'HOT_SONG_QUERY' THEN song_c ELSE 0 END AS INTEGER)
         AS "resultSongCount",
       CAST(CASE WHEN intent = 'HOT_SINGER_QUERY' THEN singer_c ELSE 0 END AS INTEGER)
         AS "resultSingerCount",
       CASE WHEN intent = 'HOT_SONG_QUERY' THEN first_song END AS "firstSongId",
       CASE WHEN intent = 'HOT_SINGER_QUERY' THEN first_singer END AS "firstSingerName"
FROM answered""",
    }
