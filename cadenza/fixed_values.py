"""Names, words, patterns and texts that results depend on."""

# --- fixed values: event types of the raw user log --------------------------
SONG_EVENT = "MINIK_CLIENT_SONG_PLAY_OPERATE_REQ"
LOGIN_EVENT = "USER_LOGIN_LOCATION_LOG"

# --- fixed values: event types of the assistant log -------------------------
AI_QUERY = "AI_QUERY"
AI_RESPONSE = "AI_RESPONSE"
AI_FEEDBACK = "AI_FEEDBACK"

# --- fixed values: change-log operation types -------------------------------
UPSERT_TYPES = ("insert", "update", "bootstrap-insert")
DELETE_TYPE = "delete"

# --- fixed values: text formats and the placeholder for missing text --------
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_FORMAT = "yyyy-MM-dd"
HOUR_FORMAT = "HH"
NO_INFO = "无信息"

# --- fixed values: window length, watermark delay, waits, batch sizes -------
WINDOW_LENGTH = "10 seconds"
WATERMARK_DELAY = "3 seconds"
PENDING_FEEDBACK_MINUTES = 60
GEOCODE_BATCH_SIZE = 10
JDBC_BATCH_SIZE = 100
BOARD_SIZE = 10

# --- fixed values: limits named in a question -------------------------------
DEFAULT_ANSWER_ROWS = 3
MIN_ANSWER_ROWS = 1
MAX_ANSWER_ROWS = 10
LIMIT_PATTERN = r"(?:前|top)?\s*(\d{1,2})\s*(?:首|个|位|名)?"
SINGER_PATTERN = (
    r"(?:推荐|来几首|来点|想听)(?:几首|一些|点)?"
    r"([\p{IsHan}A-Za-z0-9·]{2,12})的(?:经典歌|歌|歌曲)"
)

# --- fixed values: question keywords, tried in this order -------------------
HOT_SINGER_WORDS = ("热门歌手", "歌手榜", "最火歌手", "最热歌手", "最火的歌手", "最热的歌手")
HOT_SONG_WORDS = ("热门歌曲", "最火的歌", "热歌", "歌曲榜", "热门歌", "最热的歌")
RECOMMEND_WORDS = ("推荐", "来几首", "经典歌", "好听的歌", "想听", "来点")

# --- fixed values: intents and their groups ---------------------------------
HOT_SINGER_QUERY = "HOT_SINGER_QUERY"
HOT_SONG_QUERY = "HOT_SONG_QUERY"
SINGER_RECOMMEND = "SINGER_RECOMMEND"
SCENARIO_RECOMMEND = "SCENARIO_RECOMMEND"
OTHER_INTENT = "OTHER"
DATA_QA = "DATA_QA"
RECOMMEND = "RECOMMEND"

# --- fixed values: answer texts ---------------------------------------------
HOT_SONG_ANSWER = ("当前最热门的", "首歌曲是：", "。")
HOT_SINGER_ANSWER = ("当前最热门的", "位歌手是：", "。")
SONG_QUOTES = ("《", "》")
LIST_SEPARATOR = "、"
NO_SONG_BOARD = "当前还没有可用的热门歌曲数据，请先确认 DWS / DM 链路是否已经产出最新结果。"
NO_SINGER_BOARD = "当前还没有可用的热门歌手数据，请先确认 DWS / DM 链路是否已经产出最新结果。"
SINGER_UNSUPPORTED = (
    "第一版歌手推荐还没接真实推荐源。我已经识别到你想听的是“",
    "”，你可以先问我“现在最火的歌有哪些”或“现在最火的歌手是谁”。",
)
SINGER_UNSUPPORTED_NO_NAME = (
    "第一版歌手推荐还没接真实推荐源，你可以先问我“现在最火的歌有哪些”或“现在最火的歌手是谁”。"
)
SCENARIO_UNSUPPORTED = (
    "第一版场景推荐还没接真实推荐结果，你可以先问我“现在最火的歌有哪些”或“现在最火的歌手是谁”。"
)
OTHER_UNSUPPORTED = (
    "这个问题我第一版还不支持。你可以先问我热门歌曲、热门歌手，或者让我给你做推荐类问题的占位识别。"
)
RESPONSE_SOURCE = "RULE"
MODEL_NAME = "mock-rule-v1"
PROMPT_TEMPLATE_ID = "tpl_music_001"

# --- fixed values: request rejection reasons --------------------------------
MUST_NOT_BE_EMPTY = " 不能为空"

# --- fixed values: geocoder answer codes ------------------------------------
GEOCODE_OK_STATUS = "1"
GEOCODE_OK_INFOCODE = "10000"
EMPTY_LIST_TEXT = "[]"

# --- fixed values: topic names of the layers --------------------------------
TOPICS = {
    "ods_user_log": "ods_log_userlog",
    "ods_assistant": "ods_log_ai_assistant",
    "ods_changes": "ods_db_business_data",
    "dwd_play": "dwd_user_playsong_rt",
    "dwd_login": "dwd_user_login_location_info_rt",
    "dwd_other": "dwd_other_userlog_rt",
    "dwd_dimension": "dwd_dim_info_rt",
    "dwd_consume": "dwd_machine_consume_detail_rt",
    "dwd_ai_query": "dwd_ai_query_rt",
    "dwd_ai_response": "dwd_ai_response_rt",
    "dwd_ai_feedback": "dwd_ai_feedback_rt",
    "dwm_song_play": "dwm_song_play_wide_rt",
    "dwm_login": "dwm_user_login_location_wide_rt",
    "dwm_consume": "dwm_machine_consume_wide_rt",
    "dwm_ai_response": "dwm_ai_response_wide_rt",
    "dws_song_hot": "dws_song_hot_rt",
    "dws_singer_hot": "dws_singer_hot_rt",
    "dws_region_login": "dws_region_user_login_rt",
    "dws_region_revenue": "dws_region_revenue_rt",
    "dws_ai_overview": "dws_ai_overview_rt",
    "dws_ai_intent": "dws_ai_intent_rt",
}
