"""Derive a raw game-event collection from the driver's generic ``events`` table.

The surveyed jobs read a wide collection of mobile-game events that the test data does
not contain, so this adapter maps each ``events`` row to one game event with the rules
of ``FIXTURES.md`` section 4. It is a plain projection (no shuffle), so it scales with
``events`` and everything downstream reads data Spark derives from the given table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import TimestampNTZType

from .schemas import EVENT_SCHEMA

# Adapter constants (FIXTURES.md section 4).
SLOT_MS = 21_600_000            # events are cut to 6-hour slots
MONTH_SHIFT_MS = 2_678_400_000  # every third event moves 31 days on
TIMEZONES_BY_K6 = (None, "+02.00", "-05:00", "+05.30", "+00:00", "-03.00")
GAMES = ("GAME_A", "GAME_B")


_LEVEL = "(etype = 'click' OR (etype = 'purchase' AND k % 2 = 0))"
_AD = "(etype = 'view' OR (etype = 'click' AND k % 4 = 1))"
_PURCHASE = "(etype = 'purchase')"

# One SQL expression per raw-event field (FIXTURES.md section 4), over the columns
# eventId, etype, uid, value, k (props number), day (epoch day), h (UTC hour), millis.
_RULES = {
    "userId": "CASE WHEN k = 99 THEN NULL WHEN k % 5 = 0 THEN concat(' u', uid, ' ') ELSE concat('u', uid) END",
    "gameId": f"CASE WHEN uid % 4 = 0 THEN '{GAMES[1]}' ELSE '{GAMES[0]}' END",
    "attribution": ("CASE WHEN etype = 'signup' AND uid % 7 <> 0 "
                    "THEN CASE WHEN uid % 3 = 0 THEN 'organic' ELSE 'paid_ads' END END"),
    "action": "CASE WHEN etype = 'signup' THEN CASE WHEN k % 10 = 9 THEN 'LOGIN' ELSE 'SIGN_UP' END END",
    "timestamp": (f"day * 86400000 + CAST(h / 6 AS BIGINT) * {SLOT_MS} "
                  f"+ CASE WHEN eventId % 3 = 0 THEN {MONTH_SHIFT_MS} ELSE 0 END"),
    "timezone": "CASE k % 6 " + " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(TIMEZONES_BY_K6) if z)
                + " END",
    "levelId": f"CASE WHEN {_LEVEL} THEN concat('L', k % 20) END",
    "levelDifficulty": f"CASE WHEN {_LEVEL} THEN 'easy' END",
    "levelProgress": f"CASE WHEN {_LEVEL} THEN '50' END",
    "status": ("CASE etype "
               "WHEN 'click' THEN CASE WHEN k % 4 = 1 THEN 'WATCHED' WHEN k % 3 = 0 THEN 'STARTED' ELSE 'COMPLETED' END "
               "WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'WATCHED' WHEN 1 THEN 'IGNORED' ELSE 'PROPOSED' END "
               "WHEN 'purchase' THEN CASE k % 3 WHEN 0 THEN 'DONE' WHEN 1 THEN 'REJECTED' ELSE 'CANCELED' END END"),
    "placementId": f"CASE WHEN {_AD} THEN 'top' END",
    "adType": f"CASE WHEN {_AD} THEN CASE WHEN k % 2 = 0 THEN 'rewarded' ELSE 'banner' END END",
    "itemId": f"CASE WHEN {_PURCHASE} THEN concat('I', k % 7) END",
    "category": f"CASE WHEN {_PURCHASE} THEN 'coins' END",
    "amount": f"CASE WHEN {_PURCHASE} THEN value END",
    "currency": f"CASE WHEN {_PURCHASE} THEN 'USD' END",
}


def _time_parts(is_ntz: bool) -> list[str]:
    """Epoch day, UTC hour and epoch ms of ``ts``, with no session time zone involved:
    calendar parts of a TIMESTAMP_NTZ, or arithmetic on the instant of a TIMESTAMP."""
    if is_ntz:
        return ["CAST(unix_date(to_date(ts)) AS BIGINT) AS day", "CAST(hour(ts) AS BIGINT) AS h",
                "CAST(unix_date(to_date(ts)) AS BIGINT) * 86400000 + hour(ts) * 3600000 + minute(ts) * 60000"
                " + CAST(floor(date_part('SECOND', ts) * 1000) AS BIGINT) AS millis"]
    return ["CAST(floor(unix_micros(ts) / 86400000000) AS BIGINT) AS day",
            "CAST(pmod(floor(unix_micros(ts) / 3600000000), 24) AS BIGINT) AS h",
            "CAST(floor(unix_micros(ts) / 1000) AS BIGINT) AS millis"]


def game_events(events: DataFrame, slotted: bool = True) -> DataFrame:
    """``events`` -> raw game events with ``EVENT_SCHEMA`` columns (+ ``eventId``).

    ``slotted=False`` keeps the original instant of each event (epoch ms of ``ts``,
    no slots, no month shift); used to check the time functions on every hour.
    """
    is_ntz = isinstance(events.schema["ts"].dataType, TimestampNTZType)
    base = events.selectExpr("event_id AS eventId", "event_type AS etype", "user_id AS uid", "value",
                             "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k", *_time_parts(is_ntz))
    rules = dict(_RULES)
    if not slotted:
        rules["timestamp"] = "millis"
    return base.selectExpr("eventId", *[f"CAST({rules[f.name]} AS {f.dataType.simpleString()}) AS `{f.name}`"
                                        for f in EVENT_SCHEMA.fields])


def load_game_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw game events derived from ``{sf_dir}/events.parquet``."""
    return game_events(spark.read.parquet(f"{str(sf_dir).rstrip('/')}/events.parquet"))
