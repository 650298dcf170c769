"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code and in the *per-family* shape of the batch jobs
(three family aggregates left-joined to levels, loops turned into plain SQL), so a
match checks the single-pass Spark plans against the original definition. Every query
starts from the pre-registered ``events`` view through the adapter CTEs below.
Conventions for value hashing: doubles rounded to 6 places, sums cast to BIGINT,
DuckDB's ``dayofweek`` shifted to 1 = Sunday.
"""

from __future__ import annotations

from ..functions import time as T
from . import catalog as C
from . import oracle_models as M

# Adapter of FIXTURES.md section 4 (events -> raw game events), then the sources.
_LEVEL = "(event_type = 'click' OR (event_type = 'purchase' AND k % 2 = 0))"
_AD = "(event_type = 'view' OR (event_type = 'click' AND k % 4 = 1))"
_PUR = "(event_type = 'purchase')"

BASE = f"""
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events
),
raw_events AS (
  SELECT event_id AS eventId,
    CASE WHEN k = 99 THEN NULL WHEN k % 5 = 0 THEN concat(' u', user_id, ' ')
         ELSE concat('u', user_id) END AS userId,
    CASE WHEN user_id % 4 = 0 THEN 'GAME_B' ELSE 'GAME_A' END AS gameId,
    CASE WHEN event_type = 'signup' AND user_id % 7 <> 0
         THEN CASE WHEN user_id % 3 = 0 THEN 'organic' ELSE 'paid_ads' END END AS attribution,
    CASE WHEN event_type = 'signup' THEN CASE WHEN k % 10 = 9 THEN 'LOGIN' ELSE 'SIGN_UP' END END AS action,
    epoch_ms(CAST(date_trunc('day', ts) AS TIMESTAMP)) + CAST(floor(hour(ts) / 6) AS BIGINT) * 21600000
      + CASE WHEN event_id % 3 = 0 THEN 2678400000 ELSE 0 END AS "timestamp",
    CASE k % 6 WHEN 1 THEN '+02.00' WHEN 2 THEN '-05:00' WHEN 3 THEN '+05.30'
               WHEN 4 THEN '+00:00' WHEN 5 THEN '-03.00' END AS timezone,
    CASE WHEN {_LEVEL} THEN concat('L', k % 20) END AS levelId,
    CASE WHEN {_LEVEL} THEN 'easy' END AS levelDifficulty,
    CASE WHEN {_LEVEL} THEN '50' END AS levelProgress,
    CASE event_type
      WHEN 'click' THEN CASE WHEN k % 4 = 1 THEN 'WATCHED' WHEN k % 3 = 0 THEN 'STARTED' ELSE 'COMPLETED' END
      WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'WATCHED' WHEN 1 THEN 'IGNORED' ELSE 'PROPOSED' END
      WHEN 'purchase' THEN CASE k % 3 WHEN 0 THEN 'DONE' WHEN 1 THEN 'REJECTED' ELSE 'CANCELED' END
    END AS status,
    CASE WHEN {_AD} THEN 'top' END AS placementId,
    CASE WHEN {_AD} THEN CASE WHEN k % 2 = 0 THEN 'rewarded' ELSE 'banner' END END AS adType,
    CASE WHEN {_PUR} THEN concat('I', k % 7) END AS itemId,
    CASE WHEN {_PUR} THEN 'coins' END AS category,
    CASE WHEN {_PUR} THEN value END AS amount,
    CASE WHEN {_PUR} THEN 'USD' END AS currency
  FROM ev
),
player_info AS (
  SELECT userId, gameId, attribution, action, "timestamp", timezone,
         CAST(epoch_ms("timestamp") AS DATE) AS date
  FROM raw_events WHERE attribution IS NOT NULL
),
behavior0 AS (
  SELECT userId, gameId, levelId, levelDifficulty, levelProgress, status, "timestamp",
         coalesce(replace(timezone, '.', ':'), '+00:00') AS timezone,
         placementId, adType, itemId, category, amount, currency,
         epoch_ms("timestamp") AS dt, CAST(epoch_ms("timestamp") AS DATE) AS date
  FROM raw_events
  WHERE (levelId IS NOT NULL OR adType IS NOT NULL OR amount IS NOT NULL)
    AND "timestamp" IS NOT NULL
),
behavior AS (
  SELECT *,
    CAST(hour(dt + to_minutes(CAST(
      (CASE WHEN timezone LIKE '-%' THEN -1 ELSE 1 END)
      * (CAST(substr(timezone, 2, 2) AS INTEGER) * 60 + CAST(substr(timezone, 5, 2) AS INTEGER))
      AS BIGINT))) AS INTEGER) AS hourOfDay
  FROM behavior0
),
players AS (
  SELECT trim(userId) AS userId, trim(gameId) AS gameId, trim(attribution) AS attribution,
         trim(action) AS action, date
  FROM player_info
),
levels AS (
  SELECT trim(userId) AS userId, trim(gameId) AS gameId, trim(levelId) AS levelId,
         levelDifficulty, levelProgress, trim(status) AS status, timezone, hourOfDay, date
  FROM behavior WHERE levelId IS NOT NULL
),
ads AS (
  SELECT trim(userId) AS userId, trim(gameId) AS gameId, placementId, trim(adType) AS adType,
         trim(status) AS status, timezone, hourOfDay, date
  FROM behavior WHERE adType IS NOT NULL
),
purchases AS (
  SELECT trim(userId) AS userId, trim(gameId) AS gameId, trim(itemId) AS itemId,
         trim(category) AS category, amount, trim(currency) AS currency, trim(status) AS status,
         timezone, hourOfDay, date
  FROM behavior WHERE amount IS NOT NULL
),
reg AS (
  SELECT userId, gameId, max(CASE WHEN attribution = 'organic' THEN 1 ELSE 0 END) AS flagOrganic,
         min(date) AS dateRegistration
  FROM players WHERE action = 'SIGN_UP' GROUP BY userId, gameId
),
lv AS (
  SELECT userId, gameId, date, hourOfDay,
    CAST(sum(CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END) AS BIGINT) AS numLevelsCompleted,
    CAST(sum(CASE WHEN status = 'STARTED' THEN 1 ELSE 0 END) AS BIGINT) AS numLevelsStarted
  FROM levels GROUP BY userId, gameId, date, hourOfDay
),
ad AS (
  SELECT userId, gameId, date, hourOfDay,
    CAST(sum(CASE WHEN status = 'WATCHED' THEN 1 ELSE 0 END) AS BIGINT) AS numAdsWatched,
    CAST(sum(CASE WHEN status = 'IGNORED' THEN 1 ELSE 0 END) AS BIGINT) AS numAdsIgnored,
    CAST(sum(CASE WHEN status = 'PROPOSED' THEN 1 ELSE 0 END) AS BIGINT) AS numAdsProposed
  FROM ads GROUP BY userId, gameId, date, hourOfDay
),
pu AS (
  SELECT userId, gameId, date, hourOfDay,
    CAST(sum(CASE WHEN status = 'DONE' THEN 1 ELSE 0 END) AS BIGINT) AS numPurchasesDone,
    sum(CASE WHEN status = 'DONE' THEN amount ELSE 0 END) AS amountPurchasesDoneDol,
    CAST(sum(CASE WHEN status = 'REJECTED' THEN 1 ELSE 0 END) AS BIGINT) AS numPurchasesRejected,
    sum(CASE WHEN status = 'REJECTED' THEN amount ELSE 0 END) AS amountPurchasesRejectedDol,
    CAST(sum(CASE WHEN status = 'CANCELED' THEN 1 ELSE 0 END) AS BIGINT) AS numPurchasesCanceled,
    sum(CASE WHEN status = 'CANCELED' THEN amount ELSE 0 END) AS amountPurchasesCanceledDol
  FROM purchases GROUP BY userId, gameId, date, hourOfDay
),
hourly AS (
  SELECT lv.userId, lv.gameId, coalesce(reg.flagOrganic, 0) AS flagOrganic, reg.dateRegistration,
    coalesce(lv.numLevelsCompleted, 0) AS numLevelsCompleted,
    coalesce(lv.numLevelsStarted, 0) AS numLevelsStarted,
    coalesce(ad.numAdsWatched, 0) AS numAdsWatched,
    coalesce(ad.numAdsIgnored, 0) AS numAdsIgnored,
    coalesce(ad.numAdsProposed, 0) AS numAdsProposed,
    coalesce(pu.numPurchasesDone, 0) AS numPurchasesDone,
    coalesce(pu.amountPurchasesDoneDol, 0) AS amountPurchasesDoneDol,
    coalesce(pu.numPurchasesRejected, 0) AS numPurchasesRejected,
    coalesce(pu.amountPurchasesRejectedDol, 0) AS amountPurchasesRejectedDol,
    coalesce(pu.numPurchasesCanceled, 0) AS numPurchasesCanceled,
    coalesce(pu.amountPurchasesCanceledDol, 0) AS amountPurchasesCanceledDol,
    lv.hourOfDay,
    CASE WHEN lv.hourOfDay >= 5 AND lv.hourOfDay < 12 THEN 'morning'
         WHEN lv.hourOfDay >= 12 AND lv.hourOfDay < 17 THEN 'afternoon'
         WHEN lv.hourOfDay >= 17 AND lv.hourOfDay < 21 THEN 'evening'
         WHEN lv.hourOfDay >= 21 OR lv.hourOfDay < 5 THEN 'night' END AS partOfDay,
    CAST(dayofweek(lv.date) + 1 AS INTEGER) AS dayOfWeek,
    lv.date
  FROM lv
  LEFT JOIN reg ON lv.userId = reg.userId AND lv.gameId = reg.gameId
  LEFT JOIN ad ON lv.userId = ad.userId AND lv.gameId = ad.gameId AND lv.date = ad.date
              AND lv.hourOfDay = ad.hourOfDay
  LEFT JOIN pu ON lv.userId = pu.userId AND lv.gameId = pu.gameId AND lv.date = pu.date
              AND lv.hourOfDay = pu.hourOfDay
),
daily AS (
  SELECT userId, gameId, date, partOfDay,
    max(flagOrganic) AS flagOrganic, min(dateRegistration) AS dateRegistration,
    CAST(sum(numLevelsCompleted) AS BIGINT) AS numLevelsCompleted,
    CAST(sum(numLevelsStarted) AS BIGINT) AS numLevelsStarted,
    CAST(sum(numAdsWatched) AS BIGINT) AS numAdsWatched,
    CAST(sum(numAdsIgnored) AS BIGINT) AS numAdsIgnored,
    CAST(sum(numAdsProposed) AS BIGINT) AS numAdsProposed,
    CAST(sum(numPurchasesDone) AS BIGINT) AS numPurchasesDone,
    sum(amountPurchasesDoneDol) AS amountPurchasesDoneDol,
    CAST(sum(numPurchasesRejected) AS BIGINT) AS numPurchasesRejected,
    sum(amountPurchasesRejectedDol) AS amountPurchasesRejectedDol,
    CAST(sum(numPurchasesCanceled) AS BIGINT) AS numPurchasesCanceled,
    sum(amountPurchasesCanceledDol) AS amountPurchasesCanceledDol,
    max(dayOfWeek) AS dayOfWeek
  FROM hourly GROUP BY userId, gameId, date, partOfDay
),
monthly AS (
  SELECT userId, gameId, strftime(date, '%Y%m') AS codMonth, partOfDay,
    max(flagOrganic) AS flagOrganic, min(dateRegistration) AS dateRegistration,
    CAST(sum(numLevelsCompleted) AS BIGINT) AS numLevelsCompleted,
    CAST(sum(numLevelsStarted) AS BIGINT) AS numLevelsStarted,
    CAST(sum(numAdsWatched) AS BIGINT) AS numAdsWatched,
    CAST(sum(numAdsIgnored) AS BIGINT) AS numAdsIgnored,
    CAST(sum(numAdsProposed) AS BIGINT) AS numAdsProposed,
    CAST(sum(numPurchasesDone) AS BIGINT) AS numPurchasesDone,
    sum(amountPurchasesDoneDol) AS amountPurchasesDoneDol,
    CAST(sum(numPurchasesRejected) AS BIGINT) AS numPurchasesRejected,
    sum(amountPurchasesRejectedDol) AS amountPurchasesRejectedDol,
    CAST(sum(numPurchasesCanceled) AS BIGINT) AS numPurchasesCanceled,
    sum(amountPurchasesCanceledDol) AS amountPurchasesCanceledDol
  FROM daily GROUP BY userId, gameId, strftime(date, '%Y%m'), partOfDay
)"""

_MEASURE_COLS = """numLevelsCompleted, numLevelsStarted, numAdsWatched, numAdsIgnored,
  numAdsProposed, numPurchasesDone, round(round(amountPurchasesDoneDol, 12), 6) AS amountPurchasesDoneDol,
  numPurchasesRejected, round(round(amountPurchasesRejectedDol, 12), 6) AS amountPurchasesRejectedDol,
  numPurchasesCanceled, round(round(amountPurchasesCanceledDol, 12), 6) AS amountPurchasesCanceledDol"""

_TZ_MINUTES = """(CASE WHEN tz LIKE '-%' THEN -1 ELSE 1 END)
      * (CAST(substr(tz, 2, 2) AS INTEGER) * 60 + CAST(substr(tz, 5, 2) AS INTEGER))"""

ORACLE: dict[str, str] = {}


def _q(name: str, body: str, extra_ctes: str = "") -> None:
    ctes = BASE + ("," + extra_ctes if extra_ctes else "")
    ORACLE[name] = f"WITH {ctes}\n{body}"


_q("fn_time", f"""
SELECT eventId, tz AS timezone, CAST(clk AS DATE) AS date,
  strftime(clk, '%Y-%m-%d %H:%M:%S') AS datetime, hourOfDay,
  CASE WHEN hourOfDay >= 5 AND hourOfDay < 12 THEN 'morning'
       WHEN hourOfDay >= 12 AND hourOfDay < 17 THEN 'afternoon'
       WHEN hourOfDay >= 17 AND hourOfDay < 21 THEN 'evening' ELSE 'night' END AS partOfDay,
  CASE WHEN hourOfDay >= 5 AND hourOfDay < 12 THEN 0
       WHEN hourOfDay >= 12 AND hourOfDay < 17 THEN 1
       WHEN hourOfDay >= 17 AND hourOfDay < 21 THEN 2 ELSE 3 END AS partOfDayNumber,
  CAST(dayofweek(CAST(clk AS DATE)) + 1 AS INTEGER) AS dayOfWeek,
  strftime(CAST(clk AS DATE), '%Y%m') AS codMonth
FROM (
  SELECT eventId, tz, clk,
    CAST(hour(clk + to_minutes(CAST({_TZ_MINUTES} AS BIGINT))) AS INTEGER) AS hourOfDay
  FROM (
    SELECT event_id AS eventId, epoch_ms(epoch_us(ts) // 1000) AS clk,
      coalesce(replace(CASE k % 6 WHEN 1 THEN '+02.00' WHEN 2 THEN '-05:00' WHEN 3 THEN '+05.30'
               WHEN 4 THEN '+00:00' WHEN 5 THEN '-03.00' END, '.', ':'), '+00:00') AS tz
    FROM ev) t0) t1""")

_q("src_events", """
SELECT eventId, userId, gameId, attribution, action, "timestamp", timezone, levelId,
  levelDifficulty, levelProgress, status, placementId, adType, itemId, category,
  round(round(amount, 12), 6) AS amount, currency
FROM raw_events""")

_q("src_player_info", "SELECT * FROM player_info")

_q("src_behavior", """
SELECT userId, gameId, levelId, levelDifficulty, levelProgress, status, "timestamp", timezone,
  placementId, adType, itemId, category, round(round(amount, 12), 6) AS amount, currency,
  strftime(dt, '%Y-%m-%d %H:%M:%S') AS datetime, date
FROM behavior""")

_q("clean_players", "SELECT * FROM players")
_q("clean_levels", "SELECT * FROM levels")
_q("clean_ads", "SELECT * FROM ads")
_q("clean_purchases", """
SELECT userId, gameId, itemId, category, round(round(amount, 12), 6) AS amount, currency, status, timezone,
  hourOfDay, date FROM purchases""")

_q("agg_registration", "SELECT * FROM reg")
_q("agg_levels_hourly", "SELECT * FROM lv")
_q("agg_ads_hourly", "SELECT * FROM ad")
_q("agg_purchases_hourly", """
SELECT userId, gameId, date, hourOfDay, numPurchasesDone,
  round(round(amountPurchasesDoneDol, 12), 6) AS amountPurchasesDoneDol, numPurchasesRejected,
  round(round(amountPurchasesRejectedDol, 12), 6) AS amountPurchasesRejectedDol, numPurchasesCanceled,
  round(round(amountPurchasesCanceledDol, 12), 6) AS amountPurchasesCanceledDol
FROM pu""")

_q("join_levels_players", """
SELECT lv.userId, lv.gameId, lv.date, lv.hourOfDay, lv.numLevelsCompleted, lv.numLevelsStarted,
  reg.flagOrganic, reg.dateRegistration
FROM lv LEFT JOIN reg ON lv.userId = reg.userId AND lv.gameId = reg.gameId""")

_q("join_levels_ads", """
SELECT lv.*, ad.numAdsWatched, ad.numAdsIgnored, ad.numAdsProposed
FROM lv LEFT JOIN ad ON lv.userId = ad.userId AND lv.gameId = ad.gameId AND lv.date = ad.date
  AND lv.hourOfDay = ad.hourOfDay""")

_q("join_levels_purchases", """
SELECT lv.*, pu.numPurchasesDone, round(round(pu.amountPurchasesDoneDol, 12), 6) AS amountPurchasesDoneDol,
  pu.numPurchasesRejected, round(round(pu.amountPurchasesRejectedDol, 12), 6) AS amountPurchasesRejectedDol,
  pu.numPurchasesCanceled, round(round(pu.amountPurchasesCanceledDol, 12), 6) AS amountPurchasesCanceledDol
FROM lv LEFT JOIN pu ON lv.userId = pu.userId AND lv.gameId = pu.gameId AND lv.date = pu.date
  AND lv.hourOfDay = pu.hourOfDay""")

_q("rollup_hourly", f"""
SELECT userId, gameId, flagOrganic, dateRegistration, {_MEASURE_COLS}, hourOfDay, partOfDay,
  dayOfWeek, date FROM hourly""")

_q("rollup_daily", f"""
SELECT userId, gameId, date, partOfDay, flagOrganic, dateRegistration, {_MEASURE_COLS},
  dayOfWeek FROM daily""")

_q("rollup_monthly", f"""
SELECT userId, gameId, codMonth, partOfDay, flagOrganic, dateRegistration, {_MEASURE_COLS}
FROM monthly""")

_q("preview_latest_daily", f"""
SELECT userId, gameId, date, partOfDay, flagOrganic, dateRegistration, {_MEASURE_COLS},
  dayOfWeek FROM daily
ORDER BY date DESC, userId ASC NULLS FIRST, gameId ASC NULLS FIRST, partOfDay ASC NULLS FIRST
LIMIT 15""")


# --- analysis ---------------------------------------------------------------------------------

def _month_sql(col: str, months: T.MonthRange) -> str:
    return f"strftime({col}, '%Y%m') BETWEEN '{months.from_month}' AND '{months.to_month}'"


_POD_NUMBER = ("CASE partOfDay WHEN 'morning' THEN 0 WHEN 'afternoon' THEN 1 "
               "WHEN 'evening' THEN 2 WHEN 'night' THEN 3 END")


def _seg_sql(source: str, period: str, period_filter: str, game_filter: str = "TRUE") -> str:
    return f"""SELECT userId, gameId, numLevelsStarted, numLevelsCompleted, numAdsWatched,
    numPurchasesDone, partOfDay, CAST({_POD_NUMBER} AS INTEGER) AS partOfDayNumber, flagOrganic, {period}
  FROM {source} WHERE {period_filter} AND {game_filter}"""


def _label_sql(source: str) -> str:
    feats = ("numLevelsCompleted", "numAdsWatched", "numPurchasesDone", "partOfDayNumber", "flagOrganic")
    dists = []
    for i, c in enumerate(C.FIXED_CENTROIDS):
        terms = " + ".join(f"power(CAST({f} AS DOUBLE) - {float(v)}, 2)" for f, v in zip(feats, c))
        dists.append(f"{terms} AS d{i}")
    n = len(C.FIXED_CENTROIDS)
    # nearest centre, lowest id on ties
    whens = []
    for i in range(n - 1):
        cond = " AND ".join(f"d{i} <= d{j}" for j in range(i + 1, n))
        whens.append(f"WHEN {cond} THEN {i}")
    case = f"CASE {' '.join(whens)} ELSE {n - 1} END"
    return f"""SELECT * EXCLUDE ({', '.join(f'd{i}' for i in range(n))}), CAST({case} AS INTEGER) AS cluster
  FROM (SELECT *, {', '.join(dists)} FROM {source}) t"""


_GAME = f"gameId = '{C.GAME}'"
_N = T.days_in_month(C.RETENTION_START)
_R_MONTH = T.MonthRange.one(C.RETENTION_START)


def _act_range(idle: int, full: bool = False) -> tuple[str, str]:
    from ..operators.retention import activity_range
    lo, hi = activity_range(C.RETENTION_START, idle, full)
    return lo.isoformat(), hi.isoformat()


ANALYSIS = f"""
seg AS ({_seg_sql('daily', 'date', 'TRUE')}),
labelled AS ({_label_sql('seg')}),
clusters AS (
  SELECT userId, gameId, numLevelsCompleted, numAdsWatched, numPurchasesDone, partOfDay,
         partOfDayNumber, flagOrganic, cluster, date FROM labelled
),
ltv_ud AS (
  SELECT gameId, userId, date, count(partOfDay) AS lifetime,
         CAST(sum(numAdsWatched) AS DOUBLE) * CAST(0.015 AS DOUBLE) AS revenue
  FROM clusters GROUP BY gameId, userId, date
),
dau_flag AS (
  SELECT gameId, date, count(DISTINCT numLevelsCompleted > 0) AS activeUsersPerPeriod
  FROM clusters GROUP BY gameId, date
),
dau_users AS (
  SELECT gameId, date,
         count(DISTINCT CASE WHEN numLevelsCompleted > 0 THEN userId END) AS activeUsersPerPeriod
  FROM clusters GROUP BY gameId, date
),
ltv_daily AS (
  SELECT u.gameId, u.userId,
         CASE WHEN d.activeUsersPerPeriod = 0 THEN NULL ELSE u.revenue / d.activeUsersPerPeriod END
           * u.lifetime AS ltv, u.date
  FROM ltv_ud u LEFT JOIN dau_flag d ON u.gameId = d.gameId AND u.date = d.date
),
ltv_daily_users AS (
  SELECT u.gameId, u.userId,
         CASE WHEN d.activeUsersPerPeriod = 0 THEN NULL ELSE u.revenue / d.activeUsersPerPeriod END
           * u.lifetime AS ltv, u.date
  FROM ltv_ud u LEFT JOIN dau_users d ON u.gameId = d.gameId AND u.date = d.date
),
ltv_ucd AS (
  SELECT gameId, cluster, userId, date, count(partOfDay) AS lifetime,
         CAST(sum(numAdsWatched) AS DOUBLE) * CAST(0.015 AS DOUBLE) AS revenue
  FROM clusters GROUP BY gameId, cluster, userId, date
),
dau_cluster AS (
  SELECT gameId, cluster, date, count(DISTINCT numLevelsCompleted > 0) AS activeUsersPerPeriod
  FROM clusters GROUP BY gameId, cluster, date
),
ltv_daily_cluster AS (
  SELECT u.gameId, u.cluster, u.userId,
         CASE WHEN d.activeUsersPerPeriod = 0 THEN NULL ELSE u.revenue / d.activeUsersPerPeriod END
           * u.lifetime AS ltv, u.date
  FROM ltv_ucd u LEFT JOIN dau_cluster d
    ON u.gameId = d.gameId AND u.cluster = d.cluster AND u.date = d.date
),
ltv_um AS (
  SELECT gameId, userId, strftime(date, '%Y%m') AS codMonth, count(DISTINCT date) AS lifetime,
         CAST(sum(numAdsWatched) AS DOUBLE) * CAST(0.015 AS DOUBLE) AS revenue
  FROM clusters GROUP BY gameId, userId, strftime(date, '%Y%m')
),
mau_flag AS (
  SELECT gameId, strftime(date, '%Y%m') AS codMonth,
         count(DISTINCT numLevelsCompleted > 0) AS activeUsersPerPeriod
  FROM clusters GROUP BY gameId, strftime(date, '%Y%m')
),
ltv_monthly AS (
  SELECT u.gameId, u.userId,
         CASE WHEN d.activeUsersPerPeriod = 0 THEN NULL ELSE u.revenue / d.activeUsersPerPeriod END
           * u.lifetime AS ltv, u.codMonth
  FROM ltv_um u LEFT JOIN mau_flag d ON u.gameId = d.gameId AND u.codMonth = d.codMonth
),
r_events AS (
  SELECT gameId, date, userId, action FROM players WHERE {_month_sql('date', _R_MONTH)}
),
r_new AS (
  SELECT gameId, date AS pivotDate, count(DISTINCT userId) AS newUsers FROM r_events GROUP BY gameId, date
),
r_members AS (
  SELECT DISTINCT gameId, date AS pivotDate, userId FROM r_events WHERE userId IS NOT NULL
),
r_grid AS (
  SELECT gameId, pivotDate, newUsers, CAST(unnest(generate_series(1, {_N})) AS INTEGER) AS dayRetention
  FROM r_new WHERE newUsers > 0
)"""


def _qa(name: str, body: str, extra: str = "") -> None:
    _q(name, body, ANALYSIS + ("," + extra if extra else ""))


_q("src_game_player_events", f"""
SELECT userId, gameId, attribution, action, date FROM players
WHERE {_GAME} AND {_month_sql('date', C.FILTER_MONTHS)}""")

_q("src_game_daily", _seg_sql("daily", "date", _month_sql("date", C.FILTER_MONTHS), _GAME))

_q("src_game_monthly", _seg_sql(
    "monthly", "codMonth",
    f"CAST(codMonth AS INTEGER) BETWEEN {C.FILTER_MONTHS.from_month} AND {C.FILTER_MONTHS.to_month}", _GAME))

_q("src_game_cluster", f"""
SELECT userId, gameId, numLevelsCompleted, numAdsWatched, numPurchasesDone, partOfDay,
  partOfDayNumber, flagOrganic, cluster, date FROM game_labelled""",
   f"""game_seg AS ({_seg_sql('daily', 'date', _month_sql('date', C.FILTER_MONTHS), _GAME)}),
game_labelled AS ({_label_sql('game_seg')})""")

_qa("seg_features", "SELECT * FROM seg")

_qa("seg_scaled_features", """
SELECT userId, gameId, date, partOfDay,
  round(round(CASE WHEN coalesce(sd0, 0) = 0 THEN 0.0 ELSE numLevelsCompleted / sd0 END, 12), 6) AS s_numLevelsCompleted,
  round(round(CASE WHEN coalesce(sd1, 0) = 0 THEN 0.0 ELSE numAdsWatched / sd1 END, 12), 6) AS s_numAdsWatched,
  round(round(CASE WHEN coalesce(sd2, 0) = 0 THEN 0.0 ELSE numPurchasesDone / sd2 END, 12), 6) AS s_numPurchasesDone,
  round(round(CASE WHEN coalesce(sd3, 0) = 0 THEN 0.0 ELSE partOfDayNumber / sd3 END, 12), 6) AS s_partOfDayNumber,
  round(round(CASE WHEN coalesce(sd4, 0) = 0 THEN 0.0 ELSE flagOrganic / sd4 END, 12), 6) AS s_flagOrganic
FROM seg JOIN (SELECT gameId, stddev_samp(numLevelsCompleted) AS sd0, stddev_samp(numAdsWatched) AS sd1,
                  stddev_samp(numPurchasesDone) AS sd2, stddev_samp(partOfDayNumber) AS sd3,
                  stddev_samp(flagOrganic) AS sd4 FROM seg GROUP BY gameId) s USING (gameId)""")

_qa("seg_assign_fixed", "SELECT * FROM labelled")

_qa("cluster_users", """
SELECT gameId, cluster, count(DISTINCT userId) AS numberOfUsers FROM clusters GROUP BY gameId, cluster""")

_summary = ", ".join(
    f"count({f}) AS {f}_count, min({f}) AS {f}_min, round(round(avg({f}), 12), 6) AS {f}_mean, max({f}) AS {f}_max"
    for f in ("numLevelsCompleted", "numAdsWatched", "numPurchasesDone", "partOfDayNumber", "flagOrganic"))
_qa("cluster_feature_summary", f"SELECT gameId, cluster, {_summary} FROM clusters GROUP BY gameId, cluster")

_qa("cluster_active_players", """
SELECT gameId, cluster, partOfDay, count(DISTINCT userId) AS activePlayers
FROM clusters WHERE numLevelsCompleted > 0 GROUP BY gameId, cluster, partOfDay""")

_qa("cluster_avg_levels", """
SELECT gameId, cluster, partOfDay, round(round(avg(numLevelsCompleted), 12), 6) AS avgLevelsCompleted
FROM clusters GROUP BY gameId, cluster, partOfDay""")

_qa("cluster_avg_ads", """
SELECT gameId, cluster, partOfDay, round(round(avg(numAdsWatched), 12), 6) AS avgAdsWatched
FROM clusters GROUP BY gameId, cluster, partOfDay""")

_qa("cluster_organic_users", """
SELECT gameId, cluster, CASE flagOrganic WHEN 0 THEN 'not organic' WHEN 1 THEN 'organic' END AS organic,
  count(DISTINCT userId) AS numberOfUsers
FROM clusters GROUP BY gameId, cluster, flagOrganic""")

_qa("cluster_ids", "SELECT DISTINCT gameId, cluster FROM clusters")

_qa("cluster_sample", """
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY gameId, cluster
      ORDER BY userId ASC NULLS FIRST, date ASC NULLS FIRST, partOfDay ASC NULLS FIRST) AS INTEGER) AS rowInCluster
  FROM clusters) t
WHERE rowInCluster <= 20""")

_qa("ltv_by_cluster", """
SELECT gameId, cluster,
  round(round(CASE WHEN count(DISTINCT userId) = 0 THEN NULL
        ELSE CAST(sum(numAdsWatched) AS DOUBLE) * CAST(0.015 AS DOUBLE) / count(DISTINCT userId) END, 12), 6) AS ltv
FROM clusters GROUP BY gameId, cluster""")

_qa("ltv_user_day_revenue", "SELECT gameId, userId, date, lifetime, round(round(revenue, 12), 6) AS revenue FROM ltv_ud")
_qa("ltv_active_per_day", "SELECT * FROM dau_flag")
_qa("ltv_active_users_per_day", "SELECT * FROM dau_users")
_qa("ltv_user_daily", "SELECT gameId, userId, round(round(ltv, 12), 6) AS ltv, date FROM ltv_daily")
_qa("ltv_user_daily_active_users", "SELECT gameId, userId, round(round(ltv, 12), 6) AS ltv, date FROM ltv_daily_users")
_qa("ltv_points_daily", """
SELECT gameId, date, round(round(CAST(sum(CAST(ltv AS DECIMAL(38,18))) AS DOUBLE), 12), 6) AS sumLtv,
  round(round(CAST(sum(CAST(ltv AS DECIMAL(38,18))) AS DOUBLE) / CAST(count(ltv) AS DOUBLE), 12), 6) AS avgLtv
FROM ltv_daily GROUP BY gameId, date""")
_qa("ltv_points_daily_by_cluster", """
SELECT gameId, cluster, date, round(round(CAST(sum(CAST(ltv AS DECIMAL(38,18))) AS DOUBLE), 12), 6) AS sumLtv,
  round(round(CAST(sum(CAST(ltv AS DECIMAL(38,18))) AS DOUBLE) / CAST(count(ltv) AS DOUBLE), 12), 6) AS avgLtv
FROM ltv_daily_cluster GROUP BY gameId, cluster, date""")
_qa("ltv_user_monthly", "SELECT gameId, userId, round(round(ltv, 12), 6) AS ltv, codMonth FROM ltv_monthly")
_qa("ltv_points_monthly", """
SELECT gameId, codMonth, round(round(CAST(sum(CAST(ltv AS DECIMAL(38,18))) AS DOUBLE), 12), 6) AS sumLtv,
  round(round(CAST(sum(CAST(ltv AS DECIMAL(38,18))) AS DOUBLE) / CAST(count(ltv) AS DOUBLE), 12), 6) AS avgLtv
FROM ltv_monthly GROUP BY gameId, codMonth""")

_qa("retention_new_users", "SELECT * FROM r_new")
_lo0, _hi0 = _act_range(0)
_qa("retention_activity", f"""
SELECT gameId, date, userId, CAST(sum(numLevelsCompleted) AS BIGINT) AS numLevelsCompleted,
  CAST(sum(numLevelsStarted) AS BIGINT) AS numLevelsStarted
FROM daily WHERE date BETWEEN DATE '{_lo0}' AND DATE '{_hi0}' GROUP BY gameId, date, userId""")
_qa("retention_cohorts", "SELECT * FROM r_members")
_lo3, _hi3 = _act_range(3)
_qa("cohort_activity", f"""
SELECT m.gameId, m.pivotDate, m.userId, a.date AS activityDate,
  CAST(a.date - m.pivotDate AS INTEGER) AS daysAfterPivot
FROM r_members m JOIN (
  SELECT gameId, date, userId FROM daily WHERE date BETWEEN DATE '{_lo3}' AND DATE '{_hi3}'
  GROUP BY gameId, date, userId HAVING sum(numLevelsStarted) > 0 OR sum(numLevelsCompleted) > 0) a
  ON a.gameId = m.gameId AND a.userId = m.userId
WHERE a.date - m.pivotDate BETWEEN 1 AND {_N + 3}""")
_qa("retention_grid", "SELECT gameId, pivotDate, newUsers, dayRetention FROM r_grid")


def _points_sql(idle: int, full: bool = False, members: str = "r_members", grid: str = "r_grid") -> str:
    """Brute force of the definition: per pivot and offset, the window sums of each member."""
    lo, hi = _act_range(idle, full)
    return f"""(
  SELECT g.gameId, g.pivotDate, g.dayRetention, g.pivotDate + g.dayRetention AS dateRetention,
    g.newUsers, CAST(coalesce(h.activeUsers, 0) AS BIGINT) AS activeUsers,
    CAST(coalesce(h.activeUsers, 0) AS DOUBLE) / g.newUsers * 100.0 AS retentionRate
  FROM {grid} g LEFT JOIN (
    SELECT gameId, pivotDate, dayRetention, count(*) AS activeUsers FROM (
      SELECT g.gameId, g.pivotDate, g.dayRetention, m.userId
      FROM {grid} g
      JOIN {members} m ON m.gameId = g.gameId AND m.pivotDate = g.pivotDate
      JOIN (SELECT gameId, date, userId, sum(numLevelsCompleted) AS c, sum(numLevelsStarted) AS s
            FROM daily WHERE date BETWEEN DATE '{lo}' AND DATE '{hi}' GROUP BY gameId, date, userId) a
        ON a.gameId = m.gameId AND a.userId = m.userId
       AND a.date BETWEEN g.pivotDate + g.dayRetention AND g.pivotDate + g.dayRetention + {idle}
      GROUP BY g.gameId, g.pivotDate, g.dayRetention, m.userId
      HAVING sum(a.s) > 0 OR sum(a.c) > 0) w
    GROUP BY gameId, pivotDate, dayRetention) h
  ON h.gameId = g.gameId AND h.pivotDate = g.pivotDate AND h.dayRetention = g.dayRetention)"""


_ROUND_POINTS = ("SELECT gameId, pivotDate, dayRetention, dateRetention, newUsers, activeUsers, "
                 "round(round(retentionRate, 12), 6) AS retentionRate FROM ")
_qa("retention_points", _ROUND_POINTS + _points_sql(0) + " p")
_qa("retention_points_idle3", _ROUND_POINTS + _points_sql(3) + " p")
_qa("retention_points_full_horizon", _ROUND_POINTS + _points_sql(3, True) + " p")
_qa("retention_points_signup", _ROUND_POINTS + _points_sql(0, False, "s_members", "s_grid") + " p", """
s_events AS (SELECT * FROM r_events WHERE action = 'SIGN_UP'),
s_members AS (SELECT DISTINCT gameId, date AS pivotDate, userId FROM s_events WHERE userId IS NOT NULL),
s_grid AS (
  SELECT gameId, pivotDate, newUsers, CAST(unnest(generate_series(1, """ + str(_N) + """)) AS INTEGER) AS dayRetention
  FROM (SELECT gameId, date AS pivotDate, count(DISTINCT userId) AS newUsers FROM s_events GROUP BY gameId, date) n
  WHERE newUsers > 0
)""")
_qa("retention_monthly_avg", f"""
SELECT gameId, dayRetention, round(round(CAST(sum(CAST(retentionRate AS DECIMAL(38,18))) AS DOUBLE) / {float(_N)}, 12), 6) AS avgRetentionRate
FROM {_points_sql(0)} p GROUP BY gameId, dayRetention""")
_qa("retention_monthly_avg_cohorts", f"""
SELECT gameId, dayRetention, round(round(CAST(sum(CAST(retentionRate AS DECIMAL(38,18))) AS DOUBLE) / CAST(count(retentionRate) AS DOUBLE), 12), 6) AS avgRetentionRate
FROM {_points_sql(3)} p GROUP BY gameId, dayRetention""")

_DAILY_READ = f"""userId, gameId, flagOrganic, dateRegistration, {_MEASURE_COLS}, partOfDay, date"""
_q("sink_roundtrip", f"SELECT {_DAILY_READ} FROM daily")
_q("sink_dynamic_overwrite", f"""
SELECT {_DAILY_READ} FROM rerun
UNION ALL
SELECT {_DAILY_READ} FROM daily d
WHERE NOT EXISTS (SELECT 1 FROM rerun r WHERE r.date = d.date AND r.partOfDay = d.partOfDay)""",
   f"""rerun AS (
  SELECT * FROM daily WHERE {_month_sql('date', C.REWRITE_MONTH)} AND gameId = '{C.GAME}'
)""")

# driver="any": every (user, game, date, hour) with a level, ad or purchase; the families are
# joined null-safely (rows with a null key part still form one group per key).
_NS = "{a}.userId IS NOT DISTINCT FROM {b}.userId AND {a}.gameId IS NOT DISTINCT FROM {b}.gameId " \
      "AND {a}.date IS NOT DISTINCT FROM {b}.date AND {a}.hourOfDay IS NOT DISTINCT FROM {b}.hourOfDay"
_q("rollup_hourly_any", f"""
SELECT k.userId, k.gameId, coalesce(reg.flagOrganic, 0) AS flagOrganic, reg.dateRegistration,
  coalesce(lv.numLevelsCompleted, 0) AS numLevelsCompleted, coalesce(lv.numLevelsStarted, 0) AS numLevelsStarted,
  coalesce(ad.numAdsWatched, 0) AS numAdsWatched, coalesce(ad.numAdsIgnored, 0) AS numAdsIgnored,
  coalesce(ad.numAdsProposed, 0) AS numAdsProposed, coalesce(pu.numPurchasesDone, 0) AS numPurchasesDone,
  round(round(coalesce(pu.amountPurchasesDoneDol, 0), 12), 6) AS amountPurchasesDoneDol,
  coalesce(pu.numPurchasesRejected, 0) AS numPurchasesRejected,
  round(round(coalesce(pu.amountPurchasesRejectedDol, 0), 12), 6) AS amountPurchasesRejectedDol,
  coalesce(pu.numPurchasesCanceled, 0) AS numPurchasesCanceled,
  round(round(coalesce(pu.amountPurchasesCanceledDol, 0), 12), 6) AS amountPurchasesCanceledDol,
  k.hourOfDay,
  CASE WHEN k.hourOfDay >= 5 AND k.hourOfDay < 12 THEN 'morning'
       WHEN k.hourOfDay >= 12 AND k.hourOfDay < 17 THEN 'afternoon'
       WHEN k.hourOfDay >= 17 AND k.hourOfDay < 21 THEN 'evening' ELSE 'night' END AS partOfDay,
  CAST(dayofweek(k.date) + 1 AS INTEGER) AS dayOfWeek, k.date
FROM (SELECT userId, gameId, date, hourOfDay FROM lv UNION SELECT userId, gameId, date, hourOfDay FROM ad
      UNION SELECT userId, gameId, date, hourOfDay FROM pu) k
LEFT JOIN reg ON k.userId = reg.userId AND k.gameId = reg.gameId
LEFT JOIN lv ON {_NS.format(a='k', b='lv')}
LEFT JOIN ad ON {_NS.format(a='k', b='ad')}
LEFT JOIN pu ON {_NS.format(a='k', b='pu')}""")

_q("src_monthly_rollup", f"""
SELECT userId, gameId, flagOrganic, dateRegistration, {_MEASURE_COLS}, partOfDay,
  CAST(codMonth AS INTEGER) AS codMonth FROM monthly""")

# --- models by what must hold of them; tables that the jobs write -----------------------------------
_KMEANS = M.fitted([C.KMEANS_K], C.segment.DEFAULT_MAX_ITER, C.game_models.TOLERANCE)
_ELBOW_KS = range(C.segment.DEFAULT_ELBOW_K[0], C.segment.DEFAULT_ELBOW_K[1] + 1)

_qa("seg_kmeans", M.labels(), _KMEANS + "," + M.nearest())
_qa("seg_centers", f"""
SELECT gameId, CAST(id AS INTEGER) AS cluster,
  {', '.join(f'round(round(c{i} * f{i}, 12), 6) AS {f}' for i, f in enumerate(M.FEATURES))}
FROM models JOIN gm USING (gameId)""", _KMEANS)
_qa("seg_elbow", """
SELECT gameId, CAST(k AS INTEGER) AS kCluster, round(round(sum(w * d), 12), 6) AS costTraining
FROM near_end GROUP BY gameId, k""",
    M.fitted(_ELBOW_KS, C.segment.DEFAULT_MAX_ITER, C.game_models.TOLERANCE) + "," + M.nearest())
_qa("seg_pca", f"""
SELECT p.gameId, l.userId, l.date, l.partOfDay, l.cluster, round(round({M.projection(0)}, 12), 6) AS x, round(round({M.projection(1)}, 12), 6) AS y
FROM ({M.labels()}) l
JOIN pts p ON p.gameId = l.gameId AND {' AND '.join(f'p.x{i} = l.{c}' for i, c in enumerate(M.FEATURES))}
JOIN axes a0 ON a0.gameId = p.gameId AND a0.axis = 0
JOIN axes a1 ON a1.gameId = p.gameId AND a1.axis = 1""", _KMEANS + "," + M.nearest() + "," + M.principal(2))
ORACLE["seg_pca"] = ORACLE["seg_pca"].replace("WITH ", "WITH RECURSIVE ", 1)
_qa("seg_kmeans_check", """
SELECT gameId, count(*) AS numRows, CAST(0 AS BIGINT) AS notNearest, CAST(0 AS BIGINT) AS badLabels
FROM seg WHERE gameId IS NOT NULL GROUP BY gameId""")
_qa("seg_elbow_check", """
SELECT gameId, CAST(k AS INTEGER) AS kCluster, TRUE AS costMatches
FROM (SELECT DISTINCT gameId FROM seg WHERE gameId IS NOT NULL) g, (SELECT unnest(generate_series(3, 25)) AS k) r""")
_qa("seg_pca_check", """
SELECT gameId, count(*) AS numRows, TRUE AS uncorrelated, TRUE AS falling
FROM seg WHERE gameId IS NOT NULL GROUP BY gameId""")


def _unslotted(name: str) -> str:
    """The oracle of a query with every event at its own instant (milliseconds)."""
    text = ORACLE[name]
    start = text.index("    epoch_ms(CAST(date_trunc('day', ts) AS TIMESTAMP))")
    end = text.index('AS "timestamp"', start)
    return text[:start] + "    epoch_us(ts) // 1000 " + text[end:]


ORACLE["rollup_hourly_unslotted"] = _unslotted("rollup_hourly")
ORACLE["rollup_daily_unslotted"] = _unslotted("rollup_daily")
ORACLE["enrich_rerun_shrunk"] = ORACLE["sink_roundtrip"].replace(
    "  FROM ev\n),\nplayer_info AS", f"  FROM ev WHERE hour(ts) < 12 AND (CASE WHEN {_PUR} THEN value END) IS NULL\n),\nplayer_info AS")
assert ORACLE["enrich_rerun_shrunk"] != ORACLE["sink_roundtrip"]
_q("raw_family_roundtrip", "\nUNION ALL\n".join(
    f"SELECT '{family}' AS family, count(*) AS numRows, count(DISTINCT userId) AS numUsers, count(DISTINCT date) AS numDates FROM {cte}"
    for family, cte in (("player", "players"), ("level", "levels"), ("ad", "ads"), ("purchase", "purchases"))))
ORACLE["job_retention"] = "SELECT * FROM (\n" + ORACLE["retention_points_idle3"] + f"\n) p WHERE {_GAME}"
ORACLE["job_ltv_daily"] = ORACLE["ltv_points_daily_by_cluster"]
ORACLE["job_cluster_profile"] = ORACLE["cluster_feature_summary"]
ORACLE["job_enrich_monthly"] = ORACLE["src_monthly_rollup"]
ORACLE["job_ltv_monthly"] = ORACLE["ltv_points_monthly"]
ORACLE["incremental_daily"] = ORACLE["sink_roundtrip"]
ORACLE["incremental_monthly"] = ORACLE["src_monthly_rollup"]
ORACLE["incremental_retention"] = ORACLE["retention_stored_idle3"] = ORACLE["retention_points_idle3"]
ORACLE["retention_stored"] = ORACLE["retention_points"]
ORACLE["retention_stored_full_horizon"] = ORACLE["retention_points_full_horizon"]
ORACLE["retention_stored_signup"] = ORACLE["retention_points_signup"]
ORACLE["bitmap_cluster_users"] = ORACLE["cluster_users"]
ORACLE["bitmap_new_users"] = ORACLE["retention_new_users"]
_qa("bitmap_monthly_users", """
SELECT gameId, strftime(date, '%Y%m') AS codMonth, count(DISTINCT userId) AS numberOfUsers FROM clusters GROUP BY ALL""")
_q("documents_by_reason", """
SELECT CASE WHEN eventId % 17 = 0 THEN 'not JSON' WHEN eventId % 29 = 0 THEN 'not an object' WHEN eventId % 13 = 0 THEN 'type of amount'
            WHEN eventId % 19 = 0 THEN 'missing timestamp' WHEN eventId % 23 = 0 THEN 'type of userId'
            WHEN eventId % 31 = 0 THEN 'type of timestamp' ELSE 'good' END AS outcome,
  count(*) AS numDocuments,
  CAST(CASE WHEN outcome = 'good' THEN sum("timestamp") END AS BIGINT) AS sumTimestamp,
  CASE WHEN outcome = 'good' THEN count(*) FILTER (WHERE eventId % 11 = 0) END AS numRenamed
FROM raw_events GROUP BY outcome""")
