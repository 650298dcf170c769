"""N-day cohort retention with an idle-time allowance.

A cohort is the set of players with a player event on a pivot date of the start month.
Retention on day i of a cohort = share of its players active (a level started or
completed) on some day in [pivot + i, pivot + i + idle], for i = 1 .. days in month.

The batch job runs this as nested driver loops (pivot x offset, each an action, with the
cohort collected to the driver as an IN list). Here it is one plan:

1. active days: daily rollup -> (gameId, date, userId) with a started/completed level;
2. cohorts: distinct (gameId, pivotDate, userId), null players dropped;
3. equi-join on (gameId, userId) keeping activity dates in (pivot, pivot + n + idle];
4. a member is active for offset i iff one of its matched days d = activity - pivot
   lies in [i, i + idle] (window sum > 0 <=> some day > 0, counters being
   non-negative). Each member's days become a day mask and one aggregation counts the
   members hitting each offset (``active_by_mask``);
5. the counts are left-joined to the zero-filled grid.

Both join sides are pre-aggregated to one row per (player, day), so the work per player
is bounded by (days in month) x (days in horizon) whatever the player's event count.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import time as T
from ..functions.aggregates import exact_avg, exact_sum


def activity_range(start_month: str, idle: int = 0, full_horizon: bool = False) -> tuple[date, date]:
    """Dates of daily activity read for a start month.

    Default (as the batch job): whole months from the start month through the month of
    (first day of the next month + idle days). ``full_horizon=True`` reads through the
    last day any window reaches: last day + n + idle.
    """
    if idle < 0:
        raise ValueError("idle must be >= 0")
    month = T.MonthRange.one(start_month)
    n = T.days_in_month(start_month)
    if full_horizon:
        return month.first_day, month.last_day + timedelta(days=n + idle)
    end_code = T.month_code(month.first_day + timedelta(days=n + idle))
    return month.first_day, T.MonthRange(start_month, end_code).last_day


def new_users(cohort_events: DataFrame) -> DataFrame:
    """Distinct players per pivot date."""
    return (cohort_events.groupBy("gameId", F.col("date").alias("pivotDate"))
            .agg(F.count_distinct("userId").alias("newUsers")))


def daily_activity(daily: DataFrame) -> DataFrame:
    """Levels completed / started per (gameId, date, userId)."""
    return (daily.groupBy("gameId", "date", "userId")
            .agg(F.sum("numLevelsCompleted").alias("numLevelsCompleted"),
                 F.sum("numLevelsStarted").alias("numLevelsStarted")))


def cohort_members(cohort_events: DataFrame) -> DataFrame:
    """Distinct (gameId, pivotDate, userId) of non-null players."""
    return (cohort_events.where(F.col("userId").isNotNull())
            .select("gameId", F.col("date").alias("pivotDate"), "userId").distinct())


def cohort_activity(members: DataFrame, activity: DataFrame, n: int, idle: int) -> DataFrame:
    """Active days of cohort players after their pivot, within the horizon."""
    active = (activity.where(P.is_active_level_row() & F.col("userId").isNotNull())
              .select("gameId", "userId", F.col("date").alias("activityDate")))
    offset = F.date_diff(F.col("activityDate"), F.col("pivotDate"))
    return (members.join(active, ["gameId", "userId"], "inner")
            .where((offset >= 1) & (offset <= n + idle))
            .select("gameId", "pivotDate", "userId", "activityDate", offset.alias("daysAfterPivot")))


def retention_grid(new_users_df: DataFrame, n: int) -> DataFrame:
    """Every pivot date with players x offsets 1..n (R1); empty cohorts are dropped."""
    return (new_users_df.where(F.col("newUsers") > 0)
            .select("gameId", "pivotDate", "newUsers",
                    F.explode(F.sequence(F.lit(1), F.lit(n))).alias("dayRetention")))


# Days after the pivot that one word of a day mask holds.
WORD_DAYS = 62


def active_by_mask(hits: DataFrame, n: int, idle: int) -> DataFrame:
    """Active members per (gameId, pivotDate, dayRetention).

    Each member's active days after its pivot are folded into a day mask of as many longs as
    the horizon needs (``bit_or``); offset i is hit iff the mask has a bit in [i, i + idle]. One
    aggregation per (gameId, pivotDate) then counts the members hitting each offset, n
    ``count_if`` columns, turned back into rows. Work is linear in matched rows plus
    members x n tests; no distinct aggregation, no explode of matched rows.
    """
    words = range((n + idle) // WORD_DAYS + 1)
    day = F.col("daysAfterPivot")
    bit = F.expr(f"shiftleft(CAST(1 AS BIGINT), daysAfterPivot % {WORD_DAYS})")
    members = (hits.groupBy("gameId", "pivotDate", "userId")
               .agg(*[F.bit_or(F.when(F.floor(day / WORD_DAYS) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"_days{w}")
                      for w in words]))

    def hit(i: int):
        wanted = [sum(1 << d % WORD_DAYS for d in range(i, i + idle + 1) if d // WORD_DAYS == w) for w in words]
        tests = [F.col(f"_days{w}").bitwiseAND(F.lit(m).cast("long")) != 0 for w, m in zip(words, wanted) if m]
        return reduce(lambda a, b: a | b, tests)

    per_pivot = members.groupBy("gameId", "pivotDate").agg(*[F.count_if(hit(i)).alias(f"_hit{i}") for i in range(1, n + 1)])
    rows = F.array(*[F.struct(F.lit(i).alias("dayRetention"), F.col(f"_hit{i}").alias("activeUsers"))
                     for i in range(1, n + 1)])
    return per_pivot.select("gameId", "pivotDate", F.inline(rows))


def cohort_events(players_clean: DataFrame, start_month: str, cohort: str) -> DataFrame:
    if cohort not in ("any", "signup"):
        raise ValueError("cohort must be 'any' or 'signup'")
    month = T.MonthRange.one(start_month)
    ev = players_clean.where(month.date_filter(F.col("date")))
    if cohort == "signup":
        ev = ev.where(P.is_new_player())
    return ev.select("gameId", "date", "userId")


def retention_points(players_clean: DataFrame, daily: DataFrame, start_month: str, idle: int = 0,
                     cohort: str = "any", full_horizon: bool = False) -> DataFrame:
    """Retention curve of every cohort of ``start_month`` (R2).

    ``players_clean``: cleaned player events (gameId, date, userId, action);
    ``daily``: daily (or hourly) rollup rows with gameId, date, userId, numLevelsCompleted,
    numLevelsStarted -- only their per-day sums are used.
    ``cohort="any"`` (as the batch job): any player event on the pivot date makes a
    member; ``"signup"``: only sign-ups. Returns (gameId, pivotDate, dayRetention,
    dateRetention, newUsers, activeUsers, retentionRate in percent).
    """
    n = T.days_in_month(start_month)
    lo, hi = activity_range(start_month, idle, full_horizon)
    events = cohort_events(players_clean, start_month, cohort)
    activity = daily_activity(daily.where(F.col("date").between(F.lit(lo), F.lit(hi))))
    members = cohort_members(events)
    hits = cohort_activity(members, activity, n, idle)
    active = active_by_mask(hits, n, idle)
    # cohort sizes from the distinct members that the join uses; equal to ``new_users`` on every cohort the grid keeps (null players never count)
    sizes = members.groupBy("gameId", "pivotDate").agg(F.count("userId").alias("newUsers"))
    grid = retention_grid(sizes, n)
    active_users = F.coalesce(F.col("activeUsers"), F.lit(0))
    return (grid.join(active, ["gameId", "pivotDate", "dayRetention"], "left")
            .select("gameId", "pivotDate", "dayRetention",
                    F.date_add(F.col("pivotDate"), F.col("dayRetention")).alias("dateRetention"),
                    "newUsers", active_users.alias("activeUsers"),
                    (active_users.cast("double") / F.col("newUsers") * F.lit(100.0)).alias("retentionRate"))
            .orderBy("gameId", "pivotDate", "dayRetention"))


def monthly_average(points: DataFrame, start_month: str, denominator: str = "days") -> DataFrame:
    """Mean retention per offset over the month's cohorts.

    ``denominator="days"`` (as the batch job) divides the sum of rates by the days in the
    month, so a date without a cohort counts as 0; ``"cohorts"`` averages present cohorts.
    """
    if denominator == "days":
        avg = exact_sum(F.col("retentionRate")) / F.lit(float(T.days_in_month(start_month)))
    elif denominator == "cohorts":
        avg = exact_avg(F.col("retentionRate"))
    else:
        raise ValueError("denominator must be 'days' or 'cohorts'")
    return (points.groupBy("gameId", "dayRetention").agg(avg.alias("avgRetentionRate"))
            .orderBy("gameId", "dayRetention"))
