"""Retention from a stored activity table (R1, R2, R3, J6): a row per player and month instead of events and joins.

A row holds, as bits of the days of the month (bit 0: the first), on which days the player was active (a level started
or completed), had any player event, and signed up. Rows of one player and month merge by or-ing, so a run adds its days
without reading older events. Any start month, idle time or horizon is then shifts and counts over
one scan of the months concerned: no join, no distinct, and cohorts without activity need no grid.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import predicates as P
from ..functions import time as T
from .retention import WORD_DAYS, activity_range

MASK_COLUMNS = ("active", "events", "signups")
MASK_SCHEMA = StructType([StructField("gameId", StringType()), StructField("userId", StringType()),
                          *[StructField(c, IntegerType()) for c in (*MASK_COLUMNS, "codMonth")]])
_WORD = (1 << WORD_DAYS) - 1


def masks(players_clean: DataFrame, activity: DataFrame) -> DataFrame:
    """gameId, userId, active, events, signups, codMonth of cleaned player events and rollup rows (hourly or daily).

    Rows without a date or player take no part: they are in no cohort and never active.
    """
    day = F.expr("shiftleft(1, day(date) - 1)")

    def of(rows: DataFrame, active: Column, events: Column, signups: Column) -> DataFrame:
        bits = [F.when(c, day).otherwise(F.lit(0)).alias(n) for n, c in zip(MASK_COLUMNS, (active, events, signups))]
        return (rows.where("date IS NOT NULL AND userId IS NOT NULL")
                .select("gameId", "userId", *bits, T.cod_month(F.col("date")).cast("int").alias("codMonth")))

    no, yes = F.lit(False), F.lit(True)
    return merged(of(activity.where(P.is_active_level_row()), yes, no, no)
                  .unionByName(of(players_clean, no, yes, F.coalesce(P.is_new_player(), no))))


def merged(rows: DataFrame) -> DataFrame:
    """One row per player and month."""
    return rows.groupBy("gameId", "userId", "codMonth").agg(*[F.bit_or(c).alias(c) for c in MASK_COLUMNS]) \
        .select("gameId", "userId", *MASK_COLUMNS, "codMonth")


def _months(lo: date, hi: date) -> list[date]:
    first, out = lo.replace(day=1), []
    while first <= hi:
        out.append(first)
        first = date(first.year + first.month // 12, first.month % 12 + 1, 1)
    return out


def retention_points(table: DataFrame, start_month: str, idle: int = 0, cohort: str = "any", full_horizon: bool = False) -> DataFrame:
    """``retention.retention_points`` from the table of ``masks`` (its rows of other months are pruned)."""
    if cohort not in ("any", "signup"):
        raise ValueError("cohort must be 'any' or 'signup'")
    n = T.days_in_month(start_month)
    lo, hi = activity_range(start_month, idle, full_horizon)
    months = _months(lo, hi)
    words = range((n + n + idle) // WORD_DAYS + 1)

    def shifted(first: date, word: int) -> Column | None:
        """A month's active days as days since the start, those of one word."""
        known = min(31, (hi - first).days + 1)
        low = (first - lo).days - word * WORD_DAYS
        if low >= WORD_DAYS or low + 31 <= 0:
            return None
        days = F.col("active").bitwiseAND(F.lit((1 << known) - 1)).cast("long")
        return (F.shiftleft(days, low).bitwiseAND(F.lit(_WORD)) if low >= 0 else F.shiftright(days, -low))

    def word(w: int) -> Column:
        parts = [F.when(F.col("codMonth") == int(T.month_code(m)), s) for m in months if (s := shifted(m, w)) is not None]
        return F.bit_or(F.coalesce(*parts, F.lit(0).cast("long")) if parts else F.lit(0).cast("long")).alias(f"w{w}")

    start = int(T.month_code(lo))
    pivots = F.bit_or(F.when(F.col("codMonth") == start, F.col("events" if cohort == "any" else "signups")).otherwise(F.lit(0))).alias("pivots")
    rows = table.where(F.col("codMonth").between(start, int(T.month_code(months[-1]))))
    players = rows.groupBy("gameId", "userId").agg(pivots, *[word(w) for w in words]).where("pivots <> 0")
    # players of no game are in cohorts, but their activity is never found
    members = players.select("gameId", *[F.when(F.col("gameId").isNotNull(), F.col(f"w{w}")).otherwise(F.lit(0).cast("long")).alias(f"w{w}") for w in words],
                             F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.call_function("getbit", "pivots", p) == 1)).alias("p"))
    # days after the pivot: the words moved down by p (less than a word)
    after = [F.expr(f"shiftright(w{w}, p)" + (f" | (shiftleft(w{w + 1}, {WORD_DAYS} - p) & {_WORD}L)" if w + 1 in words else "")).alias(f"d{w}")
             for w in words]
    members = members.select("gameId", "p", *after)

    def hit(i: int) -> Column:
        wanted = [sum(1 << d % WORD_DAYS for d in range(i, i + idle + 1) if d // WORD_DAYS == w) for w in words]
        return reduce(lambda a, b: a | b, [F.col(f"d{w}").bitwiseAND(F.lit(m).cast("long")) != 0 for w, m in zip(words, wanted) if m])

    counts = members.groupBy("gameId", "p").agg(F.count("*").alias("newUsers"), *[F.count_if(hit(i)).alias(f"h{i}") for i in range(1, n + 1)])
    points = counts.select("gameId", F.date_add(F.lit(lo), F.col("p")).alias("pivotDate"), "newUsers", F.inline(F.array(
        *[F.struct(F.lit(i).alias("dayRetention"), F.col(f"h{i}").alias("activeUsers")) for i in range(1, n + 1)])))
    return (points.select("gameId", "pivotDate", "dayRetention", F.date_add("pivotDate", F.col("dayRetention")).alias("dateRetention"),
                          "newUsers", "activeUsers", (F.col("activeUsers").cast("double") / F.col("newUsers") * F.lit(100.0)).alias("retentionRate"))
            .orderBy("gameId", "pivotDate", "dayRetention"))
