"""Per-player rollups: registration (A1), hourly (A2-A5, J1-J3, P14), daily (A6),
monthly (A7) and the latest-rows preview (T1).

The hourly rollup is built in one pass: a single ``groupBy`` of the behaviour events on
(userId, gameId, date, hourOfDay) with conditional counters for all three families, then
one left join to the registration table. This is equal, row for row, to aggregating each
family on its own and left-joining ads and purchases to levels, but scans and shuffles the events once instead of three
times and needs one join instead of three (``tests/joined_form.py`` checks it).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import time as T
from ..sources.schemas import MEASURES
from .clean import FAMILY_TABLES, clean_players, family_rows

USER_KEYS = ("userId", "gameId")
HOUR_KEYS = ("userId", "gameId", "date", "hourOfDay")
DAY_KEYS = ("userId", "gameId", "date", "partOfDay")
MONTH_KEYS = ("userId", "gameId", "codMonth", "partOfDay")


@dataclass(frozen=True)
class Measure:
    name: str
    family: str
    status: str
    amount: bool = False   # sum of the purchase amount instead of a count


MEASURE_SPECS = (
    Measure("numLevelsCompleted", "level", P.LEVEL_COMPLETED),
    Measure("numLevelsStarted", "level", P.LEVEL_STARTED),
    Measure("numAdsWatched", "ad", P.AD_WATCHED),
    Measure("numAdsIgnored", "ad", P.AD_IGNORED),
    Measure("numAdsProposed", "ad", P.AD_PROPOSED),
    Measure("numPurchasesDone", "purchase", P.PURCHASE_DONE),
    Measure("amountPurchasesDoneDol", "purchase", P.PURCHASE_DONE, amount=True),
    Measure("numPurchasesRejected", "purchase", P.PURCHASE_REJECTED),
    Measure("amountPurchasesRejectedDol", "purchase", P.PURCHASE_REJECTED, amount=True),
    Measure("numPurchasesCanceled", "purchase", P.PURCHASE_CANCELED),
    Measure("amountPurchasesCanceledDol", "purchase", P.PURCHASE_CANCELED, amount=True),
)
assert tuple(m.name for m in MEASURE_SPECS) == MEASURES


def _measure_agg(m: Measure, in_family: Column) -> Column:
    hit = in_family & P.status_is(m.status)
    if m.amount:
        return F.sum(F.when(hit, F.col("amount")).otherwise(F.lit(0.0))).alias(m.name)
    return F.count_if(hit).alias(m.name)


def registration(players_clean: DataFrame) -> DataFrame:
    """(userId, gameId) -> flagOrganic (1 if any organic sign-up) and first sign-up date."""
    return (players_clean.where(P.is_new_player())
            .groupBy(*USER_KEYS)
            .agg(F.max(F.when(P.is_organic(), F.lit(1)).otherwise(F.lit(0))).alias("flagOrganic"),
                 F.min("date").alias("dateRegistration")))


def family_hourly(family_clean: DataFrame, family: str) -> DataFrame:
    """Hourly counters of one cleaned family (levels, ads or purchases)."""
    specs = [m for m in MEASURE_SPECS if m.family == family]
    return family_clean.groupBy(*HOUR_KEYS).agg(*[_measure_agg(m, F.lit(True)) for m in specs])


def finish_hourly(joined: DataFrame) -> DataFrame:
    """Zero-fill the measures and flag, add partOfDay and dayOfWeek."""
    return joined.select(
        "userId", "gameId",
        F.coalesce(F.col("flagOrganic"), F.lit(0)).alias("flagOrganic"),
        "dateRegistration",
        *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in MEASURES],
        "hourOfDay",
        T.part_of_day(F.col("hourOfDay")).alias("partOfDay"),
        T.day_of_week(F.col("date")).alias("dayOfWeek"),
        "date")


def hourly_measures(behavior: DataFrame, driver: str = "levels") -> DataFrame:
    """One ``groupBy`` of all behaviour families by (userId, gameId, date, hourOfDay).

    ``driver="levels"`` keeps only hours with at least one level event, as the batch job
    does (hours with only ads or purchases vanish); ``driver="any"`` keeps every hour.
    With "levels", ads and purchases of a row whose key has a null part are not counted:
    in the per-family form such rows could never join their level group.
    """
    rows = behavior.select(
        F.trim("userId").alias("userId"), F.trim("gameId").alias("gameId"), "date",
        T.local_hour(F.col("datetime"), F.col("timezone")).alias("hourOfDay"),
        F.trim("status").alias("status"), "amount",
        P.is_family("level").alias("_level"), P.is_family("ad").alias("_ad"),
        P.is_family("purchase").alias("_purchase"))
    return _hourly_agg(rows, driver)


def _hourly_agg(rows: DataFrame, driver: str) -> DataFrame:
    agg = _hourly_counts(rows, driver)
    if driver == "levels":
        agg = agg.where(F.col("_levels") > 0)
    return agg.drop("_levels")


def _hourly_counts(rows: DataFrame, driver: str) -> DataFrame:
    """Counters per player and hour, and the number of level events."""
    if driver not in ("levels", "any"):
        raise ValueError("driver must be 'levels' or 'any'")
    if driver == "levels":
        keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in HOUR_KEYS])
        in_family = {"level": F.col("_level"), "ad": F.col("_ad") & keyed,
                     "purchase": F.col("_purchase") & keyed}
    else:
        in_family = {"level": F.col("_level"), "ad": F.col("_ad"), "purchase": F.col("_purchase")}
    return rows.groupBy(*HOUR_KEYS).agg(
        F.count_if(F.col("_level")).alias("_levels"),
        *[_measure_agg(m, in_family[m.family]) for m in MEASURE_SPECS])


def hourly_rollup(player_info: DataFrame, behavior: DataFrame, driver: str = "levels") -> DataFrame:
    """Hourly rollup per (userId, gameId, date, hourOfDay) with registration (A5)."""
    reg = registration(clean_players(player_info))
    joined = hourly_measures(behavior, driver).join(reg, list(USER_KEYS), "left")
    return finish_hourly(joined)


def _family_flags(behavior_rows: DataFrame) -> DataFrame:
    """Rows of the one-table cleaned families with a flag per family."""
    fam = F.col("family")
    return behavior_rows.select("userId", "gameId", "date", "hourOfDay", "status", "amount",
                                (fam == F.lit(FAMILY_TABLES["level"])).alias("_level"),
                                (fam == F.lit(FAMILY_TABLES["ad"])).alias("_ad"),
                                (fam == F.lit(FAMILY_TABLES["purchase"])).alias("_purchase"))


def hour_state(cleaned: DataFrame) -> DataFrame:
    """Counters of every hour, those without level events too, with the number of level events (``_levels``).

    What ``merged_hours`` adds up over batches; ``hourly_from_state`` makes the hourly rollup of it.
    """
    return _hourly_counts(_family_flags(cleaned.where(F.col("family") != F.lit(FAMILY_TABLES["player"]))), "levels")


def merged_hours(states: DataFrame) -> DataFrame:
    return states.groupBy(*HOUR_KEYS).agg(*[F.sum(c).alias(c) for c in ("_levels", *MEASURES)])


def hourly_from_state(state: DataFrame, reg: DataFrame) -> DataFrame:
    """The hourly rollup (level-driven) of merged counters and the players' registration."""
    held = state.where(F.col("_levels") > 0).drop("_levels")
    return finish_hourly(held.join(reg.select(*USER_KEYS, "flagOrganic", "dateRegistration"), list(USER_KEYS), "left"))


def hourly_rollup_from_clean(cleaned: DataFrame, months: T.MonthRange | None = None,
                             driver: str = "levels") -> DataFrame:
    """The hourly rollup from the one-table cleaned families (``clean.clean_events``),
    e.g. read back from the raw table: one row per (event, family), keys already
    trimmed, so the three families' counters come from one ``groupBy`` as well."""
    fam = F.col("family")
    beh = cleaned.where(fam != F.lit(FAMILY_TABLES["player"]))
    if months is not None:
        beh = beh.where(months.date_filter(F.col("date")))
    reg = registration(family_rows(cleaned, "player"))
    return finish_hourly(_hourly_agg(_family_flags(beh), driver).join(reg, list(USER_KEYS), "left"))


def _period_aggs() -> list[Column]:
    return [F.max("flagOrganic").alias("flagOrganic"),
            F.min("dateRegistration").alias("dateRegistration"),
            *[F.sum(m).alias(m) for m in MEASURES]]


def daily_rollup(hourly: DataFrame) -> DataFrame:
    """Per (userId, gameId, date, partOfDay) from the hourly rollup."""
    return hourly.groupBy(*DAY_KEYS).agg(*_period_aggs(), F.max("dayOfWeek").alias("dayOfWeek"))


def monthly_rollup(daily: DataFrame) -> DataFrame:
    """Per (userId, gameId, codMonth, partOfDay) from the daily rollup.

    The hourly rollup works as input too, with the same result (measures are sums, the
    flag a max and registration a min), saving the daily aggregation and its shuffle.
    """
    return (daily.withColumn("codMonth", T.cod_month(F.col("date")))
            .groupBy(*MONTH_KEYS).agg(*_period_aggs()))


PREVIEW_ROWS = 15


def preview_latest(rollup: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """Latest ``n`` rows by period, newest first, ties broken by the remaining keys."""
    period = "date" if "date" in rollup.columns else "codMonth"
    keys = [k for k in ("userId", "gameId", "hourOfDay", "partOfDay") if k in rollup.columns]
    return rollup.orderBy(F.col(period).desc(), *[F.col(k).asc_nulls_first() for k in keys]).limit(n)
