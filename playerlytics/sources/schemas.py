"""Declared schemas of the event families and of the rollup tables."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, DataType, DateType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType)


def _struct(*fields: tuple[str, DataType]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


S, L, D, I, DT = StringType(), LongType(), DoubleType(), IntegerType(), DateType()

# One schema per event family; a family is recognised by its non-null discriminator.
PLAYER_EVENT = _struct(("userId", S), ("gameId", S), ("attribution", S), ("action", S),
                       ("timestamp", L), ("timezone", S))
LEVEL_EVENT = _struct(("userId", S), ("gameId", S), ("levelId", S), ("levelDifficulty", S),
                      ("levelProgress", S), ("status", S), ("timestamp", L), ("timezone", S))
AD_EVENT = _struct(("userId", S), ("gameId", S), ("placementId", S), ("adType", S),
                   ("status", S), ("timestamp", L), ("timezone", S))
PURCHASE_EVENT = _struct(("userId", S), ("gameId", S), ("itemId", S), ("category", S),
                         ("amount", D), ("currency", S), ("status", S), ("timestamp", L),
                         ("timezone", S))


def merge_schemas(schemas: list[StructType]) -> StructType:
    """Union of fields in first-seen order, all nullable.

    A field name seen with two different types is an error (instead of a duplicate
    column).
    """
    seen: dict[str, DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            prior = seen.get(f.name)
            if prior is None:
                seen[f.name] = f.dataType
            elif prior != f.dataType:
                raise ValueError(f"field {f.name!r} has two types: {prior.simpleString()} "
                                 f"and {f.dataType.simpleString()}")
    return StructType([StructField(n, t, True) for n, t in seen.items()])


PLAYER_INFO_SCHEMA = merge_schemas([PLAYER_EVENT])
BEHAVIOR_SCHEMA = merge_schemas([LEVEL_EVENT, AD_EVENT, PURCHASE_EVENT])
# The wide raw collection: every family in one document type.
EVENT_SCHEMA = merge_schemas([PLAYER_EVENT, LEVEL_EVENT, AD_EVENT, PURCHASE_EVENT])

# Measures of the rollups, in table order. Counters are sums of 0/1, amounts sums of money.
MEASURES = ("numLevelsCompleted", "numLevelsStarted", "numAdsWatched", "numAdsIgnored",
            "numAdsProposed", "numPurchasesDone", "amountPurchasesDoneDol",
            "numPurchasesRejected", "amountPurchasesRejectedDol", "numPurchasesCanceled",
            "amountPurchasesCanceledDol")
AMOUNTS = tuple(m for m in MEASURES if m.startswith("amount"))

_MEASURE_FIELDS = tuple((m, D if m in AMOUNTS else L) for m in MEASURES)

# Read schemas of the daily and monthly rollup tables (dayOfWeek is written to the daily
# table but not read back; codMonth is read as an int).
DAILY_ROLLUP_SCHEMA = _struct(("userId", S), ("gameId", S), ("flagOrganic", I),
                              ("dateRegistration", DT), *_MEASURE_FIELDS, ("partOfDay", S),
                              ("date", DT))
MONTHLY_ROLLUP_SCHEMA = _struct(("userId", S), ("gameId", S), ("flagOrganic", I),
                                ("dateRegistration", DT), *_MEASURE_FIELDS, ("partOfDay", S),
                                ("codMonth", I))

# The hourly table as written, and the raw table: one row per (event, family).
HOURLY_ROLLUP_SCHEMA = _struct(("userId", S), ("gameId", S), ("flagOrganic", I), ("dateRegistration", DT),
                               *_MEASURE_FIELDS, ("partOfDay", S), ("dayOfWeek", I), ("date", DT), ("hourOfDay", I))
RAW_SCHEMA = _struct(("userId", S), ("gameId", S), ("attribution", S), ("action", S), ("levelId", S),
                     ("levelDifficulty", S), ("levelProgress", S), ("status", S), ("timezone", S), ("hourOfDay", I),
                     ("placementId", S), ("adType", S), ("itemId", S), ("category", S), ("amount", D), ("currency", S),
                     ("family", S), ("date", DT))


def cluster_schema(period: str) -> StructType:
    """A segmentation's labelled rows: features, vectors as arrays, the cluster, and the period columns."""
    vectors = (("featureVector", ArrayType(D)), ("scaledFeatures", ArrayType(D)))
    return _struct(("userId", S), ("gameId", S), ("numLevelsStarted", L), ("numLevelsCompleted", L), ("numAdsWatched", L),
                   ("numPurchasesDone", L), ("partOfDayNumber", I), ("flagOrganic", I), *vectors, ("cluster", I),
                   (period, DT if period == "date" else I), ("partOfDay", S))


# Table names of the rollups and their partition columns.
HOURLY_TABLE = "hh_playerbehavior"
DAILY_TABLE = "hd_playerbehavior"
MONTHLY_TABLE = "hm_playerbehavior"
# The four cleaned families live in one table partitioned by (family, date).
RAW_TABLE = "raw-data"
TABLE_PARTITIONS = {
    RAW_TABLE: ("family", "date"),
    HOURLY_TABLE: ("date", "hourOfDay"),
    DAILY_TABLE: ("date", "partOfDay"),
    MONTHLY_TABLE: ("codMonth", "partOfDay"),
}
TABLE_SCHEMAS = {RAW_TABLE: RAW_SCHEMA, HOURLY_TABLE: HOURLY_ROLLUP_SCHEMA, DAILY_TABLE: DAILY_ROLLUP_SCHEMA,
                 MONTHLY_TABLE: MONTHLY_ROLLUP_SCHEMA}
GRANULARITY_TABLE = {"daily": (DAILY_TABLE, "date", DAILY_ROLLUP_SCHEMA),
                     "monthly": (MONTHLY_TABLE, "codMonth", MONTHLY_ROLLUP_SCHEMA)}
# Partition columns in a store (``sources.versions``): dates and months, whatever the number of hours in them.
STORE_PARTITIONS = {RAW_TABLE: ("family", "date"), HOURLY_TABLE: ("date",), DAILY_TABLE: ("date",), MONTHLY_TABLE: ("codMonth",)}
