"""Per-family cleaning (P1-P4): keep one family, trim its text keys, add the local hour.

Trimming is ``trim`` (spaces only). Columns not listed as trimmed pass through as they
are (e.g. ``placementId``, ``levelDifficulty``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import time as T
from ..functions.predicates import is_behavior, is_family
from ..sources.schemas import EVENT_SCHEMA

# (column, trimmed?) in output order; "hourOfDay" is computed from datetime + timezone.
_PLAYER = (("userId", True), ("gameId", True), ("attribution", True), ("action", True),
           ("date", False))
_LEVEL = (("userId", True), ("gameId", True), ("levelId", True), ("levelDifficulty", False),
          ("levelProgress", False), ("status", True), ("timezone", False), ("hourOfDay", False),
          ("date", False))
_AD = (("userId", True), ("gameId", True), ("placementId", False), ("adType", True),
       ("status", True), ("timezone", False), ("hourOfDay", False), ("date", False))
_PURCHASE = (("userId", True), ("gameId", True), ("itemId", True), ("category", True),
             ("amount", False), ("currency", True), ("status", True), ("timezone", False),
             ("hourOfDay", False), ("date", False))
FAMILY_COLUMNS = {"player": _PLAYER, "level": _LEVEL, "ad": _AD, "purchase": _PURCHASE}


def _clean(df: DataFrame, family: str) -> DataFrame:
    out = []
    for name, trimmed in FAMILY_COLUMNS[family]:
        if name == "hourOfDay":
            c = T.local_hour(F.col("datetime"), F.col("timezone"))
        elif trimmed:
            c = F.trim(F.col(name))
        else:
            c = F.col(name)
        out.append(c.alias(name))
    return df.where(is_family(family)).select(*out)


def clean_players(player_info: DataFrame) -> DataFrame:
    return _clean(player_info, "player")


def clean_levels(behavior: DataFrame) -> DataFrame:
    return _clean(behavior, "level")


def clean_ads(behavior: DataFrame) -> DataFrame:
    return _clean(behavior, "ad")


def clean_purchases(behavior: DataFrame) -> DataFrame:
    return _clean(behavior, "purchase")


# Names of the cleaned family tables.
FAMILY_TABLES = {"player": "playerEvent", "level": "levelEvent", "ad": "adEvent", "purchase": "purchaseEvent"}
# Columns of the one-table form: every family's cleaned columns, first-seen order.
CLEAN_COLUMNS = tuple(dict.fromkeys(name for cols in FAMILY_COLUMNS.values() for name, _ in cols))


def clean_events(events: DataFrame, months: T.MonthRange | None, on_bad_timezone: str = "error") -> DataFrame:
    """All four cleaned families from one scan of the raw collection.

    One row per (event, family it belongs to), with a ``family`` column holding the
    family table name and the union of the families' columns (null where a family has
    none). Player rows keep their whole history; level, ad and purchase rows are limited
    to ``months`` (None: all). The rows come from a single ``inline`` generator, so the source is
    read once however many families an event belongs to.
    """
    from ..sources.events import project_schema
    if on_bad_timezone not in ("error", "utc"):
        raise ValueError("on_bad_timezone must be 'error' or 'utc'")
    ev = project_schema(events, EVENT_SCHEMA)
    ts = F.col("timestamp")
    in_range = ts.isNotNull()
    if months is not None:
        lo, hi = months.epoch_ms_bounds()
        in_range = (ts >= F.lit(lo)) & (ts < F.lit(hi))
    ev = ev.where(is_family("player") | (is_behavior() & in_range))
    tz = T.clean_timezone(F.col("timezone"))
    if on_bad_timezone == "utc":
        tz = F.when(T.valid_timezone(tz), tz).otherwise(F.lit(T.DEFAULT_TIMEZONE))
    clock = T.utc_wall_clock(ts)
    behavior_row = is_behavior() & in_range
    prepared = ev.select(
        *[F.col(c) for c in EVENT_SCHEMA.fieldNames() if c != "timezone"],
        tz.alias("timezone"), T.date_of(clock).alias("date"),
        # hour only where a behaviour family needs it: a bad zone on other rows is ignored
        F.when(behavior_row, T.local_hour(clock, tz)).alias("hourOfDay"),
        in_range.alias("_inRange"))
    types = {**{f.name: f.dataType for f in EVENT_SCHEMA.fields}, "date": "date", "hourOfDay": "int"}
    structs = []
    for family, cols in FAMILY_COLUMNS.items():
        keep = is_family(family) if family == "player" else is_family(family) & F.col("_inRange")
        trimmed = {name: t for name, t in cols}
        fields = [F.lit(FAMILY_TABLES[family]).alias("family")]
        for name in CLEAN_COLUMNS:
            if name in trimmed:
                c = F.trim(F.col(name)) if trimmed[name] else F.col(name)
            else:
                c = F.lit(None).cast(types[name])
            fields.append(c.alias(name))
        # a family's struct is built only for events of that family
        structs.append(F.when(keep, F.struct(*fields)))
    return prepared.select(F.inline(F.array_compact(F.array(*structs))))


def family_rows(cleaned: DataFrame, family: str) -> DataFrame:
    """One family's cleaned rows, with its own columns, from the one-table form."""
    return (cleaned.where(F.col("family") == F.lit(FAMILY_TABLES[family]))
            .select(*[name for name, _ in FAMILY_COLUMNS[family]]))
