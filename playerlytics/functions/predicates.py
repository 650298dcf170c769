"""Event vocabulary and the predicates built on it (case-sensitive equality)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Action, attribution and status words of the game events.
ACTION_SIGN_UP = "SIGN_UP"
ATTRIBUTION_ORGANIC = "organic"
LEVEL_COMPLETED = "COMPLETED"
LEVEL_STARTED = "STARTED"
AD_WATCHED = "WATCHED"
AD_IGNORED = "IGNORED"
AD_PROPOSED = "PROPOSED"
PURCHASE_DONE = "DONE"
PURCHASE_REJECTED = "REJECTED"
PURCHASE_CANCELED = "CANCELED"

# Labels of the organic flag.
ORGANIC_LABELS = {0: "not organic", 1: "organic"}

# Discriminator column of each event family: a row belongs to every family whose
# discriminator is not null (families are not exclusive).
FAMILY_DISCRIMINATORS = {
    "player": "attribution",
    "level": "levelId",
    "ad": "adType",
    "purchase": "amount",
}


def is_family(family: str) -> Column:
    return F.col(FAMILY_DISCRIMINATORS[family]).isNotNull()


def is_behavior() -> Column:
    """Level, ad or purchase event."""
    return is_family("level") | is_family("ad") | is_family("purchase")


def status_is(value: str, status: Column | None = None) -> Column:
    return (F.col("status") if status is None else status) == F.lit(value)


def is_new_player() -> Column:
    return F.col("action") == F.lit(ACTION_SIGN_UP)


def is_organic() -> Column:
    return F.col("attribution") == F.lit(ATTRIBUTION_ORGANIC)


def is_active_level_row(completed: str = "numLevelsCompleted", started: str = "numLevelsStarted") -> Column:
    """A player played: some level started or completed."""
    return (F.col(started) > 0) | (F.col(completed) > 0)


def organic_label(flag: Column) -> Column:
    """0 -> "not organic", 1 -> "organic"; any other value fails the query."""
    out = None
    for value, label in ORGANIC_LABELS.items():
        out = (F.when(flag == value, F.lit(label)) if out is None
               else out.when(flag == value, F.lit(label)))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown organic flag: "), flag.cast("string"))))
