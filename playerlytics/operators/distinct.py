"""Exact distinct players that merge (A8, A13, L3): numbered players, and bitmaps of their numbers stored per day.

Counting distinct players again for every month, game or cluster means shuffling all rows each time. Here each player has
a number, given once; a bitmap per group and 32,768 numbers holds who is there, and any coarser group is an
or of stored bitmaps and a count of their bits, with partial aggregation before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers are dealt in as many series, so that new players are numbered in as many tasks. Fixed for a table of numbers.
SERIES = 1024
NUMBER_SCHEMA = "userId string, number long"


def new_numbers(known: DataFrame, users: DataFrame) -> DataFrame:
    """userId, number of the players of ``users`` (column userId) that ``known`` lacks; nulls get none.

    Within a series (by the hash of the id) numbers go on where the known ones end, in order of the ids.
    """
    fresh = users.select("userId").where("userId IS NOT NULL").distinct().join(known, "userId", "left_anti")
    fresh = fresh.withColumn("series", F.pmod(F.xxhash64("userId"), F.lit(SERIES)))
    ends = known.groupBy(F.pmod("number", F.lit(SERIES)).alias("series")).agg((F.max(F.floor(F.col("number") / SERIES)) + 1).alias("end"))
    place = F.row_number().over(Window.partitionBy("series").orderBy("userId")) - 1
    return (fresh.withColumn("place", place).join(ends, "series", "left")
            .select("userId", ((F.coalesce("end", F.lit(0)) + F.col("place")) * SERIES + F.col("series")).cast("long").alias("number")))


def bitmaps(rows: DataFrame, numbers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, bucket, bits: the players of each group. A group of null players alone keeps a row without bits."""
    held = rows.select(*keys, "userId").join(numbers, "userId", "left").withColumn("n", F.col("number") + 1)
    return (held.groupBy(*keys, F.bitmap_bucket_number("n").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits")))


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bitmaps of coarser groups, or of several runs."""
    return parts.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_players(parts: DataFrame, keys: Sequence[str], name: str = "players") -> DataFrame:
    """The number of distinct players of each group of ``keys`` (columns of ``parts``)."""
    return merged(parts, keys).groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))
