import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from playerlytics.sources import schemas as S


def test_merge_first_seen_order_nullable():
    merged = S.BEHAVIOR_SCHEMA
    assert merged.fieldNames()[:8] == ["userId", "gameId", "levelId", "levelDifficulty", "levelProgress",
                                       "status", "timestamp", "timezone"]
    assert merged.fieldNames()[8:] == ["placementId", "adType", "itemId", "category", "amount", "currency"]
    assert all(f.nullable for f in merged.fields)


def test_merge_rejects_type_conflict():
    a = StructType([StructField("x", StringType(), False)])
    b = StructType([StructField("x", LongType(), True)])
    with pytest.raises(ValueError):
        S.merge_schemas([a, b])


def test_event_schema_is_union():
    assert set(S.EVENT_SCHEMA.fieldNames()) == set(S.PLAYER_EVENT.fieldNames()) | set(S.BEHAVIOR_SCHEMA.fieldNames())
