"""Documents of drifting types: what converts without loss is taken, the rest is set aside with its reason."""

import json

import pytest
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StringType, StructType

from playerlytics.sources import documents as D
from playerlytics.sources.schemas import EVENT_SCHEMA

GOOD = {"userId": "u", "gameId": "G", "timestamp": 1704067200000, "amount": 2.5, "status": "DONE"}


def outcome(spark, *lines):
    rows = D.classified(spark.createDataFrame([(x,) for x in lines], "value string")).cache()
    return list(rows.toLocalIterator())


@pytest.mark.parametrize("change,name,value", [
    ({}, "timestamp", 1704067200000), ({"timestamp": "1704067200000"}, "timestamp", 1704067200000), ({"timestamp": 1704067200000.0}, "timestamp", 1704067200000),
    ({"amount": 3}, "amount", 3.0), ({"amount": "3.25"}, "amount", 3.25), ({"userId": 12}, "userId", "12"), ({"userId": None}, "userId", None),
    ({"other": [1, {"a": 2}]}, "userId", "u"), ({"userId": True}, "userId", "true")])
def test_values_that_convert(spark, change, name, value):
    [row] = outcome(spark, json.dumps({**GOOD, **change}))
    assert row.reasons == [] and row.event[name] == value


@pytest.mark.parametrize("line,reasons", [
    ("", [D.NOT_JSON]), (None, [D.NOT_JSON]), ('{"userId": "u"', [D.NOT_JSON]), ("[1]", [D.NOT_AN_OBJECT]), ("7", [D.NOT_AN_OBJECT]),
    ("null", [D.NOT_AN_OBJECT]), ("{}", ["missing timestamp"]), (json.dumps({**GOOD, "timestamp": None}), ["missing timestamp"]),
    (json.dumps({**GOOD, "timestamp": "soon"}), ["type of timestamp"]), (json.dumps({**GOOD, "timestamp": 1.5}), ["type of timestamp"]),
    (json.dumps({**GOOD, "timestamp": 1e300}), ["type of timestamp"]), (json.dumps({**GOOD, "userId": {"id": 1}}), ["type of userId"]),
    (json.dumps({**GOOD, "amount": [1.0]}), ["type of amount"]), (json.dumps({**GOOD, "timestamp": None, "amount": "x"}), ["missing timestamp", "type of amount"])])
def test_documents_set_aside(spark, line, reasons):
    [row] = outcome(spark, line)
    assert sorted(row.reasons) == sorted(reasons)


def test_collection_round_trip(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text("\n".join([json.dumps(GOOD), "{", json.dumps({**GOOD, "amount": "x", "userId": []})]) + "\n")
    rows = D.read_collection(spark, str(tmp_path / "c"))
    assert D.good_events(rows).count() == 1 and D.good_events(rows).schema.names == EVENT_SCHEMA.names
    assert sorted(r.reason for r in D.quarantined(rows).toLocalIterator()) == ["not JSON", "type of amount", "type of userId"]
    seen = D.observed_schema(spark.createDataFrame([('{"a": 1}',), ('{"a": 1.5, "b": "x"}',)], "value string")).first().observed
    assert "a:" in seen and "b: STRING" in seen


def test_types_widen(spark):
    s = StructType.fromDDL
    got = D.widened_schema([s("a int, b date, c string"), s("a bigint, d double"), s("a double, b timestamp_ntz, c int, d string")])
    assert [(f.name, f.dataType.simpleString()) for f in got.fields] == [("a", "double"), ("b", "timestamp_ntz"), ("c", "string"), ("d", "string")]
    kinds = [IntegerType(), LongType(), DoubleType(), StringType(), DateType()]
    for a in kinds:
        for b in kinds:
            assert D.widened(a, b) == D.widened(b, a)
    with pytest.raises(ValueError):
        D.widened_schema([s("a array<int>"), s("a int")])
