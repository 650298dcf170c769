"""Events from a collection of JSON documents whose fields' types drift.

Each line is parsed once, as VARIANT. A field is taken at its declared type if its value converts without loss (a number
kept as text, an integer as a float); otherwise the document is set aside with the reason, never dropped. Schemas of
several sources merge by widening along a lattice instead of failing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DataType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)

from .schemas import EVENT_SCHEMA

# Why a document is set aside.
NOT_JSON, NOT_AN_OBJECT, MISSING, WRONG_TYPE = "not JSON", "not an object", "missing", "type of"

#: What each type widens to, step by step; all end in text.
_WIDER: dict[type, list[DataType]] = {
    BooleanType: [StringType()], IntegerType: [LongType(), DoubleType(), StringType()], LongType: [DoubleType(), StringType()],
    DoubleType: [StringType()], DateType: [TimestampNTZType(), StringType()], TimestampNTZType: [StringType()], StringType: []}


def widened(a: DataType, b: DataType) -> DataType:
    """The narrowest type that both types widen to."""
    if type(a) not in _WIDER or type(b) not in _WIDER:
        if a == b:
            return a
        raise ValueError(f"no type holds both {a.simpleString()} and {b.simpleString()}")
    ups = [a, *_WIDER[type(a)]]
    return next(t for t in ups if t in [b, *_WIDER[type(b)]])


def widened_schema(schemas: Sequence[StructType]) -> StructType:
    """All fields, nullable, in first-seen order, each of the narrowest type that holds every schema's."""
    seen: dict[str, DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            seen[f.name] = widened(seen[f.name], f.dataType) if f.name in seen else f.dataType
    return StructType([StructField(n, t, True) for n, t in seen.items()])


def _value(field: StructField) -> tuple[Column, Column, Column]:
    """A field's value at its declared type, whether the document has one, and whether it is lost in conversion."""
    path = f"$.{field.name}"
    raw = F.try_variant_get("doc", path, "variant")
    held = raw.isNotNull() & ~F.is_variant_null(raw)
    nested = F.schema_of_variant(raw).rlike("^(OBJECT|ARRAY)")
    value = F.try_variant_get("doc", path, field.dataType.simpleString())
    lost = value.isNull() | nested
    if isinstance(field.dataType, (IntegerType, LongType)):
        as_double = F.try_variant_get("doc", path, "double")
        lost = lost | (F.schema_of_variant(raw).rlike("^(DOUBLE|FLOAT|DECIMAL)") & (as_double != F.floor(as_double)))
    return F.when(held & ~lost, value), held, held & lost


def classified(lines: DataFrame, schema: StructType = EVENT_SCHEMA, required: Sequence[str] = ("timestamp",)) -> DataFrame:
    """document, event (a struct of ``schema``) and reasons (empty for a good document) of every line (column value).

    Fields that the schema does not name are ignored; an absent or null field is null, but for ``required`` ones. Empty and
    null lines are not JSON.
    """
    rows = lines.select(F.col("value").alias("document"), F.try_parse_json("value").alias("doc"))
    fields = {f.name: _value(f) for f in schema.fields}
    is_object = F.schema_of_variant("doc").startswith("OBJECT")
    absent = [F.when(~fields[name][1], F.lit(f"{MISSING} {name}")) for name in required]
    wrong = [F.when(lost, F.lit(f"{WRONG_TYPE} {name}")) for name, (_, _, lost) in fields.items()]
    reasons = (F.when(F.col("doc").isNull(), F.array(F.lit(NOT_JSON))).when(~is_object, F.array(F.lit(NOT_AN_OBJECT)))
               .otherwise(F.array_compact(F.array(*absent, *wrong))))
    return rows.select("document", F.struct(*[v.alias(n) for n, (v, _, _) in fields.items()]).alias("event"), reasons.alias("reasons"))


def good_events(rows: DataFrame) -> DataFrame:
    """The events of ``classified`` documents without a reason against them."""
    return rows.where(F.size("reasons") == 0).select("event.*")


def quarantined(rows: DataFrame) -> DataFrame:
    """document, reason: a row per reason of every document that is set aside."""
    return rows.where(F.size("reasons") > 0).select("document", F.explode("reasons").alias("reason"))


def observed_schema(lines: DataFrame) -> DataFrame:
    """One row: the merged schema of all documents, as Spark's variant functions describe it (for a look at drift)."""
    return lines.select(F.try_parse_json("value").alias("doc")).agg(F.schema_of_variant_agg("doc").alias("observed"))


def read_collection(spark: SparkSession, path: str, schema: StructType = EVENT_SCHEMA,
                    required: Sequence[str] = ("timestamp",)) -> DataFrame:
    """``classified`` documents of the text files under ``path``, one document a line.

    Read twice where good and quarantined rows are both wanted; store it first then.
    """
    return classified(spark.read.text(path), schema, required)
