"""Table schemas and the check that guards every read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldtide.constants import ASSETS

SAMPLES = T.StructType([
    T.StructField("CDL", T.StringType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("bbox", T.StringType()),
    T.StructField("year", T.IntegerType()),
])

OBSERVATIONS = T.StructType(
    [
        T.StructField("CDL", T.StringType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
    ]
    + [T.StructField(a, T.IntegerType()) for a in ASSETS]
    + [
        T.StructField("bbox", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("tile", T.StringType()),
        T.StructField("scene_date", T.DateType()),
    ]
)

PACKED_SERIES = T.StructType([
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("num_images", T.LongType()),
    T.StructField("bands", T.BinaryType()),
    T.StructField("img_dates", T.BinaryType()),
    T.StructField("scl_vals", T.BinaryType()),
    T.StructField("tiles", T.BinaryType()),
    T.StructField("CDL", T.BinaryType()),
    T.StructField("part", T.LongType()),
    T.StructField("first_seq", T.LongType()),
    T.StructField("series_images", T.LongType()),
    T.StructField("first_day", T.IntegerType()),
    T.StructField("last_day", T.IntegerType()),
    T.StructField("day_sum", T.LongType()),
    T.StructField("bbox", T.StringType()),
    T.StructField("year", T.IntegerType()),
])

#: Columns the derived tables read from the driver tables; nothing else is opened.
SOURCES = {
    "lineitem": T.StructType([
        T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]),
    "events": T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]),
    "part": T.StructType([
        T.StructField("p_partkey", T.LongType()), T.StructField("p_size", T.IntegerType()),
    ]),
}


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns; fail before any job when one is missing or mistyped."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [
        f"{f.name}: need {f.dataType.simpleString()}, "
        f"have {have[f.name].simpleString() if f.name in have else 'nothing'}"
        for f in schema
        if have.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError("table does not match its schema: " + "; ".join(wrong))
    return df.select(*schema.names)
