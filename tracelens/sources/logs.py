"""Reading and writing event logs: XES, CSV, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATTRIBUTE = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())])
_ATTRIBUTES = T.ArrayType(_ATTRIBUTE)
_EVENT = T.StructType([T.StructField("string", _ATTRIBUTES), T.StructField("date", _ATTRIBUTES)])
_TRACE = T.StructType([T.StructField("string", _ATTRIBUTES), T.StructField("event", T.ArrayType(_EVENT))])


def _attribute(column: str, key: str):
    return F.get(F.filter(column, lambda a: a["_key"] == key), F.lit(0))["_value"]


def read_xes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events of XES files (plain or gzip): case_id, activity, ts, o0 (place in the trace), resource.

    Fixed values of the format: concept:name, time:timestamp, org:resource.
    """
    raw = spark.read.format("xml").option("rowTag", "trace").schema(_TRACE).load(path)
    rows = raw.select(_attribute("string", "concept:name").alias("case_id"), F.posexplode("event").alias("o0", "e"))
    return rows.select(
        "case_id", _attribute("e.string", "concept:name").alias("activity"), F.to_timestamp(_attribute("e.date", "time:timestamp")).alias("ts"),
        F.col("o0").cast("long").alias("o0"), _attribute("e.string", "org:resource").alias("resource"),
    )


def read_csv_log(spark: SparkSession, path: str | list[str], case: str, activity: str, ts: str, resource: str | None = None, sep: str = ",", ts_format: str | None = None) -> DataFrame:
    """Events of CSV files (plain or gzip) under the usual names; timestamps are UTC, o0 keeps the order in a file."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    when = F.to_timestamp(F.col(f"`{ts}`"), ts_format) if ts_format else F.to_timestamp(F.col(f"`{ts}`"))
    names = [F.col(f"`{case}`").alias("case_id"), F.col(f"`{activity}`").alias("activity"), when.alias("ts"), F.monotonically_increasing_id().alias("o0")]
    return raw.select(*names, *([F.col(f"`{resource}`").alias("resource")] if resource else []))


def write_log(events: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """An event log as Parquet."""
    events.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
