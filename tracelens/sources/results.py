"""Drift tables, complexity tables and result tables on disk."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

DRIFT_SCHEMA = "calc_change_id string, calc_change_index string, calc_change_type string, calc_change_moment string, calc_drift_id string"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A CSV with a header, or None where there is none."""
    reader = spark.read.option("header", True)
    try:
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_drift(spark: SparkSession, path: str) -> DataFrame:
    """One drift table as it is."""
    found = _read(spark, path, DRIFT_SCHEMA)
    return spark.createDataFrame([], DRIFT_SCHEMA) if found is None else found


def change_points(drift: DataFrame) -> DataFrame:
    """change_id, change_index, change_type, change_moment of real change points: rows with id "na" go."""
    real = drift.where(F.lower("calc_change_id") != "na")
    return real.select(F.col("calc_change_id").cast("long").alias("change_id"), F.col("calc_change_index").cast("double").cast("long").alias("change_index"), F.col("calc_change_type").alias("change_type"), F.to_timestamp("calc_change_moment").alias("change_moment"))


def until_first_na(rows: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """Rows of each table before its first null or "na" in ``column``."""
    gone = F.max((F.col(column).isNull() | (F.lower(column) == "na")).cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_gone", gone).where("_gone = 0").drop("_gone")


def union_drifts(spark: SparkSession, paths: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(dataset, configuration, path) -> dataset, configuration, change_point, change_moment; missing files are left out.

    A drift table is a small file that one task reads, so its rows keep their order.
    """
    out = spark.createDataFrame([], "dataset string, configuration string, row long, " + DRIFT_SCHEMA)
    for dataset, configuration, path in paths:
        found = _read(spark, path, DRIFT_SCHEMA)
        if found is not None:
            tagged = found.withColumn("row", F.monotonically_increasing_id()).select(F.lit(dataset).alias("dataset"), F.lit(configuration).alias("configuration"), "row", *found.columns)
            out = out.unionByName(tagged)
    kept = until_first_na(out, ["dataset", "configuration"], "row", "calc_drift_id")
    return kept.select("dataset", "configuration", F.col("calc_change_index").cast("double").cast("long").alias("change_point"), F.to_timestamp("calc_change_moment").alias("change_moment"))


def read_complexity(spark: SparkSession, paths: Iterable[tuple[str, str]]) -> DataFrame | None:
    """(dataset, path) -> complexity tables with whole-number columns and both trace counts; missing files are left out.

    ``n_traces`` is last less first index, as result tables have it; ``n_traces_in_window`` counts both ends.
    """
    out = None
    for dataset, path in paths:
        found = _read(spark, path)
        if found is not None:
            found = found.withColumn("dataset", F.lit(dataset))
            out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return None if out is None else with_trace_counts(out)


def with_trace_counts(windows: DataFrame) -> DataFrame:
    whole = [c for c in ("window_id", "first_index", "last_index", "start_cp", "end_cp") if c in windows.columns]
    for c in whole:
        windows = windows.withColumn(c, F.col(c).cast("long"))
    return windows.withColumn("n_traces", F.col("last_index") - F.col("first_index")).withColumn("n_traces_in_window", F.col("last_index") - F.col("first_index") + 1)


def write_complexity(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("dataset", "config").parquet(path)


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Raw metrics, an analysis or log statistics, as Parquet or CSV."""
    rows.write.mode("overwrite").option("header", True).format(kind).save(path)


def text_numbers(rows: DataFrame, digits: int = 10, whole: Sequence[str] = ("n", "n_pop")) -> DataFrame:
    """Doubles as text with fixed decimals, null for null or infinite; ``whole`` columns as whole numbers."""
    def one(c: str, t: str):
        if c in whole:
            return F.col(c).cast("long").alias(c)
        if t == "double":
            return F.when(F.abs(c) < float("inf"), F.format_string(f"%.{digits}f", F.col(c))).alias(c)
        return F.col(c)

    return rows.select(*[one(c, t) for c, t in rows.dtypes])


def write_master(rows: DataFrame, path: str) -> None:
    text_numbers(rows).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def read_master(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """None for a missing file; text numbers by schema."""
    return _read(spark, path, schema)


def in_all_experiments(rows: DataFrame) -> DataFrame:
    """Datasets that every experiment has."""
    total = rows.agg(F.countDistinct("experiment").alias("k"))
    have = rows.groupBy("dataset").agg(F.countDistinct("experiment").alias("k"))
    return have.join(F.broadcast(total), "k").select("dataset")


def read_measures(spark: SparkSession, paths: Iterable[tuple[str, str, str]]) -> DataFrame | None:
    """(experiment, dataset, path) -> measures of all of them, of the datasets that every experiment has.

    Column names are trimmed; a table without sample_id gets row numbers; one without sample_size is an error.
    """
    out = None
    for experiment, dataset, path in paths:
        found = _read(spark, path)
        if found is None:
            continue
        found = found.toDF(*[c.strip() for c in found.columns])
        if "sample_size" not in found.columns:
            raise ValueError(f"{path} has no column sample_size")
        if "sample_id" not in found.columns:
            found = with_sample_ids(found.withColumn("_row", F.monotonically_increasing_id()), ("sample_size",), "_row").drop("_row")
        found = found.withColumn("sample_id", F.col("sample_id").cast("string")).withColumn("experiment", F.lit(experiment)).withColumn("dataset", F.lit(dataset))
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return None if out is None else out.join(in_all_experiments(out), "dataset", "left_semi")


def measure_columns(rows: DataFrame, wanted: Sequence[str] | None = None) -> list[str]:
    """The measures asked for, which must be there, or all numeric columns but the keys."""
    if wanted:
        missing = [c for c in wanted if c not in rows.columns]
        if missing:
            raise ValueError(f"measures not found: {missing}")
        return list(wanted)
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ("sample_size", "sample_id")]


def with_sample_ids(rows: DataFrame, keys: Sequence[str] = ("metric", "sample_size"), order: str = "row") -> DataFrame:
    """Numbers samples within ``keys`` where a table has no sample_id."""
    if "sample_id" in rows.columns:
        return rows
    return rows.withColumn("sample_id", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("string"))


def catalogue(spark: SparkSession, path: str, types: Sequence[str] | None = None) -> DataFrame:
    """dataset, name, short_name, type, path of a JSON catalogue {dataset: {...}}, by type where asked for."""
    text = spark.read.option("wholetext", True).text(path)
    entry = "map<string, struct<name:string,short_name:string,type:string,path:string>>"
    rows = text.select(F.explode(F.from_json("value", entry)).alias("dataset", "e")).select("dataset", "e.*")
    return rows.where(F.col("type").isin(list(types))) if types else rows
