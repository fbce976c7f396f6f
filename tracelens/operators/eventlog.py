"""Event logs as tables: events, ordered traces, variants and species counts.

Events have ``case_id, activity, ts`` and order columns; traces have ``trace_index, case_id,
start_ts, acts, len``.  Undefined numbers are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize


def event_log(df: DataFrame, case: Column | str, activity: Column | str | Sequence[str], ts: Column | str, *order: Column | str, keep: Sequence[str] = ()) -> DataFrame:
    """Any table as an event log; of several activity columns the first that is not null counts."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    name = F.coalesce(*map(col, activity)) if isinstance(activity, (list, tuple)) else col(activity)
    orders = [col(c).alias(f"o{i}") for i, c in enumerate(order)]
    return df.select(*keep, col(case).cast("string").alias("case_id"), name.cast("string").alias("activity"), utc(col(ts)).alias("ts"), *orders)


def utc(ts: Column) -> Column:
    """A timestamp without a zone, in UTC (the session's zone must be UTC for text input)."""
    return ts.cast("timestamp")


def traces(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Activities of each case in order; events without a name take their place in time only."""
    order = [c for c in events.columns if c.startswith("o") and c[1:].isdigit()]
    rows = F.array_sort(F.collect_list(F.struct("ts", *order, "activity")))
    out = events.groupBy(*keys, "case_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), rows.alias("r"))
    acts = F.filter(F.transform("r", lambda x: x["activity"]), lambda a: a.isNotNull())
    return out.select(*keys, "case_id", "start_ts", acts.alias("acts"), F.size("r").alias("len"))


def index_traces(rows: DataFrame) -> DataFrame:
    """Adds ``trace_index``: dense from 0 by start, ties by case.

    A range-partitioned sort is written once; its partitions' sizes give each one's first
    index.  No task sees all traces, and the driver sees one number for each partition.
    """
    ordered = rows.repartitionByRange("start_ts", "case_id").sortWithinPartitions("start_ts", "case_id")
    ordered = materialize(ordered.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}
    first, total = {}, 0
    for part in sorted(sizes):
        first[part], total = total, total + sizes[part]
    if not first:
        return ordered.drop("part", "place").withColumn("trace_index", F.lit(0).cast("long"))
    starts = F.broadcast(rows.sparkSession.createDataFrame(list(first.items()), "part int, first long"))
    return ordered.join(starts, "part").withColumn("trace_index", F.col("first") + F.col("place")).drop("part", "place", "first")


def head_traces(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` traces in time, as a test log."""
    return rows.where(F.col("trace_index") < n)


def pairs(acts: Column | str) -> Column:
    """Directly-follows pairs of a trace, as structs a, b."""
    acts = F.col(acts) if isinstance(acts, str) else acts
    n = F.greatest(F.size(acts) - 1, F.lit(0))
    return F.zip_with(F.slice(acts, F.lit(1), n), F.slice(acts, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def variants(members: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """keys, acts, len, n (traces of the variant), first_pos (where it comes first)."""
    first = F.min("pos") if "pos" in members.columns else F.lit(None).cast("long")
    return members.groupBy(*keys, "acts").agg(F.max("len").alias("len"), F.count(F.lit(1)).alias("n"), first.alias("first_pos"))


def activity_counts(kinds: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """Occurrences of each activity, from variants."""
    return kinds.select(*keys, "n", F.explode("acts").alias("activity")).groupBy(*keys, "activity").agg(F.sum("n").alias("n"))


def edge_counts(kinds: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """Occurrences of each directly-follows pair, from variants."""
    return kinds.select(*keys, "n", F.explode(pairs("acts")).alias("e")).select(*keys, "e.a", "e.b", "n").groupBy(*keys, "a", "b").agg(F.sum("n").alias("n"))


def edge_incidence(kinds: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """Traces that contain each pair."""
    return kinds.select(*keys, "n", F.explode(F.array_distinct(pairs("acts"))).alias("e")).select(*keys, "e.a", "e.b", "n").groupBy(*keys, "a", "b").agg(F.sum("n").alias("n"))


def species(members: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """keys, species_kind (activity, dfg_edge, variant), species (text), n."""
    kinds = variants(members, keys)
    parts = [
        activity_counts(kinds, keys).select(*keys, F.lit("activity").alias("species_kind"), F.col("activity").alias("species"), "n"),
        edge_counts(kinds, keys).select(*keys, F.lit("dfg_edge").alias("species_kind"), F.to_json(F.struct("a", "b")).alias("species"), "n"),
        kinds.select(*keys, F.lit("variant").alias("species_kind"), F.to_json("acts").alias("species"), "n"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def log_statistics(rows: DataFrame, kind: str, description: str, keys: Sequence[str] = ("log",)) -> DataFrame:
    """Six basic measures of whole logs, with their type, name and description."""
    from .measures import basic

    out = basic(rows.withColumn("pos", F.col("trace_index")), keys)
    return out.select(
        F.initcap(F.lit(kind)).alias("type"), *keys, "number_of_events", "number_of_traces", "number_of_distinct_activities",
        "number_of_distinct_traces", "number_of_distinct_directly_follows_relations", "avg_trace_length", F.lit(description).alias("description"),
    )


def flatten_measurements(df: DataFrame, column: str = "measurements") -> DataFrame:
    """The fields of a nested column as columns."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")
