"""Windows of traces by trace index, as rows of membership.

``window_traces`` has a row for each (window, trace); windows overlap freely.  Membership
comes from exploding the windows that an index belongs to, never from a range join, except
for change points, whose few boundaries are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _count(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.max("trace_index") + 1, F.lit(0))).first()[0]


def sliding(rows: DataFrame, size: int, offset: int) -> DataFrame:
    """Full windows [k * offset, k * offset + size) as window_id, pos and the traces' columns."""
    n = _count(rows)
    if size <= 0 or offset <= 0 or size > n:
        return rows.limit(0).select(F.lit(0).cast("long").alias("window_id"), F.lit(0).cast("long").alias("pos"), "*")
    last = (n - size) // offset
    i = F.col("trace_index")
    low = F.greatest(F.lit(0), F.ceil((i - (size - 1)) / offset)).cast("long")
    high = F.least(F.lit(last), F.floor(i / offset)).cast("long")
    out = rows.withColumn("window_id", F.explode(F.when(low <= high, F.sequence(low, high))))
    return out.select("window_id", (F.col("trace_index") - F.col("window_id") * offset).alias("pos"), *rows.columns)


def pairs_of_windows(rows: DataFrame, size_1: int, size_2: int, offset: int, step: int) -> DataFrame:
    """Pairs k of windows: side 1 [k * step, + size_1), side 2 [k * step + offset, + size_2); both must be full."""
    n = _count(rows)
    last = (n - max(size_1, offset + size_2)) // step if n >= max(size_1, offset + size_2) else -1
    sides = []
    for side, shift, size in ((1, 0, size_1), (2, offset, size_2)):
        i = F.col("trace_index") - shift
        low = F.greatest(F.lit(0), F.ceil((i - (size - 1)) / step)).cast("long")
        high = F.least(F.lit(last), F.floor(i / step)).cast("long")
        part = rows.withColumn("pair_id", F.explode(F.when((low <= high) & (i >= 0), F.sequence(low, high)))).withColumn("side", F.lit(side))
        sides.append(part.select("pair_id", "side", (i - F.col("pair_id") * step).alias("pos"), *rows.columns))
    return sides[0].unionByName(sides[1])


def change_point_bounds(points: DataFrame, n: int, lenient: bool = False) -> DataFrame:
    """window_id, first_index, next_index, start_cp, start_cp_type, end_cp, end_cp_type.

    ``points``: change_id, change_index, change_type.  Strict: equal or out-of-range points
    raise.  Lenient: points are taken once each, and only those inside the log.
    """
    spark = points.sparkSession
    inside = points.where((F.col("change_index") > 0) & (F.col("change_index") < n))
    if lenient:
        inside = inside.groupBy("change_index").agg(F.min(F.struct("change_id", "change_type")).alias("x")).select("x.change_id", "change_index", "x.change_type")
    else:
        total, distinct, good = points.agg(F.count(F.lit(1)), F.countDistinct("change_index"), F.count_if((F.col("change_index") > 0) & (F.col("change_index") < n))).first()
        if total != distinct or total != good:
            raise ValueError("change points must be distinct and inside the log")
    ends = spark.createDataFrame([(None, 0, None), (None, n, None)], "change_id long, change_index long, change_type string")
    # One row for each change point of a log: few, so one ordered window is enough.
    order = Window.orderBy("change_index")
    both = inside.select("change_id", F.col("change_index").cast("long").alias("change_index"), "change_type").unionByName(ends)
    return both.select(
        (F.row_number().over(order) - 1).cast("long").alias("window_id"), F.col("change_index").alias("first_index"), F.lead("change_index").over(order).alias("next_index"),
        F.col("change_id").alias("start_cp"), F.col("change_type").alias("start_cp_type"), F.lead("change_id").over(order).alias("end_cp"), F.lead("change_type").over(order).alias("end_cp_type"),
    ).where(F.col("next_index") > F.col("first_index"))


def by_change_points(rows: DataFrame, points: DataFrame, lenient: bool = False) -> DataFrame:
    """Membership by change points, with the points on either side."""
    bounds = change_point_bounds(points, _count(rows), lenient)
    here = rows.join(F.broadcast(bounds), (F.col("trace_index") >= F.col("first_index")) & (F.col("trace_index") < F.col("next_index")))
    return here.select("window_id", (F.col("trace_index") - F.col("first_index")).alias("pos"), *rows.columns, "start_cp", "start_cp_type", "end_cp", "end_cp_type")


def window_metadata(members: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """keys, first and last index, size, moments of the first and last trace, and change points where known."""
    extra = [F.max(c).alias(c) for c in ("start_cp", "start_cp_type", "end_cp", "end_cp_type") if c in members.columns]
    return members.groupBy(*keys).agg(
        F.min("trace_index").alias("first_index"), F.max("trace_index").alias("last_index"), F.count(F.lit(1)).alias("size"),
        F.min_by("start_ts", "trace_index").alias("start_moment"), F.max_by("start_ts", "trace_index").alias("end_moment"), *extra,
    )


def window_rows(members: DataFrame, measures: DataFrame, keys: Sequence[str] = ("window_id",), namespace: str = "") -> DataFrame:
    """Metadata as info_*, measures as measure_* (with a namespace after the prefix, if given)."""
    tag = f"{namespace}_" if namespace else ""
    info = window_metadata(members, keys)
    info = info.select(*keys, *[F.col(c).alias(f"info_{c}") for c in info.columns if c not in keys])
    named = measures.select(*keys, *[F.col(c).alias(f"measure_{tag}{c}") for c in measures.columns if c not in keys])
    return info.join(named, list(keys))


def compare_pairs(measures: DataFrame, columns: Sequence[str]) -> DataFrame:
    """w1_*, w2_* and delta_* = w2 - w1 for each pair, from measures by pair_id and side."""
    side = lambda s, p: measures.where(F.col("side") == s).select("pair_id", *[F.col(c).alias(f"{p}_{c}") for c in columns])
    out = side(1, "w1").join(side(2, "w2"), "pair_id")
    return out.select("*", *[(F.col(f"w2_{c}") - F.col(f"w1_{c}")).alias(f"delta_{c}") for c in columns])


#: Parameters that each kind of window needs, with their least values.
REQUIRED = {
    "change_point_windows": {},
    "fixed_size_windows": {"window_size": 1, "offset": 1},
    "window_comparison": {"window_1_size": 1, "window_2_size": 1, "offset": 0, "step": 1},
}


@dataclass(frozen=True)
class Approach:
    """One way of windowing a log, checked when it is made."""

    name: str
    type: str
    params: dict

    def __post_init__(self):
        if self.type not in REQUIRED:
            raise ValueError(f"{self.name}: unknown type {self.type!r}")
        for key, least in REQUIRED[self.type].items():
            value = self.params.get(key)
            if not isinstance(value, int) or isinstance(value, bool) or value < least:
                raise ValueError(f"{self.name}: {key} must be a whole number of at least {least}")


def approaches(specs: Sequence[dict]) -> list[Approach]:
    """Checked approaches; names are unique."""
    out = [Approach(s["name"], s["type"], dict(s.get("params") or {})) for s in specs]
    if len({a.name for a in out}) != len(out):
        raise ValueError("names of approaches must be unique")
    return out
