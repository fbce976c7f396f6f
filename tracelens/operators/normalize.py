"""Normalized values beside raw ones: functions from a row's measures to a value.

The raw value never changes.  A missing measure leaves its normalizer without effect.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import COLUMNS

#: From a column lookup to the normalized value.
Normalizer = Callable[[Callable[[str], Column]], Column]


def _events(c):
    return c("number_of_events") / c("number_of_traces")


def _traces(c):
    return F.when(c("number_of_traces").isNotNull(), F.lit(1.0))


def _distinct_traces(c):
    share, n = c("percentage_of_distinct_traces"), c("number_of_traces")
    share = F.when(share > 1, share / 100).otherwise(share)
    return F.greatest(F.lit(0.0), F.least(n.cast("double"), share * n))


def _deviation(c):
    v, d = c("number_of_distinct_activities"), c("deviation_from_random")
    return F.when(v > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (1 - d) / F.sqrt(1 - 1 / (v * v)))))


def _lempel_ziv(c):
    n, v = c("number_of_events"), c("number_of_distinct_activities")
    return F.when((n > 1) & (v > 1), c("lempel_ziv_complexity") / (n / (F.ln(n) / F.ln(v))))


def _entropy(value: str, size: str) -> Normalizer:
    def f(c):
        k, n = c("number_of_partitions"), c(size)
        return F.when((k <= 1) | (n <= 1), F.lit(0.0)).otherwise(F.least(c(value) + (k - 1) / 2, n * F.ln(k)))

    return f


#: In the order in which they apply; each reads raw values only.
NORMALIZERS: dict[str, Normalizer] = {
    "number_of_events": _events,
    "number_of_traces": _traces,
    "percentage_of_distinct_traces": _distinct_traces,
    "deviation_from_random": _deviation,
    "lempel_ziv_complexity": _lempel_ziv,
    "variant_entropy": _entropy("variant_entropy", "number_of_states"),
    "sequence_entropy": _entropy("sequence_entropy", "number_of_events"),
}


def normalize(measures: DataFrame, keys: Sequence[str], normalizers: dict[str, Normalizer] | None = None, hide: Sequence[str] = (), to_none: Sequence[str] = ()) -> DataFrame:
    """Long rows: keys, metric, value, value_normalized, has_normalized, hidden.

    ``hide``: not shown at all.  ``to_none``: shown, but as null.
    """
    normalizers = NORMALIZERS if normalizers is None else normalizers
    names = [c for c in measures.columns if c not in keys]
    lookup = lambda n: F.col(n) if n in names else F.lit(None).cast("double")
    rows = []
    for c in names:
        done = normalizers[c](lookup).cast("double") if c in normalizers else F.lit(None).cast("double")
        none = c in hide or c in to_none
        rows.append(F.struct(
            F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), (F.lit(None).cast("double") if none else done).alias("value_normalized"),
            (F.lit(True) if c in to_none else F.lit(False) if c in hide else done.isNotNull()).alias("has_normalized"), F.lit(c in hide or c not in COLUMNS).alias("hidden"),
        ))
    return measures.select(*keys, F.explode(F.array(*rows)).alias("m")).select(*keys, "m.*")


def visible(rows: DataFrame) -> DataFrame:
    """What is shown: no hidden rows, the normalized value where there is one."""
    shown = F.when(F.col("has_normalized"), F.col("value_normalized")).otherwise(F.col("value"))
    return rows.where(~F.col("hidden")).select(*[c for c in rows.columns if c not in ("value", "value_normalized", "has_normalized", "hidden")], shown.alias("value"))
