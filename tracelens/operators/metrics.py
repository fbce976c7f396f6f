"""What is fixed about the measures: names, columns, short names, basis, dimension."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Name, short name, basis, dimension, in the order of result tables.
METRICS = [
    ("Number of Events", "events", "OC", "Length"),
    ("Number of Traces", "traces", "OC", "Length"),
    ("Number of Distinct Activities", "distinct_activities", "PC", "Size"),
    ("Number of Distinct Traces", "distinct_traces", "PC", "Size"),
    ("Number of Distinct Directly-Follows Relations", "transitions", "PC", "Size"),
    ("Min. Trace Length", "min_length", "PD", "Size"),
    ("Avg. Trace Length", "avg_length", "PD", "Size"),
    ("Max. Trace Length", "max_length", "PD", "Size"),
    ("Percentage of Distinct Traces", "pct_distinct", "PC", "Variation"),
    ("Average Distinct Activities per Trace", "avg_activities", "PD", "Variation"),
    ("Structure", "structure", "PC", "Variation"),
    ("Estimated Number of Acyclic Paths", "acyclic_paths", "PC", "Variation"),
    ("Number of Ties in Paths to Goal", "ties", "CT", "Variation"),
    ("Lempel-Ziv Complexity", "lz", "CT", "Variation"),
    ("Average Affinity", "affinity", "CT", "Distance"),
    ("Deviation from Random", "deviation", "CT", "Distance"),
    ("Average Edit Distance", "edit_distance", "CT", "Distance"),
    ("Sequence Entropy", "seq_entropy", "CT", "Graph Entropy"),
    ("Normalized Sequence Entropy", "norm_seq_entropy", "CT", "Graph Entropy"),
    ("Variant Entropy", "var_entropy", "CT", "Graph Entropy"),
    ("Normalized Variant Entropy", "norm_var_entropy", "CT", "Graph Entropy"),
]
NAMES = [m[0] for m in METRICS]
BASIS_ORDER = ["OC", "PC", "PD", "CT"]
DIMENSION_ORDER = ["Length", "Size", "Variation", "Distance", "Graph Entropy"]


def column_of(name: str) -> str:
    """The column of a measure: its name in lower case with underscores."""
    return "".join(c if c.isalnum() else " " for c in name.lower()).replace("  ", " ").strip().replace(" ", "_")


COLUMNS = [column_of(n) for n in NAMES]


def metric_table(spark: SparkSession) -> DataFrame:
    """metric, column, basis, dimension, rank: one small row for each measure."""
    return spark.createDataFrame([(n, column_of(n), b, d, i) for i, (n, _, b, d) in enumerate(METRICS)], "metric string, column string, basis string, dimension string, rank int")


def select_metrics(wanted: Iterable[str] | None) -> list[str]:
    """Names for names or short names, in the order asked for, each once; all for none."""
    if wanted is None:
        return list(NAMES)
    short = {s: n for n, s, *_ in METRICS}
    out: list[str] = []
    for w in wanted:
        name = w if w in NAMES else short.get(w)
        if name is None:
            raise ValueError(f"unknown measure {w!r}")
        if name not in out:
            out.append(name)
    return out
