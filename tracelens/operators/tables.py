"""Result tables: analysis, master, comparison of two masters, drift deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import BASIS_ORDER, DIMENSION_ORDER, metric_table
from .resample import sample_interval
from .stats import fisher_z, normal_two_sided, plateau, size_correlations

#: Difference of Pearson and Spearman up to which a dependence counts as linear.
LINEAR = 0.15


def analysis(raw: DataFrame, level: float = 0.95) -> DataFrame:
    """Means and intervals by (log, metric, sample size), with the metric's correlations and plateau."""
    keys = ["log", "metric"]
    base = sample_interval(raw, [*keys, "sample_size"], level)
    return base.join(size_correlations(raw, keys).drop("n"), keys, "left").join(plateau(raw, keys), keys, "left")


def master(rows: DataFrame, sizes: Sequence[int] = (50, 250, 500)) -> DataFrame:
    """One row for each (metric, log): correlations, their shape, relative widths at reference sizes, plateau."""
    widths = [F.max(F.when(F.col("sample_size") == s, F.col("ci_rel_width"))).alias(f"rel_ci_{s}") for s in sizes]
    one = [F.max(c).alias(c) for c in ("pearson_rho", "spearman_rho", "plateau_n")]
    out = rows.groupBy("metric", "log").agg(*one, *widths).join(F.broadcast(metric_table(rows.sparkSession).drop("metric").withColumnRenamed("column", "metric")), "metric")
    delta = F.abs(F.col("pearson_rho") - F.col("spearman_rho"))
    out = out.withColumn("delta_ps", delta).withColumn("shape", F.when(delta <= LINEAR, "Linear").otherwise("Asymptotic"))
    out = out.withColumn("preferred", F.when(F.col("shape") == "Linear", "Pearson").otherwise("Spearman"))
    return out.withColumn("plateau_text", F.when(F.col("plateau_n").isNotNull(), F.concat(F.lit("Y ("), F.col("plateau_n").cast("string"), F.lit(")"))).otherwise("N"))


def with_means(rows: DataFrame) -> DataFrame:
    """The master's rows and a MEAN row after each (metric, basis, dimension); ``position`` orders them."""
    keys = ["metric", "basis", "dimension", "rank"]
    numbers = [c for c, t in rows.dtypes if t == "double"]
    found, total = F.count("plateau_n"), F.count(F.lit(1))
    mean = rows.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in numbers], F.when(found == total, F.avg("plateau_n")).alias("plateau_mean"),
        F.when(found == total, F.concat(found.cast("string"), F.lit(" / "), total.cast("string"), F.lit(" (avg. "), F.avg("plateau_n").cast("string"), F.lit(")"))).otherwise(F.concat(found.cast("string"), F.lit(" / "), total.cast("string"))).alias("plateau_text"),
    ).withColumn("log", F.lit("MEAN")).withColumn("position", F.lit(1))
    return rows.withColumn("position", F.lit(0)).unionByName(mean, allowMissingColumns=True)


def comparison(before: DataFrame, after: DataFrame, n: int = 2_000, population: int = 10_000) -> DataFrame:
    """Masters side by side: status, the correlation that ``after`` prefers, its change and significance."""
    keys = ["metric", "basis", "log"]
    take = ["pearson_rho", "spearman_rho", "preferred", "plateau_n", *[c for c in before.columns if c.startswith("rel_ci_")]]
    side = lambda df, tag: df.select(*keys, F.lit(True).alias(f"in_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in take])
    out = side(before, "before").join(side(after, "after"), keys, "full")
    b, a = F.col("in_before").isNotNull(), F.col("in_after").isNotNull()
    out = out.withColumn("status", F.when(b & a, "OK").when(b, "Missing_in_after").when(a, "Missing_in_before").otherwise("Missing_in_both"))
    chosen = F.coalesce("preferred_after", "preferred_before")
    pick = lambda tag: F.when(chosen == "Pearson", F.col(f"pearson_rho_{tag}")).otherwise(F.col(f"spearman_rho_{tag}"))
    out = out.withColumn("chosen", chosen).withColumn("rho_before", pick("before")).withColumn("rho_after", pick("after"))
    out = out.withColumn("abs_delta", F.abs("rho_after") - F.abs("rho_before")).withColumn("pearson_delta", F.col("pearson_rho_after") - F.col("pearson_rho_before")).withColumn("spearman_delta", F.col("spearman_rho_after") - F.col("spearman_rho_before"))
    out = out.withColumn("plateau_delta", F.col("plateau_n_after") - F.col("plateau_n_before"))
    for c in take:
        if c.startswith("rel_ci_"):
            out = out.withColumn(f"{c}_delta", F.col(f"{c}_after") - F.col(f"{c}_before"))
    size, pop = F.lit(n), F.lit(population)
    out = out.withColumn("z", fisher_z(F.col("rho_before"), size, F.col("rho_after"), size, pop, pop)).withColumn("p", normal_two_sided("z"))
    return out.withColumn("fpc_used", F.lit(population > n)).withColumn("significant_improvement", F.when(F.col("z").isNotNull(), (F.col("p") < 0.05) & (F.col("abs_delta") < 0))).drop("in_before", "in_after")


def comparison_means(rows: DataFrame) -> DataFrame:
    """MEAN rows of a comparison: means, the share of significant improvements, the usual FPC use."""
    numbers = [c for c, t in rows.dtypes if t == "double"]
    share = F.avg(F.col("significant_improvement").cast("double")).alias("share_improved")
    return rows.where("status = 'OK'").groupBy("metric", "basis").agg(*[F.avg(c).alias(c) for c in numbers], share, F.mode("fpc_used").alias("fpc_used"), F.count(F.lit(1)).alias("n_logs"))


def rounded(df: DataFrame, digits: int = 10) -> DataFrame:
    """All doubles to ``digits`` places; infinite values become null."""
    return df.select(*[F.when(F.abs(c) < float("inf"), F.round(c, digits)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def ordered(df: DataFrame) -> DataFrame:
    """By basis, dimension and metric in their fixed order, MEAN rows last, then log."""
    place = lambda c, order: F.array_position(F.array(*[F.lit(x) for x in order]), F.col(c))
    return df.orderBy(place("basis", BASIS_ORDER), place("dimension", DIMENSION_ORDER), "rank", (F.col("log") == "MEAN").cast("int"), "log")


# ---------------------------------------------------------------- drift

def drift_summary(drift: DataFrame) -> DataFrame:
    """Sudden and gradual drifts of each dataset and a Total row: counts, and points in order."""
    from pyspark.sql.window import Window

    nxt = F.lead("change_index").over(Window.partitionBy("dataset").orderBy("change_id"))
    rows = drift.withColumn("to_index", nxt)
    sudden, gradual = F.col("change_type") == "sudden", F.col("change_type") == "gradual_start"
    text = lambda cond, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("change_id", value.alias("v"))))), lambda x: x["v"]), ", ")
    span = F.concat(F.lit("("), F.col("change_index").cast("string"), F.lit(", "), F.col("to_index").cast("string"), F.lit(")"))
    one = rows.groupBy("dataset").agg(F.count_if(sudden).alias("n_sudden"), text(sudden, F.col("change_index").cast("string")).alias("sudden_points"), F.count_if(gradual).alias("n_gradual"), text(gradual, span).alias("gradual_points"))
    total = one.agg(F.lit("Total").alias("dataset"), F.sum("n_sudden").alias("n_sudden"), F.lit("").alias("sudden_points"), F.sum("n_gradual").alias("n_gradual"), F.lit("").alias("gradual_points"))
    return one.unionByName(total)


def drift_deltas(windows: DataFrame, drift: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Measure changes at drifts, long: dataset, change_id, change_type, measure, delta.

    sudden: the window that starts at the drift less the one that ends there.  gradual: before
    to during, during to after and before to after, with the gradual end as the next change.
    A drift without its windows is an error.
    """
    ends = windows.select("dataset", F.col("end_cp").alias("e"), F.struct(*columns).alias("before"))
    starts = windows.select("dataset", F.col("start_cp").alias("s"), F.struct(*columns).alias("after"))

    def step(kind: str, label: str, end_shift: int, start_shift: int) -> DataFrame:
        d = drift.where(F.col("change_type") == kind).select("dataset", "change_id", F.lit(label).alias("change"), (F.col("change_id") + end_shift).alias("e"), (F.col("change_id") + start_shift).alias("s"))
        both = d.join(ends, ["dataset", "e"], "left").join(starts, ["dataset", "s"], "left")
        lost = F.concat(F.lit("no window beside change "), F.col("change_id").cast("string"), F.lit(" of "), F.col("dataset"))
        found = lambda c: F.when(F.col(c).isNull(), F.raise_error(lost)).otherwise(F.col(c)).alias(c)
        return both.select("dataset", "change_id", "change", found("before"), found("after"))

    parts = [step("sudden", "sudden", 0, 0), step("gradual_start", "gradual_before_during", 0, 0), step("gradual_start", "gradual_during_after", 1, 1), step("gradual_start", "gradual_before_after", 0, 1)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    delta = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), (F.col(f"after.{c}") - F.col(f"before.{c}")).cast("double").alias("delta")) for c in columns])).alias("m")
    return rows.select("dataset", "change_id", "change", delta).select("dataset", "change_id", "change", "m.measure", "m.delta")


def delta_aggregates(deltas: DataFrame) -> DataFrame:
    """Mean, least, largest, sample deviation and number of each (change, measure); drifts with a null delta are left out."""
    whole = deltas.groupBy("dataset", "change_id", "change").agg(F.count_if(F.col("delta").isNull()).alias("gaps")).where("gaps = 0").drop("gaps")
    rows = deltas.join(whole, ["dataset", "change_id", "change"])
    return rows.groupBy("change", "measure").agg(F.avg("delta").alias("mean"), F.min("delta").alias("min"), F.max("delta").alias("max"), F.stddev_samp("delta").alias("std"), F.count(F.lit(1)).alias("n"))


def number_text(c: Column) -> Column:
    """Two decimals, or scientific notation from a thousand on; null for null."""
    return F.when(F.abs(c) >= 1000, F.format_string("%.2e", c)).when(c.isNotNull(), F.format_string("%.2f", c))


CHANGE_ORDER = ["sudden", "gradual_before_during", "gradual_during_after", "gradual_before_after"]


def simple_table(aggregates: DataFrame) -> DataFrame:
    """Measures down, kinds of change across in a fixed order, "mean (std)" in the cells, and instances."""
    cell = F.concat(number_text(F.col("mean")), F.lit(" ("), F.coalesce(number_text(F.col("std")), F.lit("-")), F.lit(")"))
    wide = aggregates.withColumn("cell", cell).groupBy("measure").pivot("change", CHANGE_ORDER).agg(F.first("cell"))
    return wide.join(aggregates.groupBy("measure").agg(F.sum("n").alias("instances")), "measure")
