"""Statistics over measured samples: correlations, plateaus, tests and corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scratch import materialize
from ..functions.special import correlation_pvalue, normal_two_sided, t_pvalue


def _finite(c: Column) -> Column:
    return F.when((F.abs(c) < float("inf")) & ~F.isnan(c), c)


def average_ranks(rows: DataFrame, value: str, keys: Sequence[str], out: str) -> DataFrame:
    """``rows`` with the average rank of ``value`` in its group, as ``out``.

    Values are counted first.  Different ones are sorted by group and value into ranges, written
    once; a value's rank is its place in its range and what the group has in ranges before, which is
    a table of a row for each group and range.  So no task sorts or holds a whole group.
    """
    keys = list(keys)
    # Ranks meet rows by value: sums of doubles worked out twice may differ in the last bit, so they are written once.
    rows = materialize(rows)
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t"))
    ordered = materialize(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy(*keys, "_part").agg(F.sum("_t").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranks = ordered.withColumn("_in", F.coalesce(F.sum("_t").over(inside), F.lit(0))).join(parts.select(*keys, "_part", "_before"), [*keys, "_part"])
    ranks = ranks.select(*keys, value, (F.col("_before") + F.col("_in") + (F.col("_t") + 1) / 2).alias(out))
    return rows.join(ranks, [*keys, value])


def _corr(x: str, y: str) -> Column:
    """Pearson's r; null for fewer than two rows or no variance."""
    flat = (F.count(F.lit(1)) < 2) | (F.max(x) == F.min(x)) | (F.max(y) == F.min(y))
    return F.when(~flat, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def size_correlations(raw: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Pearson and Spearman correlation of sample size and value, with p-values."""
    rows = raw.select(*keys, F.col("sample_size").cast("double").alias("x"), _finite(F.col("value").cast("double")).alias("y")).where("y is not null")
    ranked = average_ranks(average_ranks(rows, "x", keys, "rx"), "y", keys, "ry")
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _corr("x", "y").alias("pearson_rho"), _corr("rx", "ry").alias("spearman_rho"))
    return out.withColumn("pearson_p", correlation_pvalue(F.col("pearson_rho"), F.col("n").cast("double"))).withColumn("spearman_p", correlation_pvalue(F.col("spearman_rho"), F.col("n").cast("double")))


def mean_over_logs(correlations: DataFrame, metric: str = "metric") -> DataFrame:
    """Means of rho and p over logs, without nulls."""
    return correlations.groupBy(metric).agg(*[F.avg(c).alias(c) for c in ("pearson_rho", "pearson_p", "spearman_rho", "spearman_p")])


def plateau(raw: DataFrame, keys: Sequence[str] = ("metric",), tolerance: float = 0.025, center: str = "mean") -> DataFrame:
    """First sample size, not the last, from which no later center differs by more than ``tolerance``."""
    middle = F.avg("value") if center == "mean" else F.percentile("value", F.lit(0.5))
    sizes = raw.groupBy(*keys, "sample_size").agg(middle.alias("v"))
    later = Window.partitionBy(*keys).orderBy("sample_size").rowsBetween(1, Window.unboundedFollowing)
    v = _finite(F.col("v"))
    # All later centers lie within the band if the least and the largest do.
    sizes = sizes.withColumn("v", v).withColumn("low", F.min("v").over(later)).withColumn("high", F.max("v").over(later))
    spread = F.greatest(F.abs(F.col("low") - F.col("v")), F.abs(F.col("high") - F.col("v"))) / F.abs(F.nullif(F.col("v"), F.lit(0.0)))
    out = sizes.groupBy(*keys).agg(F.min(F.when(spread <= tolerance, F.col("sample_size"))).alias("plateau_n"))
    return out.withColumn("plateau_found", F.col("plateau_n").isNotNull())


def fisher_z(r1: Column, n1: Column, r2: Column, n2: Column, pop1: Column, pop2: Column) -> Column:
    """z of two independent correlations with finite-population correction; null below 4 rows or at |r| = 1."""
    def fpc2(n: Column, pop: Column) -> Column:
        return F.when((pop > n) & (pop > 1), (pop - n) / (pop - 1)).otherwise(F.lit(1.0))

    usable = (n1 >= 4) & (n2 >= 4) & (F.abs(r1) < 1 - 1e-12) & (F.abs(r2) < 1 - 1e-12)
    se = F.sqrt(fpc2(n1, pop1) / F.nullif(n1 - 3, F.lit(0)) + fpc2(n2, pop2) / F.nullif(n2 - 3, F.lit(0)))
    return F.when(usable, (F.atanh(r1) - F.atanh(r2)) / se)


def improvement(before: DataFrame, after: DataFrame, population: int = 10_000, default_n: int = 2_000) -> DataFrame:
    """Do correlations of (metric, log) shrink?  Rounded rho, z, p and whether it is significant."""
    cols = ("rho", "n")
    b = before.select("metric", "log", *[F.col(c).alias(f"{c}_before") for c in cols])
    a = after.select("metric", "log", *[F.col(c).alias(f"{c}_after") for c in cols])
    rows = b.join(a, ["metric", "log"])
    r1, r2 = F.round("rho_before", 4), F.round("rho_after", 4)
    n1, n2, pop = F.coalesce("n_before", F.lit(default_n)), F.coalesce("n_after", F.lit(default_n)), F.lit(population)
    rows = rows.withColumn("z", fisher_z(r1, n1, r2, n2, pop, pop)).withColumn("abs_delta", F.abs(r2) - F.abs(r1))
    rows = rows.withColumn("p", normal_two_sided("z"))
    return rows.withColumn("improved", (F.col("p") < 0.05) & (F.col("abs_delta") < 0))


def improvement_share(rows: DataFrame) -> DataFrame:
    return rows.groupBy("metric").agg(F.avg(F.col("improved").cast("double")).alias("share_improved"), F.count(F.lit(1)).alias("n_logs"))


def williams(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("log", "metric")) -> DataFrame:
    """Williams' t of corr(size, before) against corr(size, after) over the same samples."""
    keys = list(keys)
    join = [*keys, "sample_size", "sample_id"]
    both = before.select(*join, F.col("value").alias("y1")).join(after.select(*join, F.col("value").alias("y2")), join).where("y1 is not null and y2 is not null").withColumn("x", F.col("sample_size").cast("double"))
    out = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _corr("x", "y1").alias("r_a"), _corr("x", "y2").alias("r_b"), _corr("y1", "y2").alias("r_ab"))
    a, b, ab, n = F.col("r_a"), F.col("r_b"), F.col("r_ab"), F.col("n")
    det = F.greatest(F.lit(0.0), 1 - a * a - b * b - ab * ab + 2 * a * b * ab)
    den = F.sqrt(2 * (n - 1) / F.nullif(n - 3, F.lit(0)) * det + F.pow(a + b, F.lit(2)) / 4 * F.pow(1 - ab, F.lit(3)))
    out = out.withColumn("t", F.when(n >= 4, (a - b) * F.sqrt((n - 1) * (1 + ab)) / F.nullif(den, F.lit(0.0)))).withColumn("df", n - 3)
    out = out.withColumn("p", t_pvalue(F.col("t"), F.col("df").cast("double"))).withColumn("delta_r", b - a)
    return out.withColumn("improved", F.abs("r_b") < F.abs("r_a")).withColumn("direction", F.when(F.col("delta_r") > 0, "up").when(F.col("delta_r") < 0, "down").otherwise("same"))


def benjamini_hochberg(rows: DataFrame, p: str = "p", keys: Sequence[str] = (), out: str = "p_adjusted") -> DataFrame:
    """Adjusted p-values; the number of tests is that of all rows, with and without a p-value.

    A few hundred tests: one ordered window over them.
    """
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rank = F.row_number().over(own.orderBy(F.col(p).asc_nulls_last()))
    scaled = rows.withColumn("_rank", rank).withColumn("_scaled", F.col(p) * F.count(F.lit(1)).over(own) / F.col("_rank"))
    least = F.min("_scaled").over(own.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing))
    return scaled.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("_rank", "_scaled")


def wilcoxon_greater(rows: DataFrame, keys: Sequence[str], delta: str = "delta_r") -> DataFrame:
    """One-sided signed-rank test that ``delta`` is positive: rank sums in Spark, the normal tail in a UDF on the result."""
    d = rows.where((F.col(delta) != 0) & F.col(delta).isNotNull()).select(*keys, F.col(delta).alias("d"), F.abs(delta).alias("a"))
    d = materialize(d)
    ranked = average_ranks(d, "a", keys, "r")
    ties = d.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("t")).groupBy(*keys).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    w = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(F.lit(0.0))).alias("w_plus"), F.count(F.lit(1)).alias("m")).join(ties, list(keys))
    m = F.col("m")
    z = (F.col("w_plus") - m * (m + 1) / 4) / F.sqrt(F.nullif(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48, F.lit(0.0)))
    w = w.withColumn("z", z).withColumn("two", normal_two_sided("z"))
    return w.select(*keys, "w_plus", "m", "z", F.when(F.col("z") > 0, F.col("two") / 2).otherwise(1 - F.col("two") / 2).alias("p"))


def measure_summary(tests: DataFrame) -> DataFrame:
    """Per measure: mean and median delta, how often r grew, Wilcoxon p and its correction."""
    base = tests.groupBy("metric").agg(F.avg("delta_r").alias("mean_delta"), F.percentile("delta_r", F.lit(0.5)).alias("median_delta"), F.count_if(F.col("r_b") > F.col("r_a")).alias("n_grown"), F.count(F.lit(1)).alias("n"))
    return benjamini_hochberg(base.join(wilcoxon_greater(tests, ["metric"]), "metric", "left"))


def trace_count_correlation(windows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One Pearson correlation per measure with n_traces over all datasets, with p-values and flags."""
    long = windows.select("dataset", F.col("n_traces").cast("double").alias("x"), F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("y")) for c in columns])).alias("m")).select("dataset", "x", "m.*")
    rows = long.where(_finite(F.col("y")).isNotNull())
    out = rows.groupBy("measure").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("dataset").alias("n_datasets"), _corr("x", "y").alias("r"))
    out = out.withColumn("p", correlation_pvalue(F.col("r"), F.col("n_rows").cast("double")))
    for level, name in ((0.10, "p10"), (0.05, "p05"), (0.01, "p01"), (0.001, "p001")):
        out = out.withColumn(f"sig_{name}", F.coalesce(F.col("p") < level, F.lit(False)))
    return out.withColumn("direction", F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("none")).withColumn("stars", stars(F.col("p")))


def stars(p: Column) -> Column:
    """Significance marks of a p-value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
