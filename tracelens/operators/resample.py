"""Bootstrap replicates of windows and confidence intervals over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from .draws import multinomial
from .richness import KIND, bootstrap_community, chao1
from .sampling import draw


#: Traces of a window that one row holds, and slots that one row makes.
HELD = 4096


def trace_bootstrap(members: DataFrame, replicates: int, keys: Sequence[str] = ("window_id",), seed: int = 7) -> DataFrame:
    """Each window resampled with replacement: one more key, ``replicate``.

    A replicate is just another window, so it is counted at once by the same operators.  A window of up to
    ``HELD`` traces becomes one row, from which its replicates are drawn without a shuffle; slots of larger
    ones are made in rows of ``HELD``, dealt out, and meet the traces by window and place.
    """
    keys = list(keys)
    rest = [c for c in members.columns if c not in (*keys, "pos")]
    sizes = materialize(members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    least, most = sizes.agg(F.min("_n"), F.max("_n")).first()
    each = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    drawn = (draw(seed, *[F.col(k) for k in keys], F.col("replicate"), F.col("slot")) % F.col("_n")).alias("_at")
    parts = []
    if least is None or least <= HELD:
        own = members.join(sizes.where(F.col("_n") <= HELD), keys)
        # A list for each column, so that those that nobody reads are left out.
        lists = [F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("v")))).alias(f"_m{i}") for i, c in enumerate(rest)]
        made = [f"_m{i}" for i in range(len(rest))]
        slots = own.groupBy(*keys, "_n").agg(*lists).select(*keys, "_n", *made, each).select(*keys, "_n", *made, "replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("slot"))
        slots = slots.select(*keys, "replicate", F.col("slot").alias("pos"), *made, drawn.cast("int"))
        parts.append(slots.select(*keys, "replicate", "pos", *[F.get(m, F.col("_at"))["v"].alias(c) for m, c in zip(made, rest)]))
    if most is not None and most > HELD:
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {HELD}"))).alias("_block")
        # A fixed number of parts: these few rows, each of which makes HELD, would be put together again.
        tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        runs = sizes.where(F.col("_n") > HELD).select(*keys, "_n", each).select(*keys, "_n", "replicate", block).repartition(tasks, *keys, "replicate", "_block")
        slots = runs.select(*keys, "_n", "replicate", F.explode(F.sequence(F.col("_block") * HELD, F.least("_n", (F.col("_block") + 1) * HELD) - 1)).alias("slot"))
        slots = slots.select(*keys, "replicate", "slot", drawn)
        # Spark takes slots for as small as the sizes they come from: without the hint it would broadcast them.
        own = members.withColumnRenamed("pos", "_at").hint("shuffle_hash")
        parts.append(slots.join(own, [*keys, "_at"]).select(*keys, "replicate", F.col("slot").alias("pos"), *rest))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def species_bootstrap(counts: DataFrame, replicates: int, keys: Sequence[str], seed: int = 11) -> DataFrame:
    """Multinomial draws from each group's estimated community; unseen species are ``unseen:k``."""
    keys = list(keys)
    counts = materialize(counts)  # read several times below
    seen = bootstrap_community(counts, keys)
    groups = materialize(seen.groupBy(*keys).agg(F.max("p0").alias("p0"), F.max("unseen_count").cast("long").alias("_k"), F.max("total").alias("n")))
    hidden = groups.where("_k > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_k")))
    hidden = hidden.select(*keys, F.concat(F.lit("unseen:"), F.col("_i").cast("string")).alias("species"), (F.col("p0") / F.col("_k")).alias("w"))
    whole = seen.select(*keys, "species", F.col("p").alias("w")).unionByName(hidden)
    return multinomial(whole, groups.select(*keys, "n"), replicates, keys, seed)


def replicate_fits(members: DataFrame, replicates: int, keys: Sequence[str] = ("window_id",), seed: int = 11) -> DataFrame:
    """Activities, pairs and variants drawn from each window's estimated community, then fitted again."""
    from .eventlog import species

    keys = list(keys)
    again = species_bootstrap(species(members, keys), replicates, [*keys, KIND], seed)
    return chao1(again, [*keys, KIND, "replicate"])


def replicate_traces(members: DataFrame, replicates: int, keys: Sequence[str] = ("window_id",), seed: int = 11) -> DataFrame:
    """The traces of the same replicates, drawn again with replacement."""
    return trace_bootstrap(members, replicates, keys, seed)


def inext_replicates(members: DataFrame, replicates: int, keys: Sequence[str] = ("window_id",), seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Replicates of windows with both of their sides, under the same keys and ``replicate``.

    First the refitted populations, second the traces.  So ``all_measures(traces, keys, population=fits)``
    measures a replicate as it does a window.
    """
    return replicate_fits(members, replicates, keys, seed), replicate_traces(members, replicates, keys, seed)


def interval(values: DataFrame, keys: Sequence[str], method: str = "normal", level: float = 0.95) -> DataFrame:
    """Mean, sample deviation and bounds over replicates; null and infinite values are skipped.

    normal: mean plus or minus 1.96 standard errors; percentile: linear quantiles.
    """
    v = F.when(F.abs("value") < float("inf"), F.col("value"))
    side = (1 - level) / 2
    out = values.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.percentile(v, F.lit(side)).alias("p_low"), F.percentile(v, F.lit(1 - side)).alias("p_high"))
    se = F.coalesce("std", F.lit(0.0)) / F.sqrt("n")
    if method == "normal":
        low, high = F.col("mean") - 1.96 * se, F.col("mean") + 1.96 * se
    elif method == "percentile":
        low, high = F.col("p_low"), F.col("p_high")
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.select(*keys, "n", "mean", "std", low.alias("ci_low"), high.alias("ci_high"))


def sample_interval(raw: DataFrame, keys: Sequence[str] = ("metric", "sample_size"), level: float = 0.95) -> DataFrame:
    """Quantile interval across samples and its width relative to the mean; 95 and 0.95 are the same level."""
    level = level / 100 if level > 1 else level
    low, high = F.percentile("value", F.lit((1 - level) / 2)), F.percentile("value", F.lit(1 - (1 - level) / 2))
    out = raw.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.avg("value").alias("mean_value"), low.alias("ci_low"), high.alias("ci_high"))
    return out.withColumn("ci_rel_width", (F.col("ci_high") - F.col("ci_low")) / F.nullif(F.col("mean_value"), F.lit(0.0)))
