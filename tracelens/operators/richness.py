"""Species richness: how many activities, pairs and variants a population has beyond a sample.

``counts``: keys, species_kind, species, n.  All estimators are aggregates and column
expressions over (window, kind), so all windows of all logs are one job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scratch import materialize
from ..functions.special import log_gamma

KIND = "species_kind"


def frequencies(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, f1, f2 (species seen once, twice), observed species."""
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("f1"), F.count_if(F.col("n") == 2).alias("f2"), F.count(F.lit(1)).alias("observed_count"))


def unseen(n: Column, f1: Column, f2: Column) -> Column:
    """Chao1's number of unseen species."""
    part = (n - 1) / n
    return F.when(f1 == 0, F.lit(0.0)).when(f2 > 0, part * f1 * f1 / F.nullif(2 * f2, F.lit(0))).otherwise(part * f1 * (f1 - 1) / 2)


def coverage_factor(n: Column, f1: Column, f0: Column) -> Column:
    """The factor A of coverage: 1 without singletons, 0 without unseen species."""
    return F.when(f1 == 0, F.lit(1.0)).when(f0 <= 0, F.lit(0.0)).otherwise(n * f0 / (n * f0 + f1))


def chao1(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chao1 fit of each group; a group without species isn't a row."""
    f = frequencies(counts, keys)
    f = f.withColumn("f0_hat", unseen(F.col("n"), F.col("f1"), F.col("f2"))).withColumn("a_factor", coverage_factor(F.col("n"), F.col("f1"), F.col("f0_hat")))
    f = f.withColumn("unseen_count", F.ceil("f0_hat")).withColumn("population_count", F.col("observed_count") + F.col("unseen_count"))
    return f.withColumn("s_asymptotic", F.col("observed_count") + F.col("f0_hat")).withColumn("p0", F.col("f1") / F.col("n") * F.col("a_factor")).withColumn("coverage", 1 - F.col("p0"))


def naive(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The population is the sample: nothing unseen."""
    f = frequencies(counts, keys)
    return f.select(*keys, "n", "observed_count", F.col("observed_count").alias("population_count"), F.lit(0).cast("long").alias("unseen_count"), F.lit(0.0).alias("p0"), F.lit(1.0).alias("coverage"))


def bootstrap_community(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probability of each seen species in the estimated community, and p0, the unseen ones' share."""
    fit = chao1(counts, keys).select(*keys, F.col("n").alias("total"), "p0", "unseen_count")
    rows = counts.join(fit, list(keys)).withColumn("r", F.col("n") / F.col("total")).withColumn("miss", F.pow(1 - F.col("r"), F.col("total")))
    weight = rows.groupBy(*keys).agg((F.max("p0") / F.nullif(F.sum(F.col("r") * F.col("miss")), F.lit(0.0))).alias("w"))
    return rows.join(weight, list(keys)).select(*keys, "species", "n", "total", "p0", "unseen_count", (F.col("r") * (1 - F.coalesce("w", F.lit(0.0)) * F.col("miss"))).alias("p"))


def largest_remainder(weights: DataFrame, keys: Sequence[str], total: Column, weight: str = "w") -> DataFrame:
    """Whole numbers in proportion to ``weight`` that sum to ``total`` in each group: largest fractions first, ties by species."""
    own = Window.partitionBy(*keys)
    share = F.col(weight) / F.sum(weight).over(own) * total
    out = weights.withColumn("_share", share).withColumn("_floor", F.floor(F.round("_share", 9)))
    left = total - F.sum("_floor").over(own)
    rank = F.row_number().over(own.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), "species"))
    return out.withColumn("abundance", (F.col("_floor") + (rank <= left).cast("int")).cast("long")).drop("_share", "_floor")


def sizes(counts: DataFrame, keys: Sequence[str], trials: DataFrame | None = None) -> DataFrame:
    """What curves need of each group: t units, u incidences, species seen once and twice, seen at all and unseen (q0), and the factor ``a`` by which the unseen share shrinks.

    ``counts``: keys, n.  With ``trials`` (keys, t) the counts are incidences, else abundances, whose units are individuals.
    """
    f = counts.groupBy(*keys).agg(F.sum("n").alias("u"), F.count_if(F.col("n") == 1).cast("double").alias("q1"), F.count_if(F.col("n") == 2).alias("q2"), F.count(F.lit(1)).alias("observed_count"))
    f = f.join(trials.select(*keys, "t"), list(keys)) if trials is not None else f.withColumn("t", F.col("u"))
    t, q1, q2 = F.col("t"), F.col("q1"), F.col("q2")
    return f.withColumn("q0", unseen(t, q1, q2)).withColumn("a", F.coalesce((t - 1) * q1 / F.nullif((t - 1) * q1 + 2 * q2, F.lit(0.0)), F.lit(1.0)))


def _repeats(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many species have each count, so that a point of a curve meets distinct counts and not species."""
    return counts.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("_k"))


def _below(kinds: DataFrame, f: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected species ``s`` and coverage ``c`` of m units, fewer than seen."""
    rows = grid.join(f.select(*keys, "t", "u"), list(keys)).where(F.col("m") < F.col("t")).join(kinds, list(keys))
    t, x, m = F.col("t"), F.col("n"), F.col("m")
    # ln of C(t - x, m) / C(t, m); a unit less gives the coverage.
    ends = F.transform(F.array(t - x + 1, t - x - m + 1, t + 1, t - m + 1), lambda v: log_gamma(v.cast("double")))
    rows = rows.withColumn("g", F.when(t - x >= m, ends)).withColumn("none", F.coalesce(F.exp(F.col("g")[0] - F.col("g")[1] - F.col("g")[2] + F.col("g")[3]), F.lit(0.0)))
    rows = rows.withColumn("cover", x / F.col("u") * F.col("none") * t / (t - m))
    return rows.groupBy(*keys, "m").agg(F.sum(F.col("_k") * (1 - F.col("none"))).alias("s"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sum(F.col("_k") * F.col("cover")))).alias("c"))


def _above(f: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same of m units, as many as seen or more."""
    rows = grid.join(f, list(keys)).where(F.col("m") >= F.col("t"))
    t, q1, q0, more = F.col("t"), F.col("q1"), F.col("q0"), F.col("m") - F.col("t")
    found = F.when(q0 > 0, q0 * (1 - F.pow(1 - q1 / (t * q0 + q1), more))).otherwise(F.lit(0.0))
    c = 1 - q1 / F.col("u") * F.pow("a", more + 1)
    return rows.select(*keys, "m", (F.col("observed_count") + found).alias("s"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias("c"))


def rarefied(counts: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Species and coverage of m < n individuals, for a grid (keys, m)."""
    return _below(_repeats(counts, keys), sizes(counts, keys), grid, keys)


def extrapolated(counts: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Species and coverage of m >= n individuals."""
    return _above(sizes(counts, keys), grid, keys)


def coverage_curve(counts: DataFrame, grid: DataFrame, keys: Sequence[str], trials: DataFrame | None = None) -> DataFrame:
    """Both sides of the sample; of sampling units instead of individuals with ``trials``."""
    f = sizes(counts, keys, trials)
    return _below(_repeats(counts, keys), f, grid, keys).unionByName(_above(f, grid, keys))


def incidence_curve(incidence: DataFrame, trials: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Species and coverage of m sampling units, from incidence counts; ``trials``: keys, t."""
    return coverage_curve(incidence, grid, keys, trials)


def _least_effort(curve: Callable[[DataFrame], DataFrame], ask: DataFrame, keys: Sequence[str], steps: int) -> DataFrame:
    """``ask`` (keys, goal, low, high) with low and high moved together: high is the least whole effort
    with coverage of at least ``goal``, low the one before.

    The given low must miss the goal and high reach it.  Coverage grows with effort, so each
    round looks at ``steps`` points between the last miss and the first hit of every group.
    """
    ask = materialize(ask)
    while True:
        wide = F.col("high") - F.col("low")
        step = F.ceil(wide / steps).cast("long")
        open_ = ask.where(wide > 1).withColumn("_step", step)
        if open_.isEmpty():
            return ask
        grid = open_.select(*keys, F.explode(F.sequence(F.col("low") + F.col("_step"), F.col("high") - 1, F.col("_step"))).alias("m"))
        first = curve(grid).join(open_.select(*keys, "goal"), list(keys)).where(F.col("c") >= F.col("goal")).groupBy(*keys).agg(F.min("m").alias("_hit"))
        last = F.col("low") + F.floor((wide - 1) / step).cast("long") * step  # of the grid, where all points miss
        low = F.when(wide <= 1, F.col("low")).otherwise(F.coalesce(F.col("_hit") - step, last))
        ask = materialize(ask.join(first, list(keys), "left").select(*keys, "goal", low.alias("low"), F.coalesce("_hit", "high").alias("high")))


def effort_for_coverage(counts: DataFrame, keys: Sequence[str], target: float, steps: int = 200) -> DataFrame:
    """Least whole effort with coverage of at least ``target``: a search in rounds of ``steps`` points below n, the closed form above."""
    f = materialize(chao1(counts, keys))
    kinds, seen = materialize(_repeats(counts, keys)), f.select(*keys, F.col("n").alias("t"), F.col("n").alias("u"))
    ask = f.where(F.col("coverage") >= target).select(*keys, F.lit(float(target)).alias("goal"), F.lit(0).cast("long").alias("low"), F.col("n").cast("long").alias("high"))
    below = _least_effort(lambda grid: _below(kinds, seen, grid, keys), ask, keys, steps).select(*keys, F.col("high").alias("below"))
    n, f1, a = F.col("n"), F.col("f1"), F.col("a_factor")
    more = F.ceil(F.log(F.lit(1 - target) / (f1 / n)) / F.log(a) - 1)
    above = F.when((a > 0) & (a < 1), n + F.greatest(F.lit(1), more)).cast("long")
    return f.join(below, list(keys), "left").select(*keys, F.coalesce("below", above).alias("effort"), "coverage")


def summary(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes, the first three species, p0 and coverage of each fit."""
    names = counts.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_set("species")), 1, 3).alias("sample_species"))
    return chao1(counts, keys).select(*keys, "n", "observed_count", "population_count", "unseen_count", "p0", "coverage").join(names, list(keys))


def chao1_plain(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chao1 without the (n-1)/n factor: richness, completeness c0 and coverage c1."""
    f = frequencies(counts, keys)
    n, f1, f2, s = F.col("n"), F.col("f1").cast("double"), F.col("f2"), F.col("observed_count")
    more = F.when(f2 > 0, f1 * f1 / F.nullif(2 * f2, F.lit(0))).otherwise(f1 * (f1 - 1) / 2)
    f = f.withColumn("s_hat", s + more).withColumn("c0", s / F.col("s_hat"))
    c1 = F.when(f1 == 0, F.lit(1.0)).when((f2 > 0) & (n > 1), 1 - f1 / n * ((n - 1) * f1 / ((n - 1) * f1 + 2 * f2))).otherwise(1 - f1 / n)
    return f.withColumn("c1", c1)


def chao2(incidence: DataFrame, trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chao2 on incidence counts; ``trials``: keys, t (sampling units)."""
    q = incidence.groupBy(*keys).agg(F.sum("n").alias("u"), F.count_if(F.col("n") == 1).alias("q1"), F.count_if(F.col("n") == 2).alias("q2"), F.count(F.lit(1)).alias("observed_count")).join(trials, list(keys))
    t, u, q1, q2, s = F.col("t"), F.col("u"), F.col("q1").cast("double"), F.col("q2"), F.col("observed_count")
    more = F.when(q2 > 0, (t - 1) / t * q1 * q1 / F.nullif(2 * q2, F.lit(0))).otherwise(q1 * (q1 - 1) / 2)
    out = q.withColumn("s_hat", s + more).withColumn("c0", s / F.col("s_hat"))
    c1 = F.when(q1 == 0, F.lit(1.0)).when((q2 > 0) & (t > 1), 1 - q1 / u * ((t - 1) * q1 / ((t - 1) * q1 + 2 * q2))).otherwise(1 - q1 / u)
    return out.withColumn("c1", c1)


def hill_numbers(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """q1 = exp of the Miller-Madow entropy, q2 = inverse of the unbiased Simpson index."""
    own = counts.join(counts.groupBy(*keys).agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k")), list(keys))
    p, n, t = F.col("n") / F.col("_t"), F.col("n"), F.col("_t")
    out = own.groupBy(*keys).agg((-F.sum(p * F.log(p)) + (F.max("_k") - 1) / (2 * F.max("_t"))).alias("h"), (F.sum(n * (n - 1)) / F.nullif(F.max(t * (t - 1)), F.lit(0))).alias("d"))
    return out.select(*keys, F.exp("h").alias("hill_q1"), (1 / F.nullif(F.col("d"), F.lit(0.0))).alias("hill_q2"))


def hill_numbers_incidence(incidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same of incidence counts, from shares of all incidences: q1 = exp of the entropy, q2 = inverse of the sum of squares."""
    own = incidence.join(incidence.groupBy(*keys).agg(F.sum("n").alias("_u")), list(keys)).withColumn("_p", F.col("n") / F.col("_u"))
    return own.groupBy(*keys).agg(F.exp(-F.sum(F.col("_p") * F.log("_p"))).alias("hill_q1"), (1 / F.sum(F.col("_p") * F.col("_p"))).alias("hill_q2"))


#: Coverages that differ by less are equal.
SAME = 1e-12


def richness_at_coverage(counts: DataFrame, keys: Sequence[str], target: Column | None = None, trials: DataFrame | None = None, within: Sequence[str] = (), most: float = 2.0, steps: int = 200) -> DataFrame:
    """Richness of each group at equal coverage, and the two efforts that enclose it.

    ``c_max`` is the coverage at ``most`` times the group's size.  The target is the least c_max of
    all groups (of all that share the keys ``within``), or ``target`` if that is less.  A group
    whose sample covers it is rarefied: ``effort_high`` is the least number of units, below that
    of the sample, that reaches it, ``effort_low`` the one before.  Else it is extrapolated, and efforts count
    the units beyond the sample.  ``s`` lies between the species at both, at ``weight`` of
    the way.  With ``trials`` (keys, t) the counts are incidences.  A sample of one unit has no curve: null.
    """
    keys = list(keys)
    f = materialize(sizes(counts, keys, trials))
    kinds = materialize(_repeats(counts, keys))
    t, u, q1, a = F.col("t"), F.col("u"), F.col("q1"), F.col("a")
    extra = F.floor((most - 1.0) * t).cast("long")
    goals = f.select(*keys, "t", "u", "q1", "a", extra.alias("_extra"), (1 - q1 / u * a).alias("_c"), (1 - q1 / u * F.pow(a, extra + 1)).alias("c_max"))
    table = list(within) or ["_all"]
    goals = goals if within else goals.withColumn("_all", F.lit(0))
    goals = goals.join(goals.groupBy(*table).agg(F.min("c_max").alias("_least")), table)
    goals = goals.withColumn("target", F.least(*([target, F.col("_least")] if target is not None else ["_least", "c_max"])))
    goals = materialize(goals.withColumn("mode", F.when(F.col("target") <= F.col("_c") + SAME, "rarefy").otherwise("extrap")))
    inside = goals.where((F.col("mode") == "rarefy") & (t > 1))
    ask = inside.select(*keys, (F.col("target") - SAME).alias("goal"), F.lit(0).cast("long").alias("low"), (t - 1).cast("long").alias("high"))
    found = _least_effort(lambda grid: _below(kinds, f, grid, keys), ask, keys, steps)
    one = F.lit(1).cast("long")
    found = found.select(*keys, F.greatest(one, F.col("high") - 1).alias("effort_low"), F.col("high").alias("effort_high"))
    rest = F.greatest((1 - F.col("target")) / F.nullif(q1 / u, F.lit(0.0)), F.lit(1e-16))
    high = F.when((a <= 0) | (a >= 1), F.lit(0)).otherwise(F.least(F.greatest(F.lit(0), F.ceil(F.log(rest) / F.log(a) - 1e-9) - 1), F.col("_extra"))).cast("long")
    beyond = goals.where("mode = 'extrap'").withColumn("effort_high", high)
    found = found.unionByName(beyond.select(*keys, F.greatest(F.lit(0).cast("long"), F.col("effort_high") - 1).alias("effort_low"), "effort_high"))
    at = goals.join(found, keys, "left")
    base = F.when(F.col("mode") == "extrap", t).otherwise(F.lit(0))
    at = materialize(at.withColumn("_m0", base + F.col("effort_low")).withColumn("_m1", base + F.col("effort_high")))
    grid = at.where("_m1 is not null").select(*keys, F.explode(F.array_distinct(F.array("_m0", "_m1"))).alias("m"))
    curve = _below(kinds, f, grid, keys).unionByName(_above(f, grid, keys))
    ends = curve.groupBy(*keys).agg(*[f_(x, "m").alias(f"_{x}{i}") for x in "sc" for i, f_ in enumerate((F.min_by, F.max_by))])
    step = F.col("_c1") - F.col("_c0")
    weight = F.when(F.abs(step) > SAME, (F.col("target") - F.col("_c0")) / step).otherwise(F.lit(0.0))
    out = at.join(ends, keys, "left").withColumn("weight", F.when(F.col("_m1").isNotNull(), weight))
    return out.select(*keys, "c_max", "target", "mode", "effort_low", "effort_high", "weight", ((1 - F.col("weight")) * F.col("_s0") + F.col("weight") * F.col("_s1")).alias("s"))


# ---------------------------------------------------------------- tables with intervals, for variants and directly-follows pairs

MODELS = {"variant": "abundance", "dfg_edge": "incidence"}


def both_models(members: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Counts (keys, species_kind, species, n) of variants by abundance and of pairs by incidence, and their numbers of traces (keys, species_kind, t)."""
    from .eventlog import edge_incidence, variants

    kinds = materialize(variants(members, keys))
    one = kinds.select(*keys, F.lit("variant").alias(KIND), F.to_json("acts").alias("species"), "n")
    two = edge_incidence(kinds, keys).select(*keys, F.lit("dfg_edge").alias(KIND), F.to_json(F.array("a", "b")).alias("species"), "n")
    kind = F.explode(F.array(*[F.lit(k) for k in MODELS])).alias(KIND)
    return one.unionByName(two), kinds.groupBy(*keys).agg(F.sum("n").alias("t")).select(*keys, kind, "t")


def asymptotic(counts: DataFrame, trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chao1 of variants, Chao2 of pairs: sizes, richness, completeness and coverage (keys include the kind)."""
    take = ["observed_count", "f1", "f2", "s_hat", "c0", "c1"]
    one = chao1_plain(counts.where(F.col(KIND) == "variant"), keys).select(*keys, *take)
    two = chao2(counts.where(F.col(KIND) == "dfg_edge"), trials, keys).withColumnsRenamed({"q1": "f1", "q2": "f2"}).select(*keys, *take)
    return one.unionByName(two)


def population_replicates(counts: DataFrame, trials: DataFrame, keys: Sequence[str], replicates: int, seed: int = 17) -> DataFrame:
    """Counts of replicates of the estimated population: keys, replicate, species, n.

    Seen species keep 1 - u of their share, u being what the sample doesn't cover; it is spread evenly over
    as many unseen species as the estimate has more than were seen.  Abundances are one multinomial
    draw, so that a replicate has the sample's size; incidences are a binomial draw of t for each species.
    """
    from .draws import binomial, multinomial, uniform_text

    keys = list(keys)
    fit = asymptotic(counts, trials, keys).join(trials, keys).select(*keys, "t", F.greatest(F.lit(0.0), 1 - F.col("c1")).alias("_u"), F.greatest(F.lit(0), F.bround(F.col("s_hat") - F.col("observed_count"), 0)).cast("long").alias("_d"))
    fit = materialize(fit)
    seen = counts.join(fit, keys).select(*keys, "species", "t", ((1 - F.col("_u")) * F.col("n") / F.col("t")).alias("w"))
    none = fit.where("_d > 0 and _u > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_d")))
    none = none.select(*keys, F.concat(F.lit("unseen:"), F.col("_i").cast("string")).alias("species"), "t", (F.col("_u") / F.col("_d")).alias("w"))
    whole = seen.unionByName(none)
    one = multinomial(whole.where(F.col(KIND) == "variant"), trials.where(F.col(KIND) == "variant").select(*keys, F.col("t").alias("n")), replicates, keys, seed)
    each = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    two = whole.where(F.col(KIND) == "dfg_edge").select(*keys, "species", "t", F.least("w", F.lit(1.0)).alias("w"), each)
    two = two.select(*keys, "replicate", "species", binomial("t", "w", uniform_text(seed, *keys, "replicate", "species")).alias("n")).where("n > 0")
    return one.unionByName(two)


def richness_table(members: DataFrame, keys: Sequence[str], replicates: int, mode: str = "population", resample=None, bound: bool = True, level: float = 0.95) -> DataFrame:
    """Richness of variants (Chao1) and of directly-follows pairs (Chao2) of each window, with bootstrap intervals.

    ``population``: replicates of the estimated population.  ``empirical``: traces drawn with
    replacement, or by ``resample`` (members, replicates, keys -> members with one more key,
    ``replicate``).  ``bound`` keeps the interval at or above what was seen and around the estimate.
    """
    from .resample import interval, trace_bootstrap

    if mode not in ("population", "empirical"):
        raise ValueError(f"unknown mode {mode!r}")
    own, again = [*keys, KIND], [*keys, KIND, "replicate"]
    counts, trials = both_models(members, keys)
    counts, trials = materialize(counts), materialize(trials)
    if mode == "empirical":
        values = asymptotic(*both_models((resample or trace_bootstrap)(members, replicates, list(keys)), [*keys, "replicate"]), again)
    else:
        drawn = population_replicates(counts, trials, own, replicates)
        every = counts.select(*own).distinct().select(*own, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
        f1, f2 = F.count_if(F.col("n") == 1).cast("double"), F.count_if(F.col("n") == 2)
        part = F.when(F.col(KIND) == "dfg_edge", (F.col("t") - 1) / F.col("t")).otherwise(F.lit(1.0))
        found = drawn.groupBy(*again).agg(F.count(F.lit(1)).alias("_s"), f1.alias("_1"), f2.alias("_2"))
        values = every.join(found, again, "left").na.fill(0, ["_s", "_1", "_2"]).join(trials, own)  # none at all is a replicate too
        values = values.withColumn("s_hat", F.col("_s") + F.when(F.col("_2") > 0, part * F.col("_1") * F.col("_1") / F.nullif(2 * F.col("_2"), F.lit(0))).otherwise(F.col("_1") * (F.col("_1") - 1) / 2))
    bounds = interval(values.select(*own, F.col("s_hat").alias("value")), own, "percentile", level).select(*own, "ci_low", "ci_high", F.col("mean").alias("boot_mean"))
    total = counts.groupBy(*own).agg(F.sum("n").alias("u"))
    span = members.groupBy(*keys).agg(F.min("trace_index").alias("window_start"), F.max("trace_index").alias("window_end"))
    out = asymptotic(counts, trials, own).join(bounds, own, "left").join(trials, own).join(total, own).join(span, list(keys))
    if bound:
        out = out.withColumn("ci_low", F.least(F.greatest("ci_low", "observed_count"), "s_hat")).withColumn("ci_high", F.greatest("ci_high", "s_hat"))
    return out.select(*own, "window_start", "window_end", "observed_count", "f1", "f2", "s_hat", "ci_low", "ci_high", "boot_mean", "c0", "c1", "t", "u")


def equal_coverage_table(members: DataFrame, keys: Sequence[str], replicates: int, within: Sequence[str] = (), target: Column | None = None, most: float = 2.0, level: float = 0.95) -> DataFrame:
    """Richness of variants and of pairs of each window at the coverage that all windows reach, with an interval at fixed effort, and Hill numbers.

    A replicate draws the window's traces again and is measured at the two efforts of the window
    itself, mixed with its weight; rarefied efforts stay below the replicate's own traces.
    """
    from .resample import interval, trace_bootstrap

    keys, own = list(keys), [*keys, KIND]
    again = [*own, "replicate"]
    counts, trials = both_models(members, keys)
    counts, trials = materialize(counts), materialize(trials)
    at = materialize(richness_at_coverage(counts, own, target, trials, [*within, KIND], most))
    drawn, units = both_models(trace_bootstrap(members, replicates, keys), [*keys, "replicate"])
    drawn, units = materialize(drawn), materialize(units)
    ends = F.explode(F.array(F.struct(F.col("effort_low").alias("e"), (1 - F.col("weight")).alias("w")), F.struct(F.col("effort_high").alias("e"), F.col("weight").alias("w")))).alias("x")
    points = units.join(at.where("weight is not null").select(*own, "mode", ends), own)
    inside = F.when(F.col("t") > 1, F.least(F.greatest(F.col("x.e"), F.lit(1)), F.col("t") - 1)).otherwise(F.col("t"))
    points = points.select(*again, F.when(F.col("mode") == "rarefy", inside).otherwise(F.col("t") + F.col("x.e")).alias("m"), F.col("x.w").alias("_w"))
    points = materialize(points.groupBy(*again, "m").agg(F.sum("_w").alias("_w")))
    curve = coverage_curve(drawn, points.select(*again, "m"), again, units).join(points, [*again, "m"])
    values = curve.groupBy(*again).agg(F.sum(F.col("s") * F.col("_w")).alias("value"))
    bounds = interval(values, own, "percentile", level).select(*own, "ci_low", "ci_high", F.col("mean").alias("boot_mean"))
    hill = hill_numbers(counts.where(F.col(KIND) == "variant"), own).unionByName(hill_numbers_incidence(counts.where(F.col(KIND) == "dfg_edge"), own))
    span = members.groupBy(*keys).agg(F.min("trace_index").alias("window_start"), F.max("trace_index").alias("window_end"))
    out = asymptotic(counts, trials, own).drop("f1", "f2").join(hill, own).join(at, own).join(bounds, own, "left").join(span, keys)
    return out.select(*own, "window_start", "window_end", "observed_count", "s_hat", "hill_q1", "hill_q2", "c0", "c1", "target", "mode", "effort_low", "effort_high", "weight", "s", "ci_low", "ci_high", "boot_mean", "c_max")
