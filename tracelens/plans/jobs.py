"""End-to-end jobs: samples of logs to analysed measures, and drift studies.

``log`` is one more key column, so all logs, sizes and samples of a study are one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize as norm
from ..operators import richness, windows
from ..operators.eventlog import species
from ..operators.measures import Custom, all_measures, unpivot
from ..operators.resample import interval, trace_bootstrap
from ..operators.tables import analysis, comparison, master


@dataclass(frozen=True)
class Scenario:
    """How measures are made: population fit, normalizers, bootstrap replicates.

    Each step can be one's own: ``population`` a function of species counts and keys,
    ``normalizers`` functions of a row's measures, ``resample`` a function of members,
    replicates and keys, ``custom`` further measures.
    """

    name: str
    population: str | Callable[[DataFrame, Sequence[str]], DataFrame] | None = None  # None, "naive", "chao1" or a function
    normalized: bool = False
    replicates: int = 0
    wanted: Sequence[str] | None = None
    hide: Sequence[str] = field(default_factory=tuple)
    normalizers: dict[str, norm.Normalizer] | None = None
    resample: Callable[[DataFrame, int, Sequence[str]], DataFrame] = trace_bootstrap
    custom: Sequence[Custom] = field(default_factory=tuple)


#: The ladder of fixes: plain, normalized, normalized with estimated populations.
LADDER = [Scenario("base"), Scenario("normalized", normalized=True), Scenario("normalized_population", "chao1", True, 50)]


@dataclass(frozen=True)
class Study:
    """A named bias study: its title, logs, scenario, and the study that it is compared with."""

    title: str
    logs: tuple[str, ...]
    scenario: Scenario
    base: str | None = None


#: Names, titles and logs of the bias studies.
STUDIES = {
    "synthetic_base": Study("Synthetic (Base)", ("O2C_S", "CLAIM_S", "LOAN_S", "CREDIT_S"), Scenario("synthetic_base")),
    "synthetic_normalized": Study("Synthetic (Normalized)", ("O2C_S", "CLAIM_S", "LOAN_S", "CREDIT_S"), Scenario("synthetic_normalized", normalized=True), "synthetic_base"),
    "synthetic_normalized_and_population": Study("Synthetic (Normalized + Population)", ("O2C_S", "CLAIM_S", "LOAN_S", "CREDIT_S"), Scenario("synthetic_normalized_and_population", "chao1", True), "synthetic_base"),
    "real_base": Study("Real (Base)", ("BPIC12", "RTFMP"), Scenario("real_base")),
    "real_normalized": Study("Real (Normalized)", ("BPIC12", "RTFMP"), Scenario("real_normalized", normalized=True), "real_base"),
    "real_normalized_and_population": Study("Real (Normalized + Population)", ("BPIC12", "RTFMP"), Scenario("real_normalized_and_population", "chao1", True), "real_base"),
}


def named_study(members: DataFrame, name: str, sizes: Sequence[int]) -> dict[str, DataFrame]:
    """Results of one of :data:`STUDIES` on the samples of its logs, compared with its base where it has one."""
    study = STUDIES[name]
    own = members.where(F.col("log").isin(*study.logs))
    if study.base:
        return bias_study(own, STUDIES[study.base].scenario, study.scenario, sizes)
    raw = measure_samples(own, study.scenario)
    table = analysis(raw)
    return {f"raw_{name}": raw, f"analysis_{name}": table, f"master_{name}": master(table, sizes)}


def measure(members: DataFrame, keys: Sequence[str], scenario: Scenario) -> DataFrame:
    """Visible values, long: keys, metric, value."""
    population = None
    if scenario.population:
        fit = {"chao1": richness.chao1, "naive": richness.naive}.get(scenario.population, scenario.population)
        population = fit(species(members, keys), [*keys, richness.KIND])
    extra = ["number_of_partitions", "number_of_states"] if scenario.normalized else []
    from ..operators.metrics import COLUMNS, NAMES

    names = [COLUMNS[NAMES.index(w)] if w in NAMES else w for w in scenario.wanted] if scenario.wanted else list(COLUMNS)
    if scenario.normalized:
        # What the normalizers read stays hidden, unless it was asked for.
        need = ["number_of_events", "number_of_traces", "number_of_distinct_activities"]
        if not any("entropy" in n for n in names):
            extra = []
        extra += [n for n in need if n not in names]
    table = all_measures(members, keys, [*names, *extra], population, custom=scenario.custom)
    names += [n for n, _ in scenario.custom]
    if not scenario.normalized:
        return unpivot(table, list(keys))
    rows = norm.normalize(table, list(keys), scenario.normalizers, hide=[*scenario.hide])
    shown = rows.withColumn("hidden", F.when(F.col("metric").isin([n for n, _ in scenario.custom]), F.lit(False)).otherwise(F.col("hidden")))
    return norm.visible(shown).where(F.col("metric").isin(names))


def measure_samples(members: DataFrame, scenario: Scenario, keys: Sequence[str] = ("log", "sample_size", "sample_id")) -> DataFrame:
    """Raw metrics: keys, metric, value, and bootstrap bounds where the scenario has replicates."""
    keys = list(keys)
    raw = measure(members, keys, scenario)
    if not scenario.replicates:
        return raw
    again = measure(scenario.resample(members, scenario.replicates, keys), [*keys, "replicate"], replace(scenario, replicates=0))
    bounds = interval(again, [*keys, "metric"]).select(*keys, "metric", F.col("ci_low").alias("boot_ci_low"), F.col("ci_high").alias("boot_ci_high"))
    return raw.join(bounds, [*keys, "metric"], "left")


def bias_study(members: DataFrame, before: Scenario, after: Scenario, sizes: Sequence[int]) -> dict[str, DataFrame]:
    """Raw, analysis and master of two scenarios, and their comparison."""
    out: dict[str, DataFrame] = {}
    for s in (before, after):
        raw = measure_samples(members, s)
        table = analysis(raw)
        out |= {f"raw_{s.name}": raw, f"analysis_{s.name}": table, f"master_{s.name}": master(table, sizes)}
    out["comparison"] = comparison(out[f"master_{before.name}"], out[f"master_{after.name}"])
    return out


def synthetic_log(spark: SparkSession, kind: str, n: int) -> DataFrame:
    """Traces of a made-up log: "one_variant", "rare" (ten variants that occur once) or "two_lengths"."""
    ids = spark.range(n).withColumnRenamed("id", "trace_index")
    letters = lambda s: F.array(*[F.lit(c) for c in s])
    if kind == "one_variant":
        acts = letters("ABCDE")
    elif kind == "rare":
        acts = F.when(F.col("trace_index") >= n - 10, F.array(F.lit("A"), F.concat(F.lit("B_"), (F.col("trace_index") - (n - 10)).cast("string")))).otherwise(letters("AB"))
    elif kind == "two_lengths":
        acts = F.when(F.col("trace_index") % 2 == 0, letters("ABCDE")).otherwise(letters("ABCDEFGHIJ"))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    start = F.timestamp_seconds(F.lit(1672567200) + F.col("trace_index") * 3600)
    return ids.select("trace_index", F.concat(F.lit("c"), F.col("trace_index")).alias("case_id"), start.alias("start_ts"), acts.alias("acts")).withColumn("len", F.size("acts"))


def assess(rows: DataFrame, approach: windows.Approach, points: DataFrame | None = None, wanted: Sequence[str] | None = None) -> DataFrame:
    """Window rows of one log for one approach; comparisons have w1, w2 and delta columns."""
    p = approach.params
    if approach.type == "window_comparison":
        members = windows.pairs_of_windows(rows, p["window_1_size"], p["window_2_size"], p["offset"], p["step"])
        table = all_measures(members, ["pair_id", "side"], wanted)
        return windows.compare_pairs(table, [c for c in table.columns if c not in ("pair_id", "side")])
    if approach.type == "fixed_size_windows":
        members = windows.sliding(rows, p["window_size"], p["offset"])
    else:
        members = windows.by_change_points(rows, points)
    return windows.window_rows(members, all_measures(members, ["window_id"], wanted))


def summary_tables(windows_: DataFrame, drift: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Combined drift results: summary, deltas, their aggregates, the simple table and the correlation with size."""
    from ..operators import stats, tables

    deltas = tables.drift_deltas(windows_, drift, columns)
    aggregates = tables.delta_aggregates(deltas)
    return {"summary": tables.drift_summary(drift), "deltas": deltas, "aggregates": aggregates, "table": tables.simple_table(aggregates), "correlation": stats.trace_count_correlation(windows_, columns)}

