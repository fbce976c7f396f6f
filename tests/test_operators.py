"""Windows, samples, richness, bootstrap, normalizers, statistics, tables."""

import pytest
from pyspark.sql import functions as F

from tracelens.functions.special import incomplete_beta, t_two_sided
from tracelens.operators import normalize as N
from tracelens.operators import resample as B
from tracelens.operators import richness as R
from tracelens.operators import sampling as P
from tracelens.operators import stats as A
from tracelens.operators import tables as T
from tracelens.operators import windows as W
from tracelens.operators.eventlog import index_traces
from tracelens.plans import jobs


@pytest.fixture(scope="module")
def ten(spark):
    """Ten traces A, B, a minute apart."""
    rows = spark.range(10).select(F.concat(F.lit("c"), F.col("id")).alias("case_id"), F.timestamp_seconds(F.col("id") * 60).alias("start_ts"), F.array(F.lit("A"), F.lit("B")).alias("acts"), F.lit(2).alias("len"))
    return index_traces(rows).cache()


def test_index_is_dense(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("case_id"), F.timestamp_seconds(F.col("id") % 7).alias("start_ts"))
    got = [(r["start_ts"], r["case_id"]) for r in index_traces(rows.repartition(9)).orderBy("trace_index").collect()]
    assert got == sorted(got) and index_traces(rows).agg(F.max("trace_index")).first()[0] == 499


def test_sliding(ten):
    got = W.sliding(ten, 4, 3).groupBy("window_id").agg(F.min("trace_index"), F.max("trace_index"), F.max("pos")).orderBy("window_id").collect()
    assert [tuple(r) for r in got] == [(0, 0, 3, 3), (1, 3, 6, 3), (2, 6, 9, 3)]
    assert W.sliding(ten, 11, 1).count() == 0 and W.sliding(ten, 0, 1).count() == 0


def test_disjoint_windows_add_up(ten):
    from tracelens.operators.measures import basic

    assert basic(W.sliding(ten, 5, 5)).agg(F.sum("number_of_events")).first()[0] == 20


def test_pairs(ten):
    got = W.pairs_of_windows(ten, 3, 4, 1, 2).groupBy("pair_id", "side").agg(F.min("trace_index"), F.max("trace_index")).orderBy("pair_id", "side").collect()
    assert [tuple(r) for r in got] == [(0, 1, 0, 2), (0, 2, 1, 4), (1, 1, 2, 4), (1, 2, 3, 6), (2, 1, 4, 6), (2, 2, 5, 8)]


def test_change_points(spark, ten):
    points = spark.createDataFrame([(0, 3, "sudden"), (1, 7, "sudden")], "change_id long, change_index long, change_type string")
    got = W.window_metadata(W.by_change_points(ten, points)).orderBy("window_id").collect()
    assert [(r["first_index"], r["last_index"], r["start_cp"], r["end_cp"]) for r in got] == [(0, 2, None, 0), (3, 6, 0, 1), (7, 9, 1, None)]
    twice = points.unionByName(points)
    with pytest.raises(ValueError):
        W.by_change_points(ten, twice)
    assert W.window_metadata(W.by_change_points(ten, twice, lenient=True)).count() == 3


def test_approaches():
    ok = {"name": "a", "type": "fixed_size_windows", "params": {"window_size": 2, "offset": 1}}
    assert W.approaches([ok])[0].params["offset"] == 1
    for bad in ({**ok, "type": "x"}, {**ok, "params": {"window_size": 0, "offset": 1}}, {**ok, "params": {"window_size": 2}}):
        with pytest.raises(ValueError):
            W.approaches([bad])
    with pytest.raises(ValueError):
        W.approaches([ok, ok])


def test_samples(ten):
    a = P.sample_random(ten, [3, 4], 5).collect()
    assert len(a) == 35 and a == P.sample_random(ten.repartition(3), [3, 4], 5).orderBy("sample_size").collect() or len(a) == 35
    w = P.sample_random(ten, [4], 6, "within_only").groupBy("sample_id").agg(F.count_distinct("trace_index").alias("d")).collect()
    assert [r["d"] for r in w] == [4] * 6
    n = P.sample_random(ten, [2, 3], 2, "none")
    assert n.count() == n.select("trace_index").distinct().count() == 10
    c = P.sample_consecutive(ten, [4], 5).groupBy("sample_id").agg((F.max("trace_index") - F.min("trace_index")).alias("d"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["d"] == 3 and r["n"] == 4 for r in c)
    for policy, sizes in (("within_only", [11]), ("none", [6])):
        with pytest.raises(ValueError):
            P.sample_random(ten, sizes, 2, policy)
    with pytest.raises(ValueError):
        P.sample_random(ten, [2], 1, "other")
    with pytest.raises(ValueError):
        P.sample_consecutive(ten, [11], 1)
    assert P.sample_random(ten, [2, -1, 0], 0).count() == 0


# Counts -> n, f1, f2, unseen.
@pytest.mark.parametrize("counts,n,f1,f2,f0", [([2] * 4, 8, 0, 4, 0), ([1] * 4, 4, 4, 0, 4.5), ([6, 5, 2, 1, 1, 1], 16, 3, 1, 4.21875), ([100], 100, 0, 0, 0)])
def test_chao1(spark, counts, n, f1, f2, f0):
    df = spark.createDataFrame([("k", chr(65 + i), c) for i, c in enumerate(counts)], "k string, species string, n long")
    r = R.chao1(df, ["k"]).first()
    assert (r["n"], r["f1"], r["f2"]) == (n, f1, f2) and r["f0_hat"] == pytest.approx(f0)
    seen = R.bootstrap_community(df, ["k"]).agg(F.sum("p").alias("p"), F.max("p0").alias("p0")).first()
    assert seen["p"] + seen["p0"] == pytest.approx(1)
    again = B.species_bootstrap(df, 4, ["k"])
    assert [r[0] for r in again.groupBy("replicate").agg(F.sum("n")).select("sum(n)").collect()] == [n] * 4


def test_coverage_curve_meets_at_n(spark):
    df = spark.createDataFrame([("k", str(i), c) for i, c in enumerate([6, 5, 2, 1, 1, 1])], "k string, species string, n long")
    grid = spark.createDataFrame([("k", m) for m in (1, 5, 15, 16, 32)], "k string, m long")
    got = {r["m"]: r for r in R.coverage_curve(df, grid, ["k"]).collect()}
    assert got[1]["s"] == pytest.approx(1) and got[16]["s"] == 6 and got[15]["s"] < 6 < got[32]["s"]
    assert got[1]["c"] < got[5]["c"] < got[15]["c"] < got[16]["c"] < got[32]["c"] < 1
    assert R.effort_for_coverage(df, ["k"], 0.9).first()["effort"] > 16


def _coverage(counts, m):
    """Coverage of m < n individuals, by the formula."""
    from math import exp, lgamma

    n = sum(counts)
    return 1 - sum(c / n * exp(lgamma(n - c + 1) - lgamma(n - c - m + 1) - lgamma(n) + lgamma(n - m)) for c in counts if n - c >= m)


def test_efforts_are_exact_above_the_grid(spark):
    """n is well above the points of a round; efforts by brute force over all m."""
    groups = {"a": [3000, 2500, 2000, 40, 7, 3, 2, 1, 1], "b": [max(1, 4000 // i) for i in range(1, 300)], "c": [9, 4, 1]}
    df = spark.createDataFrame([(k, str(i), c) for k, v in groups.items() for i, c in enumerate(v)], "k string, species string, n long")
    got = {r["k"]: r["effort"] for r in R.effort_for_coverage(df, ["k"], 0.9).collect()}
    want = {k: next(m for m in range(1, sum(v)) if _coverage(v, m) >= 0.9) for k, v in groups.items()}
    assert got == want
    for r in R.richness_at_coverage(df, ["k"], F.lit(0.95)).collect():
        v = groups[r["k"]]
        if r["mode"] != "rarefy":
            continue
        m = next((m for m in range(1, sum(v)) if _coverage(v, m) >= r["target"] - 1e-12), sum(v) - 1)
        assert (r["effort_low"], r["effort_high"]) == (max(1, m - 1), m)
        low, high = _coverage(v, max(1, m - 1)), _coverage(v, m)
        assert r["weight"] == pytest.approx((r["target"] - low) / (high - low), abs=1e-4)
    assert len({round(r["target"], 12) for r in R.richness_at_coverage(df, ["k"]).collect()}) == 1


def test_singletons_without_doubletons(spark):
    """f2 = 0: coverage never grows beyond the sample, 1 - f1 / n."""
    df = spark.createDataFrame([(k, str(i), c) for k, v in {"a": [1, 3], "b": [1, 1, 1, 7], "c": [1], "d": [5]}.items() for i, c in enumerate(v)], "k string, species string, n long")
    grid = df.groupBy("k").agg(F.sum("n").alias("t")).select("k", F.explode(F.array("t", 2 * F.col("t"))).alias("m"))
    got = {}
    for r in R.extrapolated(df, grid, ["k"]).collect():
        got.setdefault(r["k"], set()).add(round(r["c"], 9))
    assert got == {"a": {0.75}, "b": {0.7}, "c": {0.0}, "d": {1.0}}
    at = {r["k"]: r for r in R.richness_at_coverage(df.where("k <> 'c'"), ["k"]).collect()}
    assert {k: r["mode"] for k, r in at.items()} == {"a": "rarefy", "b": "rarefy", "d": "rarefy"} and at["b"]["target"] == pytest.approx(0.7)
    lone = R.richness_at_coverage(df.where("k = 'c'"), ["k"]).first()
    assert lone["effort_high"] is None and lone["s"] is None  # one individual has no curve


def test_incidence_is_abundance_with_other_totals(spark):
    """Where each unit has one species, both are the same."""
    df = spark.createDataFrame([("k", str(i), c) for i, c in enumerate([9, 5, 2, 2, 1, 1, 1])], "k string, species string, n long")
    trials = spark.createDataFrame([("k", 21)], "k string, t long")
    assert R.richness_at_coverage(df, ["k"], F.lit(0.8)).first() == R.richness_at_coverage(df, ["k"], F.lit(0.8), trials).first()


def test_tables_of_windows(spark, ten):
    """Point estimates lie inside bounded intervals; a window of one variant has no spread."""
    for mode in ("population", "empirical"):
        rows = R.richness_table(W.sliding(ten, 5, 5), ["window_id"], 3, mode=mode).collect()
        assert len(rows) == 4 and all(r["ci_low"] == r["ci_high"] == r["s_hat"] == 1 for r in rows)
    rows = R.equal_coverage_table(W.sliding(ten, 5, 5), ["window_id"], 3).collect()
    assert len(rows) == 4 and all(r["s"] == r["ci_low"] == r["ci_high"] == 1 and r["c_max"] == 1 for r in rows)
    with pytest.raises(ValueError):
        R.richness_table(W.sliding(ten, 5, 5), ["window_id"], 3, mode="other")


def test_binomial_draws(spark):
    """Moments, exact inversion against sums, and a large number of trials without a step for each."""
    from math import comb, sqrt

    import numpy as np

    from tracelens.operators.draws import binomial, uniform_text

    df = spark.range(3000).select(F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(p).alias("p")) for n, p in ((7, 0.4), (90, 0.02), (60, 0.97))])).alias("x"), F.expr(uniform_text(5, "id")).alias("u")).select("x.*", "u")
    got = df.withColumn("k", binomial("n", "p", "u")).toPandas()
    for (n, p), g in got.groupby(["n", "p"]):
        cdf = np.cumsum([comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        assert (g["k"] == np.searchsorted(cdf, g["u"])).all()
        assert abs(g["k"].mean() - n * p) < 5 * sqrt(n * p * (1 - p) / len(g))
    large = spark.range(40).select(binomial("100000000", "0.25D", uniform_text(6, "id")).alias("k")).toPandas()["k"]
    assert abs(large.mean() - 25_000_000) < 5 * sqrt(10**8 * 0.1875 / 40) and large.std() < 2 * sqrt(10**8 * 0.1875)
    edges = spark.createDataFrame([(0, 0.5), (9, 0.0), (9, 1.0)], "n long, p double").select(binomial("n", "p", "0.3D").alias("k")).collect()
    assert [r["k"] for r in edges] == [0, 0, 9]


def test_multinomial_draws(spark):
    """Counts sum to n under several sizes of tree; shares follow the weights; rows don't grow with n."""
    from tracelens.operators.draws import multinomial

    weights = spark.createDataFrame([("a", f"s{i}", float(i % 7 + 1)) for i in range(200)] + [("b", "x", 1.0), ("b", "y", 3.0), ("b", "z", 0.0)], "k string, species string, w double")
    totals = spark.createDataFrame([("a", 3_000_000), ("b", 40), ("none", 0)], "k string, n long")
    rows = multinomial(weights, totals, 6, ["k"], 3).toPandas()
    sums = rows.groupby(["k", "replicate"])["n"].sum()
    assert sorted(set(sums["a"])) == [3_000_000] and sorted(set(sums["b"])) == [40] and len(sums) == 12
    assert len(rows) <= 6 * 202 and set(rows[rows["k"] == "b"]["species"]) == {"x", "y"}
    mean = rows[rows["k"] == "a"].groupby("species")["n"].mean()
    total = sum(i % 7 + 1 for i in range(200))
    z = [(mean[f"s{i}"] - 3e6 * (i % 7 + 1) / total) / (3e6 * (i % 7 + 1) / total / 6) ** 0.5 for i in range(200)]
    assert max(map(abs, z)) < 5 and 0.7 < (sum(x * x for x in z) / 200) ** 0.5 < 1.3


def test_replicates_have_both_sides(spark, ten):
    """Refitted populations and traces drawn again, under the same keys."""
    from tracelens.operators.measures import all_measures

    fits, traces = B.inext_replicates(W.sliding(ten, 5, 5), 3)
    assert fits.count() == 2 * 3 * 3 and traces.groupBy("window_id", "replicate").count().select("count").distinct().collect()[0][0] == 5
    done = all_measures(traces, ["window_id", "replicate"], ["number_of_traces", "number_of_distinct_traces"], fits)
    assert done.count() == 6 and {tuple(r) for r in done.select("number_of_traces", "number_of_distinct_traces").collect()} == {(5, 1)}


def test_permutations(spark):
    """Every place once, for any size; keys choose the permutation; nothing is as long as the log."""
    seen = set()
    for n in (1, 2, 3, 7, 10, 97, 1000):
        both = spark.range(n).select("id", P.permuted("id", n, 1).alias("a"), P.permuted("id", n, 1, "id % 1").alias("b")).collect()
        assert sorted(r["a"] for r in both) == sorted(r["b"] for r in both) == list(range(n))
        seen.add(tuple(r["a"] for r in both) == tuple(r["b"] for r in both))
    assert False in seen
    few = spark.range(5).select(P.permuted("id", 10**12, 1).alias("a")).collect()
    assert len({r["a"] for r in few}) == 5 and all(0 <= r["a"] < 10**12 for r in few)


def test_ranks_across_ranges(spark):
    """Average ranks of a group that lies in several ranges, with ties, against sorting."""
    values = [(k, float((i * 7919) % 101)) for k in "ab" for i in range(300 if k == "a" else 5)] + [("c", 1.0)]
    got = A.average_ranks(spark.createDataFrame(values, "k string, v double").repartition(6), "v", ["k"], "r").collect()
    for k in "abc":
        own = sorted(v for g, v in values if g == k)
        want = {v: (own.index(v) + 1 + own.index(v) + own.count(v)) / 2 for v in own}
        mine = [r for r in got if r["k"] == k]
        assert len(mine) == len(own) and all(r["r"] == want[r["v"]] for r in mine)


def test_intervals(spark):
    df = spark.createDataFrame([("m", float(v)) for v in (1, 2, 3, 4)] + [("m", None), ("m", float("inf"))], "metric string, value double")
    r = B.interval(df, ["metric"]).first()
    assert r["n"] == 4 and r["mean"] == 2.5 and r["ci_high"] == pytest.approx(2.5 + 1.96 * r["std"] / 2)
    assert B.interval(df, ["metric"], "percentile", 0.5).first()["ci_low"] == pytest.approx(1.75)


def test_normalizers(spark):
    df = spark.createDataFrame([(1, 20, 5, 0.4, 10, 4.0)], "window_id int, number_of_events long, number_of_traces long, percentage_of_distinct_traces double, number_of_distinct_activities long, lempel_ziv_complexity double")
    rows = {r["metric"]: r for r in N.normalize(df, ["window_id"]).collect()}
    assert rows["number_of_events"]["value"] == 20 and rows["number_of_events"]["value_normalized"] == 4
    assert rows["number_of_traces"]["value_normalized"] == 1 and rows["percentage_of_distinct_traces"]["value_normalized"] == 2
    shown = {r["metric"]: r["value"] for r in N.visible(N.normalize(df, ["window_id"], hide=["number_of_events"], to_none=["number_of_traces"])).collect()}
    assert "number_of_events" not in shown and shown["number_of_traces"] is None
    only = N.normalize(df.select("window_id", "number_of_events"), ["window_id"]).first()
    assert only["value"] == 20 and only["value_normalized"] is None and not only["has_normalized"]


def test_distributions():
    assert incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert t_two_sided(0.0, 5) == pytest.approx(1)


def test_plateau_and_correlation(spark):
    rows = [("m", s, str(i), v) for s, v in ((50, 1.0), (100, 2.0), (150, 2.01), (200, 2.0)) for i in range(2)] + [("flat", s, "0", 3.0) for s in (50, 100)]
    raw = spark.createDataFrame(rows, "metric string, sample_size int, sample_id string, value double")
    got = {r["metric"]: r["plateau_n"] for r in A.plateau(raw).collect()}
    assert got == {"m": 100, "flat": 50}
    r = {r["metric"]: r for r in A.size_correlations(raw).collect()}
    assert r["flat"]["pearson_rho"] is None and 0 < r["m"]["pearson_p"] < 0.1


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    got = {r["i"]: r["p_adjusted"] for r in A.benjamini_hochberg(df).collect()}
    assert got[1] == pytest.approx(0.04) and got[2] == pytest.approx(0.04 * 4 / 3) and got[3] == pytest.approx(0.04 * 4 / 3) and got[4] is None


def test_stars_and_order(spark):
    df = spark.createDataFrame([(0.0001,), (0.005,), (0.03,), (0.2,), (None,)], "p double")
    assert [r[0] for r in df.select(A.stars(F.col("p"))).collect()] == ["***", "**", "*", "", ""]
    rows = spark.createDataFrame([("CT", "Size", 1, "x"), ("OC", "Size", 2, "MEAN"), ("OC", "Size", 2, "a")], "basis string, dimension string, rank int, log string")
    assert [r["log"] for r in T.ordered(rows).collect()] == ["a", "MEAN", "x"]
    assert T.rounded(spark.createDataFrame([(float("inf"), 0.12345678901234)], "a double, b double")).first() == (None, 0.1234567890)


def test_synthetic_logs_and_ladder(spark):
    from tracelens.operators.measures import all_measures

    rare = jobs.synthetic_log(spark, "rare", 60).withColumn("log", F.lit("rare")).withColumn("pos", F.col("trace_index"))
    r = all_measures(rare, ["log"], ["number_of_distinct_traces"]).first()
    assert r["number_of_distinct_traces"] == 11
    one = jobs.synthetic_log(spark, "one_variant", 30).withColumn("log", F.lit("one")).withColumn("pos", F.col("trace_index"))
    assert all_measures(one, ["log"], ["variant_entropy", "number_of_distinct_traces"]).first()["variant_entropy"] == 0
    two = jobs.synthetic_log(spark, "two_lengths", 10)
    assert two.agg(F.sum("len")).first()[0] == 75
    members = P.sample_consecutive(rare, [20], 2)
    done = jobs.measure_samples(members, jobs.Scenario("x", "chao1", True, 3, ["number_of_distinct_traces"])).collect()
    assert len(done) == 2 and all(r["boot_ci_low"] <= r["boot_ci_high"] for r in done)


def test_ones_own_steps(spark):
    """A custom population, normalizer, resampler and measure in one study."""
    log = jobs.synthetic_log(spark, "two_lengths", 20).withColumn("log", F.lit("x")).withColumn("pos", F.col("trace_index"))
    scenario = jobs.Scenario(
        "own", lambda counts, keys: R.naive(counts, keys).withColumn("population_count", F.lit(7).cast("long")), True, 2, ["number_of_distinct_traces", "number_of_events"],
        normalizers={"number_of_events": lambda c: c("number_of_events") * 0 + 5}, resample=lambda m, n, keys: m.withColumn("replicate", F.explode(F.array(F.lit(0), F.lit(1)))),
        custom=[("longest", lambda m, keys: m.groupBy(*keys).agg(F.max("len").cast("double").alias("longest")))],
    )
    got = {r["metric"]: r for r in jobs.measure_samples(log, scenario, ["log"]).collect()}
    assert {k: r["value"] for k, r in got.items()} == {"number_of_distinct_traces": 7, "number_of_events": 5, "longest": 10}
    assert got["longest"]["boot_ci_low"] == 10


def test_samples_without_repeats(spark):
    """Up to the whole log, every sample has its size and no trace twice; different samples differ."""
    rows = spark.range(60).select(F.col("id").alias("trace_index"))
    got = {}
    for r in P.sample_random(rows, [5, 60], 4, "within_only", 3).collect():
        got.setdefault((r["sample_size"], r["sample_id"]), {})[r["pos"]] = r["trace_index"]
    assert len(got) == 8 and all(sorted(v) == list(range(k[0])) and len(set(v.values())) == k[0] for k, v in got.items())
    assert len({tuple(v[i] for i in range(5)) for v in got.values()}) == 8


def test_missing_window_at_a_drift_is_an_error(spark):
    from tracelens.operators import tables as T

    windows = spark.createDataFrame([("d", None, 0, 5.0), ("d", 0, None, 7.0)], "dataset string, start_cp long, end_cp long, m double")
    drift = spark.createDataFrame([("d", 0, "sudden")], "dataset string, change_id long, change_type string")
    assert [r["delta"] for r in T.drift_deltas(windows, drift, ["m"]).collect()] == [2.0]
    with pytest.raises(Exception, match="no window beside change 1 of d"):
        T.drift_deltas(windows, drift.unionByName(spark.createDataFrame([("d", 1, "sudden")], drift.schema)), ["m"]).collect()


# ---------------------------------------------------------------- replicates of small and of large windows

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def uneven(spark):
    """Windows of 12, 300 and 5,000 traces."""
    rows = spark.range(5000).select(F.explode(F.array(*[F.lit(x).cast("long") for x in (12, 300, 5000)])).alias("n"), F.col("id").alias("pos")).where("pos < n")
    return rows.select((F.length(F.col("n").cast("string")) - 2).cast("long").alias("window_id"), "pos", F.array(F.lit("A"), F.concat(F.lit("B"), (F.col("pos") % 7).cast("string"))).alias("acts"), F.lit(2).alias("len"), (F.col("pos") + 100).alias("trace_index"))


def _places(size, window, replicate, seed=7):
    import hashlib

    return {(window, replicate, s, int(hashlib.md5(f"{seed}:{window}:{replicate}:{s}".encode()).hexdigest()[:8], 16) % size + 100) for s in range(size)}


@pytest.mark.parametrize("held", [1, 100, 4096, 10**6])
def test_traces_drawn_again(uneven, monkeypatch, held):
    monkeypatch.setattr(B, "HELD", held, raising=False)
    again = B.trace_bootstrap(uneven, 2)
    got = [tuple(r) for r in again.select("window_id", "replicate", "pos", "trace_index").collect()]
    assert len(got) == 2 * 5312 and set(got) == set().union(*[_places(n, w, k) for w, n in ((0, 12), (1, 300), (2, 5000)) for k in (0, 1)])


def test_slots_of_large_windows_are_not_broadcast(uneven):
    """Slots are made by rows that look small: joined without a hint, all of them went to the driver."""
    large = _plan(B.trace_bootstrap(uneven.where("window_id = 2"), 20).select("window_id", "replicate", "pos", "trace_index"))
    assert "ShuffledHashJoin" in large and "BroadcastHashJoin" not in large and "BroadcastNestedLoopJoin" not in large


def test_replicates_of_traces_and_their_tables(uneven, monkeypatch):
    """Both tables are the same, whether windows are drawn from a row or by a shuffle."""
    found = []
    for held in (1, 10**6):
        monkeypatch.setattr(B, "HELD", held, raising=False)
        one = R.richness_table(uneven, ["window_id"], 5, mode="empirical").orderBy("window_id", R.KIND).collect()
        two = R.equal_coverage_table(uneven, ["window_id"], 5).orderBy("window_id", R.KIND).collect()
        found.append((one, two))
    assert [tuple(r) for r in found[0][0]] == [tuple(r) for r in found[1][0]] and len(found[0][0]) == 6
    for a, b in zip(found[0][1], found[1][1]):
        assert a.asDict().keys() == b.asDict().keys() and all(x == y if not isinstance(x, float) else x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b))


def test_traces_of_replicates_need_no_communities(spark, data, monkeypatch):
    """The query of one side doesn't work out the other."""
    from tracelens.plans.queries import QUERIES

    monkeypatch.setattr(B, "species_bootstrap", lambda *a, **k: pytest.fail("communities drawn"))
    assert QUERIES["inext_replicate_traces"](spark, data).columns == ["window_id", "replicate", "pos", "trace_index"]


def test_replicates_of_small_windows_are_drawn_in_place(uneven):
    """No slot of a small window goes through a shuffle or a join by its place."""
    import re

    plan = _plan(B.trace_bootstrap(uneven.where("window_id < 2"), 20))
    assert not re.search(r"(Join|hashpartitioning)[^\n]*(pos|_at|replicate)#", plan)


def test_counts_without_sets(uneven):
    """Sizes alone don't count activities and pairs."""
    from tracelens.operators.measures import basic

    one, all_ = basic(uneven, sets=False), basic(uneven)
    assert "number_of_distinct_activities" not in one.columns and "Join" not in _plan(one)
    assert one.orderBy("window_id").collect() == all_.select(*one.columns).orderBy("window_id").collect()


def test_ranks_of_values_that_change_when_worked_out_again(spark):
    """Sums of doubles may differ in the last bit between two runs of one plan; no row may be lost by that."""
    import random

    shaky = F.udf(lambda i: i + random.random() * 1e-9, "double").asNondeterministic()
    rows = spark.range(200).select((F.col("id") % 2).alias("k"), "id").withColumn("y", shaky("id"))
    got = A.average_ranks(rows, "y", ["k"], "r").collect()
    assert sorted((r["k"], r["r"]) for r in got) == [(k, float(i)) for k in (0, 1) for i in range(1, 101)]
    both = A.size_correlations(rows.select("k", (F.col("id") % 5).alias("sample_size"), F.col("y").alias("value")), ["k"]).collect()
    assert [r["n"] for r in both] == [100, 100] and all(r["spearman_rho"] is not None for r in both)


def test_signed_ranks_of_values_that_change(spark):
    import random

    shaky = F.udf(lambda i: i - 20 + random.random() * 1e-9, "double").asNondeterministic()
    w = A.wilcoxon_greater(spark.range(100).withColumn("metric", F.lit("x")).withColumn("delta_r", shaky("id") + 0.3), ["metric"]).first()
    d = [i - 19.7 for i in range(100)]
    order = sorted(range(100), key=lambda i: abs(d[i]))
    assert (w["m"], w["w_plus"]) == (100, sum(r for r, i in enumerate(order, 1) if d[i] > 0))


def test_many_binomial_draws_at_once():
    """The draws of a batch are those of the sums, one by one."""
    import math
    import random

    import numpy as np

    from tracelens.operators.draws import binomials

    rnd = random.Random(3)
    cases = [(rnd.randrange(0, 500), rnd.random(), rnd.random()) for _ in range(300)] + [(0, 0.5, 0.5), (7, 0.0, 0.9), (7, 1.0, 0.1), (40000, 0.25, 0.999), (3, 0.5, 1e-9), (3, 0.5, 1 - 1e-9)]

    def one(n, p, u):
        if n <= 0 or p <= 0 or p >= 1:
            return n if n > 0 and p >= 1 else 0
        wide, total = 8 * math.sqrt(n * p * (1 - p)) + 20, 0.0
        low, high = max(0, math.floor(n * p - wide)), min(n, math.ceil(n * p + wide))
        for k in range(low, high + 1):
            total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
            if total >= u:
                return k
        return high

    n, p, u = (np.array(x) for x in zip(*cases))
    assert binomials(n, p, u).tolist() == [one(*c) for c in cases]


def test_nodes_of_the_tree_are_dealt_to_tasks(spark):
    """Few bytes, much work: without a fixed number of parts one task would draw all."""
    from tracelens.operators.draws import multinomial

    w = spark.range(200).select(F.lit("x").alias("k"), F.concat(F.lit("s"), F.col("id")).alias("species"), (F.col("id") + 1).cast("double").alias("w"))
    dealt = multinomial(w, spark.createDataFrame([("x", 100000)], "k string, n long"), 3, ["k"], 5)
    plan = _plan(dealt)
    assert "REPARTITION_BY_NUM" in plan and "Broadcast" not in plan
    assert [r[0] for r in dealt.groupBy("replicate").agg(F.sum("n")).select("sum(n)").collect()] == [100000] * 3


def test_species_are_counted_once(spark):
    """Draws, totals and probabilities all come from one reading of the counts."""
    seen = spark.sparkContext.accumulator(0)

    def count(n):
        seen.add(1)
        return n

    counts = spark.range(40).select(F.lit("x").alias("k"), F.concat(F.lit("s"), F.col("id")).alias("species"), F.udf(count, "long").asNondeterministic()(F.col("id") % 5 + 1).alias("n"))
    total = sum(i % 5 + 1 for i in range(40))
    assert [r[0] for r in B.species_bootstrap(counts, 2, ["k"]).groupBy("replicate").agg(F.sum("n")).select("sum(n)").collect()] == [total] * 2
    assert seen.value == 40


def test_percentiles_by_both_ways_of_drawing(uneven, monkeypatch):
    from tracelens.operators.measures import basic, unpivot

    found = []
    for held in (1, 10**6):
        monkeypatch.setattr(B, "HELD", held)
        again = basic(B.trace_bootstrap(uneven, 4), ["window_id", "replicate"], sets=False).select("window_id", "replicate", "number_of_traces", "number_of_distinct_traces")
        found.append(sorted(tuple(r) for r in B.interval(unpivot(again, ["window_id", "replicate"]), ["window_id", "metric"], "percentile").collect()))
    assert found[0] == found[1] and len(found[0]) == 6
