"""Golden values of four small logs, and invariants."""

import pytest
from pyspark.sql import functions as F

from tracelens.operators import eventlog as L
from tracelens.operators import measures as M
from tracelens.operators.metrics import COLUMNS, select_metrics

LOGS = {
    "single": ["AB"], "simple": ["ABC", "ABD", "ABC"], "standard": ["ABC", "ABD", "ABC", "EF", "ABCD", "A"],
    "complex": ["ABCD", "ABCD", "ABEF", "ACBD", "AABB", "XYZ", "A", "AB"],
}
# Expected measures, in the order single, simple, complex, standard.
GOLDEN = {
    "number_of_events": (2, 9, 26, 16), "number_of_distinct_activities": (2, 4, 9, 6), "number_of_traces": (1, 3, 8, 6),
    "number_of_distinct_traces": (1, 2, 7, 5), "number_of_distinct_directly_follows_relations": (1, 3, 12, 5),
    "min_trace_length": (2, 3, 1, 1), "avg_trace_length": (2, 3, 3.25, 2.6666666666666665), "max_trace_length": (2, 3, 4, 4),
    "percentage_of_distinct_traces": (1, 0.6666666666666666, 0.875, 0.8333333333333334),
    "average_distinct_activities_per_trace": (2, 3, 3, 2.6666666666666665), "structure": (0.75, 0.8125, 0.8518518518518519, 0.8611111111111112),
    "estimated_number_of_acyclic_paths": (1, 1, 2.0892961308540396, 1), "number_of_ties_in_paths_to_goal": (1, 4, 15, 8),
    "lempel_ziv_complexity": (2, 6, 19, 14), "average_affinity": (None, 0.6666666666666666, 0.39285714285714285, 0.36666666666666664),
    "deviation_from_random": (0, 0.40995919789547774, 0.6553987811977444, 0.4906586886688147),
    "average_edit_distance": (None, 0.6666666666666666, 2.642857142857143, 1.9333333333333333),
    "variant_entropy": (0, 2.249340578475233, 23.80177061292071, 6.689899237787739), "sequence_entropy": (0, 3.1394888625872888, 32.81595201289252, 9.630783547716632),
}


def members(spark, logs=LOGS):
    rows = [(g, i, list(t), len(t)) for g, ts in logs.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "log string, pos long, acts array<string>, len int")


@pytest.fixture(scope="module")
def measured(spark):
    return {r["log"]: r.asDict() for r in M.all_measures(members(spark), ["log"]).collect()}


@pytest.mark.parametrize("column", GOLDEN)
def test_golden(measured, column):
    for log, want in zip(("single", "simple", "complex", "standard"), GOLDEN[column]):
        assert measured[log][column] == (None if want is None else pytest.approx(want, abs=1e-6)), log


def test_invariants(measured):
    for r in measured.values():
        assert r["min_trace_length"] <= r["avg_trace_length"] <= r["max_trace_length"]
        assert r["number_of_distinct_traces"] <= r["number_of_traces"]
        for c in ("percentage_of_distinct_traces", "structure", "deviation_from_random", "normalized_variant_entropy", "normalized_sequence_entropy"):
            assert 0 <= r[c] <= 1


def test_partitioning_does_not_matter(spark):
    one = M.all_measures(members(spark).repartition(1), ["log"]).orderBy("log").collect()
    assert one == M.all_measures(members(spark).repartition(7), ["log"]).orderBy("log").collect()


def test_infinite_paths(spark):
    df = spark.createDataFrame([(1.0, 5000.0)], "a double, e double")
    assert df.select(M.acyclic_paths(F.col("a"), F.col("e")).alias("x")).first()["x"] == float("inf")


def test_custom_measure_and_selection(spark):
    double = ("double_events", lambda m, keys: m.groupBy(*keys).agg((2 * F.sum("len")).alias("double_events")))
    rows = M.all_measures(members(spark), ["log"], ["number_of_events"], custom=[double]).collect()
    assert {r["log"]: (r["number_of_events"], r["double_events"]) for r in rows}["simple"] == (9, 18)
    assert select_metrics(["lz", "events", "lz"]) == ["Lempel-Ziv Complexity", "Number of Events"]
    assert len(COLUMNS) == 21 and len(set(COLUMNS)) == 21
    with pytest.raises(ValueError):
        select_metrics(["nothing"])


def test_null_names_are_skipped_in_pairs(spark):
    df = spark.createDataFrame([("c", "A", 1), ("c", None, 2), ("c", "B", 3)], "case_id string, activity string, t int")
    log = L.event_log(df.withColumn("t", F.timestamp_seconds("t")), "case_id", "activity", "t")
    row = L.traces(log).withColumn("pairs", L.pairs("acts")).first()
    assert row["acts"] == ["A", "B"] and row["len"] == 3 and [(p["a"], p["b"]) for p in row["pairs"]] == [("A", "B")]


def test_basis(spark):
    pop = spark.createDataFrame([("simple", k, 10) for k in ("activity", "variant", "dfg_edge")], "log string, species_kind string, population_count long")
    m = members(spark, {"simple": LOGS["simple"]})
    auto = M.all_measures(m, ["log"], COLUMNS[:12], pop).first()
    assert auto["number_of_distinct_traces"] == 10 and auto["structure"] == pytest.approx(0.9)
    assert M.all_measures(m, ["log"], COLUMNS[:12], pop, "trace").first()["number_of_distinct_traces"] == 2
    with pytest.raises(ValueError):
        M.all_measures(m, ["log"], COLUMNS[:12], None, "distribution")


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance_of_many_activities(spark):
    """More activities than a byte can tell apart, and code points beyond the surrogates."""
    names = [f"a{i:05d}" for i in range(300)]
    traces = [names, names[:1], names[256:257], [], names[3:7] + names[250:260]]
    rows = [(1, i, t, len(t)) for i, t in enumerate(traces)]
    kinds = L.variants(spark.createDataFrame(rows, "window_id long, pos long, acts array<string>, len int"))
    got = M.average_edit_distance(kinds).first()["average_edit_distance"]
    pairs = [(a, b) for i, a in enumerate(traces) for b in traces[:i]]
    assert got == pytest.approx(sum(brute_distance(a, b) for a, b in pairs) / len(pairs))


def test_letters_skip_surrogates(spark):
    many = [f"{i:06d}" for i in range(0xE100)]
    kinds = spark.createDataFrame([(many,)], "acts array<string>")
    code = M.encode_variants(kinds).first()["code"]
    assert len(code) == len(many) == len(set(code))


def test_log_gamma(spark):
    import math

    from tracelens.functions.special import log_gamma

    xs = [1e-3, 0.5, 1.0, 2.0, 3.5, 9.99, 10.0, 57.0, 1e4, 3e9]
    got = [r["g"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x")).alias("g")).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-13, abs=1e-12)


def brute_entropy(traces):
    """Partitions of a prefix tree in window order, by plain loops: (sequence entropy, variant entropy, partitions, states)."""
    import math
    from collections import Counter

    part, events, first = {}, Counter(), {}
    for t in traces:
        for k in range(1, len(t) + 1):
            node = tuple(t[:k])
            events[node] += 1
            if node not in part:
                up = node[:-1]
                part[node] = part[up] if up and up not in first else node
                first.setdefault(up, node)
    s, m = Counter(part.values()), Counter()
    for node, n in events.items():
        m[part[node]] += n
    x = lambda c: sum(c.values()) * math.log(sum(c.values())) - sum(v * math.log(v) for v in c.values())
    return x(m), x(s), len(s), len(part)


def test_prefix_entropy_by_brute_force(spark):
    import random

    from tracelens.operators.sequence import prefix_entropy

    rng = random.Random(5)
    logs = {f"l{i}": ["".join(rng.choice("ABC") for _ in range(rng.randrange(0, 7))) for _ in range(30)] for i in range(6)} | {"long": ["AB" * 200, "AB" * 150 + "C"]}
    got = {r["log"]: r for r in prefix_entropy(L.variants(members(spark, logs), ["log"]), ["log"]).collect()}
    for g, ts in logs.items():
        r = got[g]
        assert (r["sequence_entropy"], r["variant_entropy"], r["number_of_partitions"], r["number_of_states"]) == pytest.approx(brute_entropy(ts))


def test_blocks_of_a_large_window(spark, monkeypatch):
    """Thousands of variants in one window: no task holds more than two blocks, results are those of one block."""
    from tracelens.operators import measures as M

    kinds = spark.range(400).select((F.col("id") % 2).alias("window_id"), F.transform(F.sequence(F.lit(0), (F.col("id") % 9).cast("int")), lambda i: F.concat(F.lit("a"), (F.pmod(F.xxhash64("id", i), F.lit(7))).cast("string"))).alias("acts"), (F.col("id") % 3 + 1).alias("n"))
    kinds = kinds.groupBy("window_id", "acts").agg(F.sum("n").alias("n"))
    got = []
    for size in (10_000, 30):
        monkeypatch.setattr(M, "BLOCK", size)
        got.append(sorted((r[0], round(r[1], 9), round(r[2], 9)) for r in M.average_affinity(kinds).join(M.average_edit_distance(kinds), "window_id").collect()))
    assert got[0] == got[1] and len(got[0]) == 2
    rows = kinds.where("window_id = 0").select("window_id", F.to_json("acts").alias("s"), "n")
    n = rows.count()
    assert M.block_pairs(rows, ["window_id"], "s").count() == n * (n - 1) // 2


def test_parse_in_batches(spark):
    """Many windows and traces of unequal length in small batches give the phrases of a parse at once."""
    from tracelens.operators.sequence import count_phrases, lempel_ziv

    rows = [(w, p, [chr(65 + (w * 31 + p * k) % 5) for k in range(1 + (w + p) % 6)]) for w in range(9) for p in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r[0]: r[1] for r in lempel_ziv(spark.createDataFrame(rows, "window_id long, pos long, acts array<string>").repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for w in range(9):
        own = [a for x, p, a in sorted(rows, key=lambda r: r[:2]) if x == w]
        assert got[w] == count_phrases(own, max(map(len, own)))
