"""Complexity measures of windows, from variants and their counts.

Traces are aggregated to (window, variant, count) first, with a partial aggregate, so later
steps see each distinct trace of a window once.  Undefined values are null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .eventlog import edge_counts, pairs, variants

#: A custom measure: members and keys -> keys and one value column (name, function).
Custom = tuple[str, Callable[[DataFrame, Sequence[str]], DataFrame]]


def structure(activities: Column, edges: Column) -> Column:
    """1 - edges / activities squared."""
    return 1 - edges / F.nullif(F.pow(activities, F.lit(2)), F.lit(0.0))


def acyclic_paths(activities: Column, edges: Column) -> Column:
    """10 to the power 0.08 (1 + edges - activities); infinite beyond the largest double."""
    power = F.lit(0.08) * (1 + edges - activities)
    return F.when(power > 308, F.lit(float("inf"))).otherwise(F.pow(F.lit(10.0), power))


def basic(members: DataFrame, keys: Sequence[str] = ("window_id",), kinds: DataFrame | None = None, sets: bool = True) -> DataFrame:
    """Sizes, lengths, shares and ties: all measures that need counts only; without ``sets`` not those of activities and pairs."""
    kinds = variants(members, keys) if kinds is None else kinds
    n, size = F.col("n"), F.col("len")
    main = kinds.groupBy(*keys).agg(
        F.sum(n * size).alias("number_of_events"), F.sum(n).alias("number_of_traces"), F.count(F.lit(1)).alias("number_of_distinct_traces"),
        F.min(size).cast("double").alias("min_trace_length"), (F.sum(n * size) / F.sum(n)).alias("avg_trace_length"), F.max(size).cast("double").alias("max_trace_length"),
        (F.sum(n * F.size(F.array_distinct("acts"))) / F.sum(n)).alias("average_distinct_activities_per_trace"),
        F.sum(F.greatest(size - 1, F.lit(0))).cast("double").alias("number_of_ties_in_paths_to_goal"),
    )
    main = main.withColumn("percentage_of_distinct_traces", F.col("number_of_distinct_traces") / F.col("number_of_traces"))
    if not sets:
        return main
    acts = kinds.select(*keys, F.explode(F.array_distinct("acts")).alias("x")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("number_of_distinct_activities"))
    edges = kinds.select(*keys, F.explode(F.array_distinct(pairs("acts"))).alias("x")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("number_of_distinct_directly_follows_relations"))
    return main.join(acts, list(keys), "left").join(edges, list(keys), "left").na.fill(0, ["number_of_distinct_activities", "number_of_distinct_directly_follows_relations"])


def derived(df: DataFrame) -> DataFrame:
    """Structure and acyclic paths from the counts beside them."""
    a, e = F.col("number_of_distinct_activities"), F.col("number_of_distinct_directly_follows_relations")
    return df.withColumn("structure", structure(a, e)).withColumn("estimated_number_of_acyclic_paths", acyclic_paths(a, e))


def deviation_from_random(kinds: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """How far directly-follows frequencies are from uniform; null without pairs, 0 for one activity."""
    edges = edge_counts(kinds, keys)
    ends = edges.select(*keys, F.explode(F.array("a", "b")).alias("x")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("v"))
    total = edges.groupBy(*keys).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    size = ends.join(total, list(keys))
    even = 1 / (F.col("v") * F.col("v"))
    seen = edges.join(size, list(keys)).groupBy(*keys).agg(F.sum(F.pow(F.col("n") / F.col("t") - even, F.lit(2))).alias("seen"), F.max("v").alias("v"), F.max("k").alias("k"))
    far = F.sqrt(F.col("seen") + (F.col("v") * F.col("v") - F.col("k")) / F.pow("v", F.lit(4)))
    value = F.when(F.col("v") <= 1, F.lit(0.0)).otherwise(1 - far / F.sqrt(1 - even))
    return seen.select(*keys, value.alias("deviation_from_random"))


#: Rows of a window that one task holds, of each of two blocks.
BLOCK = 2000


def block_pairs(rows: DataFrame, keys: Sequence[str], unique: str) -> DataFrame:
    """Every two different rows of a group once: keys, and columns of both as structs ``a`` and ``b``.

    Rows of a large group are salted into blocks by a hash of the column ``unique``; a pair of blocks is a key
    of the join, so that no task holds more than two blocks and what follows is summed there.
    """
    keys, rest = list(keys), [c for c in rows.columns if c not in keys]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_b"))
    placed = rows.join(sizes, keys).select(*keys, F.struct(*rest).alias("x"), "_b", F.pmod(F.xxhash64(unique), F.col("_b")).cast("int").alias("_own"))
    a = placed.select(*keys, F.col("x").alias("a"), F.col("_own").alias("_lo"), F.explode(F.sequence("_own", F.col("_b") - 1)).alias("_hi"))
    b = placed.select(*keys, F.col("x").alias("b"), F.explode(F.sequence(F.lit(0), "_own")).alias("_lo"), F.col("_own").alias("_hi"))
    both = a.join(b, [*keys, "_lo", "_hi"]).where((F.col("_lo") < F.col("_hi")) | (F.col(f"a.{unique}") < F.col(f"b.{unique}")))
    return both.drop("_lo", "_hi")


def average_affinity(kinds: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """Mean Jaccard similarity of the activity sets of two different traces; null below two traces.

    Only distinct activity sets are compared, not traces or variants: there are few, as a set
    forgets order and repetition.
    """
    keys = list(keys)
    sets = kinds.select(*keys, "n", F.array_sort(F.array_distinct("acts")).alias("s")).groupBy(*keys, "s").agg(F.sum("n").alias("n"))
    total = sets.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.col("n") * (F.col("n") - 1)).cast("double").alias("same"))
    both = F.size(F.array_intersect("a.s", "b.s"))
    near = F.when(F.size("a.s") + F.size("b.s") == 0, F.lit(1.0)).otherwise(both / (F.size("a.s") + F.size("b.s") - both))
    cross = block_pairs(sets, keys, "s").groupBy(*keys).agg(F.sum(2 * F.col("a.n") * F.col("b.n") * near).alias("cross"))
    out = total.join(cross, keys, "left")
    return out.select(*keys, F.when(F.col("t") > 1, (F.col("same") + F.coalesce("cross", F.lit(0.0))) / (F.col("t") * (F.col("t") - 1))).alias("average_affinity"))


#: Characters that can stand for an activity: all code points from "0" on but surrogates.
LETTERS = 0x110000 - 0x30 - 0x800


def encode_variants(kinds: DataFrame) -> DataFrame:
    """acts, code: each activity as one character, so that text distance is activity distance.

    Distinct activities are numbered by one ordered window, at most ``LETTERS`` of them; more
    raise.  They meet the variants by an equi-join.
    """
    known_by = [F.xxhash64("acts").alias("h1"), F.xxhash64(F.lit(1), F.col("acts")).alias("h2")]
    variants_ = kinds.select("acts").distinct().select("acts", *known_by)
    each = variants_.select("h1", "h2", F.posexplode_outer("acts").alias("i", "x"))
    number = F.row_number().over(Window.orderBy("x")) + 0x2F
    point = F.when(number < 0xD800, number).otherwise(number + 0x800)
    letter = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    known = F.when(number < 0x2F + LETTERS, letter).otherwise(F.raise_error(F.lit(f"more than {LETTERS} activities")))
    letters = each.select("x").where("x is not null").distinct().select("x", known.alias("c"))
    placed = F.array_sort(F.collect_list(F.struct("i", F.coalesce("c", F.lit("!")).alias("c"))))
    coded = each.join(letters, "x", "left").groupBy("h1", "h2").agg(placed.alias("r"))
    return variants_.join(coded, ["h1", "h2"]).select("acts", F.when(F.size("acts") > 0, F.array_join(F.transform("r", lambda r: r["c"]), "")).otherwise(F.lit("")).alias("code"))


def average_edit_distance(kinds: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """Mean Levenshtein distance of two different traces, in activities; null below two traces.

    Distances are summed where they are worked out: pairs of variants are no rows of a shuffle.
    """
    keys = list(keys)
    coded = kinds.join(encode_variants(kinds), "acts").select(*keys, "code", "n")
    summed = block_pairs(coded, keys, "code").groupBy(*keys).agg(F.sum(F.col("a.n") * F.col("b.n") * F.levenshtein("a.code", "b.code")).alias("d"))
    total = kinds.groupBy(*keys).agg(F.sum("n").alias("t")).join(summed, keys, "left")
    return total.select(*keys, F.when(F.col("t") > 1, F.coalesce("d", F.lit(0)) / (F.col("t") * (F.col("t") - 1) / 2)).alias("average_edit_distance"))


def all_measures(members: DataFrame, keys: Sequence[str] = ("window_id",), wanted: Sequence[str] | None = None, population: DataFrame | None = None, basis: str = "auto", custom: Sequence[Custom] = ()) -> DataFrame:
    """A row for each window with one column for each measure asked for (all by default).

    ``members``: keys, pos, acts, len.  ``population`` (keys, species_kind, population_count)
    replaces the three counts that have a distribution version, unless ``basis`` is "trace";
    measures derived from them follow.  ``custom`` adds measures of one's own.
    """
    from .metrics import COLUMNS, NAMES
    from .sequence import lempel_ziv, prefix_entropy

    names = [COLUMNS[NAMES.index(w)] if w in NAMES else w for w in wanted] if wanted is not None else list(COLUMNS)
    need = set(names)
    keys = list(keys)
    kinds = variants(members, keys)
    out = basic(members, keys, kinds)
    if population is not None and basis in ("auto", "distribution"):
        out = with_population(out, population, keys)
    elif basis == "distribution":
        raise ValueError("basis 'distribution' needs a population")
    out = derived(out)
    parts: list[DataFrame] = []
    if "deviation_from_random" in need:
        parts.append(deviation_from_random(kinds, keys))
    if "average_affinity" in need:
        parts.append(average_affinity(kinds, keys))
    if "average_edit_distance" in need:
        parts.append(average_edit_distance(kinds, keys))
    if "lempel_ziv_complexity" in need:
        parts.append(lempel_ziv(members, keys))
    if need & {"sequence_entropy", "normalized_sequence_entropy", "variant_entropy", "normalized_variant_entropy", "number_of_partitions", "number_of_states"}:
        parts.append(prefix_entropy(kinds, keys))
    parts += [f(members, keys) for _, f in custom]
    for p in parts:
        out = out.join(p, keys, "left")
    return out.select(*keys, *names, *[n for n, _ in custom])


def with_population(measures: DataFrame, population: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The three counts and the share of distinct traces from estimated populations."""
    of = {"activity": "number_of_distinct_activities", "variant": "number_of_distinct_traces", "dfg_edge": "number_of_distinct_directly_follows_relations"}
    wide = population.groupBy(*keys).agg(*[F.max(F.when(F.col("species_kind") == k, F.col("population_count"))).alias(f"p_{k}") for k in of])
    out = measures.join(wide, list(keys), "left")
    for k, c in of.items():
        out = out.withColumn(c, F.coalesce(f"p_{k}", c))
    return out.drop(*[f"p_{k}" for k in of]).withColumn("percentage_of_distinct_traces", F.col("number_of_distinct_traces") / F.col("number_of_traces"))


def unpivot(measures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long rows: keys, metric (column name), value."""
    names = [c for c in measures.columns if c not in keys]
    pairs_ = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]))
    return measures.select(*keys, pairs_.alias("m")).select(*keys, "m.metric", "m.value")
