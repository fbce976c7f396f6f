"""Random samples of traces, as membership rows (sample_size, sample_id, pos, trace columns).

Draws come from md5 of a seed and counters, so a sample is the same under any partitioning
and can be checked in any SQL engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .windows import _count


def draw(*parts: Column | int | str) -> Column:
    """A whole number in [0, 2**32) from md5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _sizes(sizes: Sequence[int]) -> list[int]:
    return [int(s) for s in sizes if s > 0]


def _grid(spark: SparkSession, sizes: Sequence[int], samples: int) -> DataFrame:
    """sample_size, sample_no, sample_id: few rows."""
    size = F.explode(F.array(*[F.lit(s) for s in sizes])) if sizes else F.explode(F.array().cast("array<int>"))
    return spark.range(max(samples, 0)).select(F.col("id").alias("sample_no"), F.col("id").cast("string").alias("sample_id"), size.alias("sample_size"))


def _with_traces(places: DataFrame, rows: DataFrame) -> DataFrame:
    own = [c for c in rows.columns if c not in ("sample_size", "sample_id", "pos")]
    return places.join(rows.select(*own), "trace_index").select("sample_size", "sample_id", "pos", *own)


def sample_random(rows: DataFrame, sizes: Sequence[int], samples: int, policy: str = "within_and_across", seed: int = 123) -> DataFrame:
    """``samples`` samples of each size.

    within_and_across: with replacement everywhere.  within_only: no trace twice in a sample.
    none: no trace twice at all; one permutation of the log is cut, sample after sample.
    """
    if policy not in ("within_and_across", "within_only", "none"):
        raise ValueError(f"unknown policy {policy!r}")
    sizes, n, spark = _sizes(sizes), _count(rows), rows.sparkSession
    grid = _grid(spark, sizes if n else [], samples)
    if policy == "within_and_across":
        pos = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sample_size").cast("long") - 1))
        places = grid.withColumn("pos", pos).withColumn("trace_index", draw(seed, F.col("sample_no"), F.col("sample_size"), F.col("pos")) % F.lit(max(n, 1)))
        return _with_traces(places, rows)
    if n and samples > 0 and sizes and (max(sizes) > n if policy == "within_only" else samples * sum(sizes) > n):
        raise ValueError("not enough traces to sample without replacement")
    slots = grid.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sample_size").cast("long") - 1)))
    if policy == "within_only":
        return _with_traces(slots.withColumn("trace_index", permuted("pos", n, seed, "sample_no", "sample_size")), rows)
    before, starts = 0, []
    for s in sizes:
        starts.append((s, before))
        before += s
    first = F.coalesce(*[F.when(F.col("sample_size") == s, F.lit(b)) for s, b in starts]) if starts else F.lit(0)
    places = slots.withColumn("place", F.col("sample_no") * before + first + F.col("pos"))
    return _with_traces(places.withColumn("trace_index", permuted("place", n, seed)).drop("place"), rows)


#: Rounds of a permutation, and passes after which one that has not come back inside is an error (with n above 10,000 less likely than 1 in 10**128).
ROUNDS, PASSES = 6, 64


def permuted(x: str, n: int, seed: int, *keys: str) -> Column:
    """Where a permutation of [0, n) takes column ``x``; the columns ``keys`` choose the permutation.

    A number is a pair (x div b, x mod b) below (a, b), a b just above n.  Each round moves one part by a draw
    from the other, which can be undone, so all rounds are a permutation of [0, a b); passes repeat
    until the number is below n.  So one place of a sample is one expression, whatever n.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    key = ", ".join(f"cast({k} as string)" for k in keys)

    def one(start: str) -> str:
        """Parts l and r of the number in turn, as nested bindings."""
        text = f"_l{ROUNDS // 2} * {b} + _r{ROUNDS // 2}"
        for i in reversed(range(ROUNDS)):
            own, other, wide = ("l", f"_r{i // 2}", a) if i % 2 == 0 else ("r", f"_l{i // 2 + 1}", b)
            drawn = f"cast(conv(substring(md5(concat_ws(':', '{seed}'{', ' + key if key else ''}, '{i}', cast({other} as string))), 1, 8), 16, 10) as bigint)"
            text = f"transform(array((_{own}{i // 2} + {drawn}) % {wide}), _{own}{i // 2 + 1} -> {text})[0]"
        return f"transform(array({start}), _x -> transform(array(_x div {b}), _l0 -> transform(array(_x % {b}), _r0 -> {text})[0])[0])[0]"

    passed = f"aggregate(sequence(1, {PASSES}), {one(f'cast({x} as bigint)')}, (y, i) -> if(y < {n}, y, {one('y')}))"
    return F.expr(f"transform(array({passed}), z -> if(z < {n}, z, cast(raise_error('no place found in a permutation') as bigint)))[0]")


def sample_consecutive(rows: DataFrame, sizes: Sequence[int], samples: int, seed: int = 123) -> DataFrame:
    """Blocks of consecutive traces from random starts; blocks may overlap."""
    sizes, n = _sizes(sizes), _count(rows)
    if n and samples > 0 and sizes and max(sizes) > n:
        raise ValueError("a sample is larger than the log")
    grid = _grid(rows.sparkSession, sizes if n else [], samples)
    size = F.col("sample_size").cast("long")
    start = draw(seed, F.col("sample_no"), F.col("sample_size")) % (F.lit(n) - size + 1)
    places = grid.withColumn("start", start).withColumn("trace_index", F.explode(F.sequence(F.col("start"), F.col("start") + size - 1)))
    return _with_traces(places.withColumn("pos", F.col("trace_index") - F.col("start")), rows)
