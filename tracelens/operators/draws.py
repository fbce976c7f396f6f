"""Random counts as columns and tables: binomial and multinomial draws from md5.

A draw is a function of a seed and of what it is for, so it is the same under any partitioning and
any SQL engine can repeat it.  Expressions are written as SQL text, which Spark parses at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.scratch import materialize

#: Species that share a leaf of the tree, on average, at most.
LEAF = 4

#: ln of the gamma function of x >= 1: Stirling's series ten steps above.  Fixed values: its coefficients.
_LOG_GAMMA = (
    "(x + 9.5D) * ln(x + 10) - (x + 10) + 0.5D * ln(2 * pi()) + (1 / 12D - (1 / 360D - (1 / 1260D - (1 / 1680D - (1 / 1188D - 691 / 360360D / (x + 10) / (x + 10)) / (x + 10) / (x + 10)) / (x + 10) / (x + 10)) / (x + 10) / (x + 10)) / (x + 10) / (x + 10)) / (x + 10) - ln("
    + " * ".join(f"(x + {i}D)" for i in range(10)) + ")"
)


def uniform_text(seed: int, *parts: str) -> str:
    """A number inside (0, 1) from a seed and SQL expressions."""
    text = ", ".join(f"cast({p} as string)" for p in parts)
    return f"(cast(conv(substring(md5(concat_ws(':', '{seed}', {text})), 1, 8), 16, 10) as bigint) + 0.5D) / 4294967296"


def bind(names: str, values: Sequence[str], use: str) -> str:
    """SQL text ``use``, in which the names stand for values that are worked out once each."""
    for name, value in reversed(list(zip(names.split(), values))):
        use = f"transform(array({value}), {name} -> {use})[0]"
    return use


def binomial_text(n: str, p: str, u: str) -> str:
    """The least k whose cumulative probability reaches ``u``: successes of n trials.

    Sums run over eight standard deviations (and 20) around the mean, beyond which there is less
    than 2**-32: work grows with the square root of n p (1 - p), not with n.
    """
    logs = f"transform(array(_n + 1D, _lo + 1D, _n - _lo + 1D), x -> {_LOG_GAMMA})"
    first = f"if(_lo = 0, pow(1 - _p, _n), {bind('_g', [logs], 'exp(_g[0] - _g[1] - _g[2] + _lo * ln(_p) + (_n - _lo) * ln(1 - _p))')})"
    step = "named_struct('k', if(s.total + s.mass < _u, i + 1, s.k), 'mass', s.mass * (_n - i) / (i + 1) * (_p / (1 - _p)), 'total', s.total + s.mass)"
    search = f"aggregate(sequence(_lo, _hi), named_struct('k', _lo, 'mass', _m, 'total', 0D), (s, i) -> {step}, s -> least(s.k, _hi))"
    wide = "8 * sqrt(_n * _p * (1 - _p)) + 20"
    inside = bind("_w _lo _hi _m", [wide, "cast(greatest(0D, floor(_n * _p - _w)) as bigint)", "cast(least(_n, ceil(_n * _p + _w)) as bigint)", first], search)
    return bind("_n _p _u", [f"cast({n} as bigint)", f"cast({p} as double)", u], f"case when _n <= 0 or _p <= 0 then 0L when _p >= 1 then _n else {inside} end")


def binomial(n: str, p: str, u: str) -> Column:
    """As a column, of columns or expressions."""
    return F.expr(binomial_text(n, p, u))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """The series of ``_LOG_GAMMA``."""
    y = x + 10
    tail = 1 / 1188 - 691 / 360360 / y / y
    for c in (1680, 1260, 360):
        tail = 1 / c - tail / y / y
    return (x + 9.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - tail / y / y) / y - np.log(np.prod([x + i for i in range(10)], axis=0))


def binomials(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """``binomial_text`` of many draws at once: each sum ends where it reaches its ``u``."""
    out = np.where((n > 0) & (p >= 1), n, 0)
    at = np.flatnonzero((n > 0) & (p > 0) & (p < 1))
    n, p, u = n[at], p[at], u[at]
    wide = 8 * np.sqrt(n * p * (1 - p)) + 20
    i, high = np.maximum(0, np.floor(n * p - wide)).astype(np.int64), np.minimum(n, np.ceil(n * p + wide)).astype(np.int64)
    mass = (1 - p) ** n
    up = i > 0
    m, k, q = n[up].astype(float), i[up].astype(float), p[up]
    mass[up] = np.exp(_log_gamma(m + 1) - _log_gamma(k + 1) - _log_gamma(m - k + 1) + k * np.log(q) + (m - k) * np.log(1 - q))
    out[at], odds, total = i, p / (1 - p), np.zeros(len(at))
    while len(at):
        total = total + mass
        go = (total < u) & (i <= high)
        out[at[~go]] = np.minimum(i, high)[~go]
        at, n, u, i, high, mass, odds, total = (x[go] for x in (at, n, u, i, high, mass, odds, total))
        mass, i = mass * (n - i) / (i + 1) * odds, i + 1
    return out


def _uniforms(texts: Sequence[str]) -> np.ndarray:
    return np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in texts], dtype=float) / 4294967296 + 0.5 / 4294967296


def _kept(n: np.ndarray, p: np.ndarray, text: Callable[[int], str]) -> np.ndarray:
    """Binomial draws, whose md5 is worked out only where chance has a part."""
    u = np.zeros(len(n))
    at = np.flatnonzero((n > 0) & (p > 0) & (p < 1))
    u[at] = _uniforms([text(j) for j in at])
    return binomials(n, p, u)


@F.pandas_udf(ArrayType(LongType()))
def _split(text: pd.Series, n: pd.Series, bits: pd.Series, masses: pd.Series) -> pd.Series:
    """Counts of the 16 nodes four levels below, from their masses; ``text``: what a draw's md5 begins with."""
    levels = [np.stack(masses.to_numpy()).astype(float)]
    while levels[0].shape[1] > 2:
        levels.insert(0, levels[0][:, ::2] + levels[0][:, 1::2])
    counts, start, own = n.to_numpy(dtype=np.int64).reshape(-1, 1), text.tolist(), bits.tolist()
    for depth, mass in enumerate(levels):
        width, left = counts.shape[1], mass[:, ::2]
        both = left + mass[:, 1::2]
        share = np.divide(left, both, out=np.zeros_like(left), where=both != 0)
        names = [f"{i:0{depth}b}" if depth else "" for i in range(width)]
        k = _kept(counts.ravel(), share.ravel(), lambda j: f"{start[j // width]}:{own[j // width]}{names[j % width]}").reshape(-1, width)
        counts = np.stack([k, counts - k], axis=2).reshape(len(k), -1)
    return pd.Series(list(counts))


@F.pandas_udf(ArrayType(LongType()))
def _deal(text: pd.Series, n: pd.Series, bits: pd.Series, weights: pd.Series, mass: pd.Series) -> pd.Series:
    """Counts of a leaf's species: the next one takes its share of what is left, the last one all of it."""
    sizes = weights.map(len).to_numpy()
    w, out = np.zeros((len(sizes), sizes.max(initial=0))), np.zeros((len(sizes), sizes.max(initial=0)), dtype=np.int64)
    for j, x in enumerate(weights):
        w[j, : len(x)] = x
    ahead, rest, start, own = n.to_numpy(dtype=np.int64).copy(), mass.to_numpy(dtype=float).copy(), text.tolist(), bits.tolist()
    for i in range(w.shape[1]):
        share = np.divide(w[:, i], rest, out=np.ones(len(w)), where=rest > 0)
        share = np.where(i == sizes - 1, 1.0, np.where(i < sizes, share, 0.0))
        out[:, i] = _kept(ahead, share, lambda j: f"{start[j]}:{own[j]}+{i}")
        ahead, rest = ahead - out[:, i], rest - w[:, i]
    return pd.Series([out[j, :size] for j, size in enumerate(sizes)])


def multinomial(weights: DataFrame, totals: DataFrame, replicates: int, keys: Sequence[str], seed: int) -> DataFrame:
    """keys, replicate, species, n (not 0): ``n`` of ``totals`` (keys, n) dealt to species by weight ``w``, ``replicates`` times.

    The n individuals of a replicate fall down a binary tree over species, by the bits of their
    md5, with a binomial draw at each node; leaves hold a few species, dealt one after the other.
    A replicate costs what has individuals, never a row for each of them.  Four levels are one
    row's work and one join, with the masses of the 16 nodes below.
    """
    keys, parts = list(keys), [*keys, "replicate"]
    # Few bytes, much work: nodes are dealt to a fixed number of tasks, or Spark would put them into one, and meet
    # their masses by a shuffle, as it takes them for no more than the totals that they come from.
    tasks = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_out = lambda nodes, below: nodes.join(below.hint("shuffle_hash"), [*keys, "_p"]).repartition(tasks, *parts, "_p")
    start = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in parts])
    rows = materialize(weights.where("w > 0").select(*keys, "species", F.col("w").cast("double").alias("w"), F.md5("species").alias("_h")))
    most = rows.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    digits = 0
    while most > LEAF << 4 * digits:
        digits += 1
    at = totals.where("n > 0").selectExpr(*keys, "cast(n as bigint) as _n", "'' as _p", "'' as _bits", f"explode(sequence(0, {replicates - 1})) as replicate") if replicates > 0 else totals.limit(0).selectExpr(*keys, "cast(n as bigint) as _n", "'' as _p", "'' as _bits", "0 as replicate")
    for level in range(digits):
        digit = F.substring("_h", level + 1, 1)
        below = rows.groupBy(*keys, F.substring("_h", 1, level).alias("_p")).agg(*[F.sum(F.when(digit == f"{i:x}", F.col("w")).otherwise(F.lit(0.0))).alias(f"_w{i}") for i in range(16)])
        below = below.select(*keys, "_p", F.array(*[f"_w{i}" for i in range(16)]).alias("_m"))
        at = dealt_out(at, below).withColumn("_c", _split(start, "_n", "_bits", "_m"))
        at = at.selectExpr(*keys, "replicate", "_p", "_bits", "posexplode(_c) as (_i, _n)").where("_n > 0")
        at = at.selectExpr(*keys, "replicate", "_n", "concat(_p, lower(hex(_i))) as _p", "concat(_bits, lpad(bin(_i), 4, '0')) as _bits")
    leaves = rows.groupBy(*keys, F.substring("_h", 1, digits).alias("_p")).agg(F.array_sort(F.collect_list(F.struct("species", "w"))).alias("_s"), F.sum("w").alias("_m"))
    dealt = dealt_out(at, leaves).withColumn("_k", _deal(start, "_n", "_bits", F.transform("_s", lambda x: x["w"]), "_m"))
    dealt = dealt.select(*parts, F.inline(F.transform("_s", lambda x, i: F.struct(x["species"].alias("species"), F.get("_k", i).alias("n")))))
    return dealt.where("n > 0")
