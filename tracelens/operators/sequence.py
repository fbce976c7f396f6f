"""Measures that depend on the order of traces in a window: Lempel-Ziv and prefix-tree entropy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Phrases:
    """A dictionary parse of symbols as they come; what it holds is the tree of phrases found so far."""

    def __init__(self) -> None:
        self.count, self._root = 0, {}
        self._node = self._root

    def feed(self, symbols: Iterable) -> None:
        node, root, count = self._node, self._root, self.count
        for a in symbols:
            below = node.get(a)
            if below is None:
                node[a] = {}
                count, node = count + 1, root
            else:
                node = below
        self._node, self.count = node, count


def count_phrases(traces: list, pad: int) -> int:
    """Phrases of all traces, each padded to ``pad``; an open tail doesn't count."""
    parse = Phrases()
    for t in traces:
        parse.feed(chain(t, repeat(None, pad - len(t))))
    return parse.count


def lempel_ziv(members: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """Lempel-Ziv complexity: phrases of the traces in order, each padded to the window's longest.

    The parse of a window is sequential by definition.  Its traces come sorted and in batches, so that
    a task holds the tree of the phrases of one window at a time, not its traces.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    # A window function asks for its rows together and in order; the distribution of a join may be changed at run time.
    whole = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = members.select(*keys, "pos", "acts").withColumn("_pad", F.max(F.size("acts")).over(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parse, schema = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], schema.field(i).type) for i, k in enumerate(key)), pa.array([float(parse.count)])], names=[*keys, "lempel_ziv_complexity"])

        for batch in batches:
            schema = batch.schema
            columns = [c.to_pylist() for c in batch.columns]
            for *own, acts, pad in zip(*columns):
                if own != key:
                    if key is not None:
                        yield done()
                    key, parse = own, Phrases()
                parse.feed(chain(acts, repeat(None, pad - len(acts))))
        if key is not None:
            yield done()

    return ordered.select(*keys, "acts", "_pad").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", lempel_ziv_complexity double")


def prefix_entropy(kinds: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """Entropies over the prefix tree of a window's variants, with its states and partitions.

    A node continues its parent's partition if it is the parent's earliest child, else opens
    one; each child of the root opens one.  Entropy is N ln N less the sum of n ln n over
    partitions, with n the states (variant) or the events (sequence) of a partition; the
    normalized value divides by N ln N.
    """
    keys = list(keys)
    # A node is known by two running sums (without carry) of the hashes of (place, activity) down to it, so
    # that work grows with the variant's length; a variant by two hashes of all its activities.
    named = kinds.where(F.size("acts") > 0).select(*keys, "n", "first_pos", "acts", F.xxhash64("acts").alias("va"), F.xxhash64(F.lit(1), "acts").alias("vb"))
    named = named.select(*keys, "n", "first_pos", "va", "vb", F.posexplode("acts").alias("depth", "x"))
    along = Window.partitionBy(*keys, "va", "vb").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda *c: F.bit_xor(F.xxhash64(*c)).over(along)
    steps = named.withColumns({"na": total("depth", "x"), "nb": total("x", "depth")})
    before = Window.partitionBy(*keys, "va", "vb").orderBy("depth")
    steps = steps.withColumns({"pa": F.lag("na").over(before), "pb": F.lag("nb").over(before)}).select(*keys, "n", "first_pos", "va", "vb", "depth", "na", "nb", "pa", "pb")
    nodes = steps.groupBy(*keys, "na", "nb").agg(F.sum("n").alias("events"), F.min("first_pos").alias("seen"), F.min("depth").alias("level"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    # Siblings are as many as activities, so this window has small groups.
    order = Window.partitionBy(*keys, "pa", "pb").orderBy("seen")
    nodes = nodes.withColumn("head", (F.col("level") == 0) | (F.row_number().over(order) > 1))
    # A node's partition is the nearest head at or above it, the last one along any variant through it.
    placed = steps.select(*keys, "va", "vb", "depth", "na", "nb").join(nodes.select(*keys, "na", "nb", "events", "head"), [*keys, "na", "nb"])
    nearest = lambda c: F.last(F.when(F.col("head"), F.col(c)), ignorenulls=True).over(along)
    placed = placed.withColumns({"ha": nearest("na"), "hb": nearest("nb")})
    owner = placed.groupBy(*keys, "na", "nb").agg(F.min("ha").alias("ha"), F.min("hb").alias("hb"), F.max("events").alias("events"))
    parts = owner.groupBy(*keys, "ha", "hb").agg(F.count(F.lit(1)).cast("double").alias("s"), F.sum("events").cast("double").alias("m"))
    log = lambda c: F.col(c) * F.ln(c)
    total = parts.groupBy(*keys).agg(F.sum("s").alias("S"), F.sum("m").alias("M"), F.sum(log("s")).alias("ls"), F.sum(log("m")).alias("lm"), F.count(F.lit(1)).cast("double").alias("K"))
    whole_s, whole_m = log("S"), log("M")
    return total.select(
        *keys, (whole_m - F.col("lm")).alias("sequence_entropy"), F.when(whole_m > 0, (whole_m - F.col("lm")) / whole_m).otherwise(F.lit(0.0)).alias("normalized_sequence_entropy"),
        (whole_s - F.col("ls")).alias("variant_entropy"), F.when(whole_s > 0, (whole_s - F.col("ls")) / whole_s).otherwise(F.lit(0.0)).alias("normalized_variant_entropy"),
        F.col("K").alias("number_of_partitions"), F.col("S").alias("number_of_states"),
    )
