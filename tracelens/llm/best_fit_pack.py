"""Best-fit packing of token sequences with Martello and Toth's dominance reduction.

Lengths are whole numbers up to the capacity, so an instance is a histogram of at most
``capacity`` counts, whatever the number of documents.  The plan (patterns of lengths
with how many sequences follow each) is made from the histogram alone:

1. reduction: a set of one to three items that provably dominates all sets with the same
   large item is fixed for as many sequences as there are copies, until nothing more can be fixed;
2. the remainder is packed best-fit, longest first, all copies of a length together.

Then Spark numbers the items of each length (hot lengths in salted groups) and every
item looks up its place in the plan.

Defined results: items longer than the capacity must be cut before (:func:`cut`);
length 0 is not allowed (a document has its end token at least); an empty table gives
an empty result; items of equal length are interchangeable, ties go by the order keys.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe_stream import encode_texts, vocabulary
from .textkit import stash, text_chunks

#: (length, copies) pairs and the number of sequences that have them.
Pattern = tuple[tuple[tuple[int, int], ...], int]
#: Items that one task numbers in one group, on average, and groups whose sizes one task adds up.
GROUP_ROWS, BLOCK_GROUPS = 1_000, 4_096


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences at its end, the rest first."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def dominating_set(left: np.ndarray, room: int) -> tuple[int, ...] | None:
    """Lengths from ``left`` (a histogram) that, beside a longest item, dominate all other sets that fit its ``room``.

    Nothing, if nothing fits.  The longest that fits, if it fills the room, if no two fit
    together, or if no three do and no pair is longer than it.  The longest with the longest
    partner, if no three fit, no pair is longer, and no two items between these two fit: then
    each item of any other set can be exchanged for one of theirs.  None if no set is known to.
    """
    have = np.flatnonzero(left[:room + 1])
    if not len(have):
        return ()
    longest = int(have[-1])
    least = np.repeat(have[:3], np.minimum(left[have[:3]], 3))[:3]
    if longest == room or len(least) < 2 or least[0] + least[1] > room:
        return (longest,)
    if len(least) == 3 and least.sum() <= room:
        return None
    # The longest partner of each length, another copy of it if there is one.
    at = np.searchsorted(have, room - have, "right") - 1
    at = np.where((at >= 0) & (have[at] == have) & (left[have] < 2), at - 1, at)
    pair = np.where(at >= 0, have + have[at], 0)
    best = int(pair.max())
    if longest >= best:
        return (longest,)
    if pair[-1] < best:
        return None
    partner = int(have[at[-1]])
    between = have[(have > partner) & (have < longest)][:2]
    two = np.repeat(between, np.minimum(left[between], 2))[:2]
    return (longest, partner) if len(two) < 2 or two.sum() > room else None


def reduce_by_dominance(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Fixes dominating sets and takes them out of ``count`` (index: length), longest items first.

    As items go, a set that dominates goes on dominating, so it is fixed as often as its
    items last; each step uses up a length, whatever the number of items.
    """
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for s in range(capacity, 0, -1):
            while count[s]:
                left = count.copy()
                left[s] -= 1
                beside = dominating_set(left, capacity - s)
                if beside is None:
                    break
                need = Counter((s, *beside))
                n = min(int(count[x]) // c for x, c in need.items())
                fixed.append((tuple(need.items()), n))
                for x, c in need.items():
                    count[x] -= n * c
                again = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Longest first, each into the open sequence with least room; copies of a length go together."""
    by_room: dict[int, list[list]] = defaultdict(list)  # [pattern, sequences]
    rooms = np.zeros(capacity + 1, np.int64)
    for s in range(capacity, 0, -1):
        n = int(count[s])
        while n:
            fits = np.flatnonzero(rooms[s:capacity])
            if len(fits):
                room = s + int(fits[0])
                pattern, have = by_room[room].pop()
                rooms[room] -= have
            else:
                room, pattern, have = capacity, (), 1 << 62
            k = min(room // s, n)
            used = min(have, n // k)
            if have - used and room < capacity:
                by_room[room].append([pattern, have - used])
                rooms[room] += have - used
            by_room[room - k * s].append([pattern + ((s, k),), used])
            rooms[room - k * s] += used
            n -= k * used
    return [(tuple(p), n) for x in by_room.values() for p, n in x if n]


def plan(count: np.ndarray, capacity: int) -> list[Pattern]:
    """The patterns for a histogram; every item has one place."""
    left = count.astype(np.int64).copy()
    fixed = reduce_by_dominance(left, capacity)
    return fixed + best_fit(left, capacity)


class Places:
    """Where the r-th item of a length stands: arrays over the plan, ordered by length and slot."""

    def __init__(self, patterns: list[Pattern], capacity: int):
        rows, base = defaultdict(list), 0
        for pattern, n in patterns:
            offset = 0
            for s, copies in pattern:
                rows[s].append((n * copies, base, copies, offset))
                offset += s * copies
            base += n
        self.sequences, self.first, flat, slot, before = base, np.zeros(capacity + 2, np.int64), [], [], 0
        for s in range(capacity + 1):
            self.first[s] = before
            for n, *x in rows.get(s, ()):
                slot.append(before)
                flat.append(x)
                before += n
        self.first[capacity + 1] = before
        self.slot = np.array(slot or [0], np.int64)
        self.base, self.copies, self.offset = np.array(flat or [[0, 1, 0]], np.int64).T

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[length] + rank
        row = np.searchsorted(self.slot, at, "right") - 1
        within = at - self.slot[row]
        return self.base[row] + within // self.copies[row], self.offset[row] + within % self.copies[row] * length


def with_salts(items: DataFrame, count: np.ndarray, length: str) -> DataFrame:
    """``_salt`` from ``_spread``: GROUP_ROWS items on average of a length and salt."""
    salts = np.maximum(1, -(-count // GROUP_ROWS))
    salt_of = F.element_at(F.lit([int(x) for x in salts]), F.col(length).cast("int") + 1)
    return items.withColumn("_salt", F.pmod("_spread", salt_of)).drop("_spread")


def pack(items: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``.

    Items are stored with a number of their row, from which salts are drawn, so that those of one id,
    or without any, spread like others.
    """
    columns = items.columns
    items = stash(items.withColumn("_spread", F.xxhash64(F.monotonically_increasing_id())))
    counts = items.groupBy(length).count().collect()  # one row a length, at most ``capacity`` of them
    count = np.zeros(capacity + 1, np.int64)
    for s, n in counts:
        if s is None or not 0 < s <= capacity:
            raise ValueError(f"length {s} is outside 1..{capacity}")
        count[s] = n
    places = Places(plan(count, capacity), capacity)
    salted = with_salts(items, count, length)
    groups = salted.groupBy(length, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    # Items before each group: within blocks of groups, and blocks before.
    groups = groups.withColumn("_block", F.floor(F.col("_salt") / BLOCK_GROUPS))
    above = lambda by, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = groups.groupBy(length, "_block").agg(F.sum("_n").alias("_n")).select(length, "_block", above([length], "_block").alias("_first"))
    groups = groups.withColumn("_within", above([length, "_block"], "_salt")).join(blocks, [length, "_block"])
    groups = groups.select(length, "_salt", (F.col("_first") + F.col("_within")).alias("_before"))
    own = Window.partitionBy(length, "_salt").orderBy(*order)
    ranked = salted.withColumn("_row", F.row_number().over(own)).join(groups, [length, "_salt"])
    ranked = ranked.select(*columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = places.of(s, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields if f.name != "_spread")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, path: str, capacity: int, end: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of every whole text's tokens with the end token: key, piece, start, length, ids_crc32, ids (binary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, last = vocabulary(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                ids, at = encode_texts(vocab, data, offsets)
                raw, rows = ids.astype("<u4"), []
                for k in range(j - i):
                    mine = raw[at[k]:at[k + 1]].tobytes() + last
                    for p, (s, n) in enumerate(cut(len(mine) // 4, capacity)):
                        rows.append((k, p, s, n, mine[4 * s:4 * (s + n)]))
                who, piece, start, size, part = zip(*rows)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i).take(pa.array(who)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                    pa.array([zlib.crc32(x) for x in part], pa.int64()), pa.array(part, pa.binary()),
                ], names=[key, "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, ids binary")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece with its place; ``with_ids`` keeps the token ids, from which sequences are laid out."""
    pieces = token_pieces(docs, path, capacity, end)
    return pack(pieces if with_ids else pieces.drop("ids"), capacity)
