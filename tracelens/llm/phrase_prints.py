"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, phrases into longer phrases, until one is left.  On each
level runs of equal symbols become one symbol, deterministic coin tossing gives neighbours
different labels of a few bits that depend on a few symbols to the left only, labels are brought
down to three, and a phrase begins at every local maximum.  So equal substrings are parsed alike,
but for their edges, wherever they stand; the names of the phrases inside are the same hashes.

A fingerprint is a sketch of the set of names of all phrases of at least ``LEAST`` bytes, and of
the whole text: one-permutation minima in ``SLOTS`` slots of a byte each.  Likeness of two
fingerprints estimates the Jaccard similarity of the two sets.

Nulls, ties and repeats: a null text is empty, an empty text has the empty fingerprint (like
another empty one 1, like any other 0).  Documents are in descending order of id, rows without id
last, rows of one id by a hash of their text; every row gets a row.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import byte_view, chunks, discard, mix, stash, trim

#: Bytes of the shortest phrase that counts.
LEAST = 12
#: Slots of a fingerprint, a power of two.
SLOTS = 128
#: Bytes of text parsed together, and rows of one answer.
PARSE, ANSWER = 1 << 18, 10_000
#: Bytes of text in a range of documents, and the most ranges (their borders are in the driver).
RANGE_BYTES, RANGES = 1 << 24, 100_000

_U = np.uint64
#: Odd multipliers that tell run lengths, places and slots apart.
_RUN, _PLACE, _SHIFT = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
#: Number of trailing zero bits of a byte (0 for 0).
_ZEROS = np.array([(x & -x).bit_length() - 1 if x else 0 for x in range(256)], np.uint8)
#: The least of three colours that neither neighbour has; 7 is no neighbour.
_FREE = np.array([min({0, 1, 2} - {i >> 3, i & 7}) for i in range(64)], np.uint8)


# ---------------------------------------------------------------- parsing

def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: twice the lowest bit in which a label differs from the one before, and that bit.  A first symbol differs in bit 0."""
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[first] = labels[first] ^ labels.dtype.type(1)
    before ^= labels
    if labels.dtype == np.uint64:
        low = np.bitwise_count((before & (~before + _U(1))) - _U(1))
        return (low << 1) | ((labels >> low.astype(np.uint64)) & _U(1)).astype(np.uint8)
    low = _ZEROS[before]
    return (low << 1) | ((labels >> low) & 1)


def _colours(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three colours, neighbours different; ``first``: where texts begin."""
    labels = _toss(symbols, first)
    for _ in range(3 if symbols.dtype == np.uint64 else 2):  # 64 bits: 128, 14, 8, 6 labels; a byte: 16, 8, 6
        labels = _toss(labels, first)
    last = np.append(first[1:], len(labels)) - 1
    left, right = np.empty_like(labels), np.empty_like(labels)
    for c in (3, 4, 5):
        left[1:], right[:-1] = labels[:-1], labels[1:]
        left[first], right[last] = 7, 7
        at = np.flatnonzero(labels == c)
        labels[at] = _FREE[left[at] << 3 | right[at]]
    return labels


def _phrase_starts(colours: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Local maxima, never a text's second or last symbol; and where texts begin.  So phrases have two symbols or more."""
    n = len(colours)
    start = np.zeros(n, bool)
    start[1:-1] = (colours[1:-1] > colours[:-2]) & (colours[1:-1] > colours[2:])
    second = first + 1
    start[second[second < n]] = False
    start[first[1:] - 1] = False
    start[first] = True
    return np.flatnonzero(start)


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, sizes in bytes and texts of all phrases of all levels; the last one of a text is the whole text."""
    ends = offsets[1:]
    texts = np.flatnonzero(ends > offsets[:-1])
    first = offsets[:-1][texts]
    symbols, begins = data, np.arange(len(data), dtype=np.int64)
    names, sizes, owners = [], [], []
    while len(texts):
        # Runs of equal symbols are one symbol; those of one text only.
        new = np.empty(len(symbols), bool)
        new[0] = True
        np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
        new[first] = True
        at = np.flatnonzero(new)
        runs = np.diff(at, append=len(symbols))
        first = np.searchsorted(at, first)
        symbols, begins = symbols[at], begins[at]
        content = symbols.astype(np.uint64) + runs.astype(np.uint64) * _RUN
        starts = _phrase_starts(_colours(symbols, first), first)
        place = np.arange(len(symbols)) - np.repeat(starts, np.diff(starts, append=len(symbols)))
        symbols = mix(np.add.reduceat(mix(content + place.astype(np.uint64) * _PLACE), starts))
        begins, first = begins[starts], np.searchsorted(starts, first)
        owner = np.repeat(texts, np.diff(first, append=len(symbols)))
        upto = np.empty(len(begins), np.int64)
        upto[:-1] = begins[1:]
        upto[np.append(first[1:], len(symbols)) - 1] = ends[texts]
        names.append(symbols)
        sizes.append(upto - begins)
        owners.append(owner)
        # Texts of one phrase are done.
        count = np.diff(first, append=len(symbols))
        open_ = count > 1
        if not open_.all():
            keep = np.repeat(open_, count)
            symbols, begins = symbols[keep], begins[keep]
            texts, count = texts[open_], count[open_]
            first = np.cumsum(count) - count
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(names), np.concatenate(sizes), np.concatenate(owners)


def sketches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``SLOTS`` bytes for each text; those of empty texts are zeros and mean nothing."""
    n = len(offsets) - 1
    names, sizes, owners = phrases(data, offsets)
    keep = (sizes >= LEAST) | (sizes == np.diff(offsets)[owners])
    h, owners = mix(names[keep] + _SHIFT), owners[keep]
    bits = SLOTS.bit_length() - 1
    least = np.full(n * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owners * SLOTS + (h >> _U(64 - bits)).astype(np.int64), h << _U(bits) >> _U(bits))
    least = least.reshape(n, SLOTS)
    # An empty slot takes the next one's value, changed by the distance.
    slot = np.arange(2 * SLOTS)
    full = np.where(least != np.iinfo(np.uint64).max, slot[:SLOTS], 4 * SLOTS)
    ahead = np.concatenate([full, full + SLOTS], axis=1)
    ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1][:, :SLOTS]
    far = (ahead - slot[:SLOTS]).astype(np.uint64)
    value = np.take_along_axis(least, ahead % SLOTS, axis=1)
    return (mix(value + far * _SHIFT) & _U(255)).astype(np.uint8)


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots, less what chance gives; two empty fingerprints are alike."""
    if not a or not b:
        return float(a == b)
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / SLOTS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def fingerprints(texts: list[bytes]) -> list[bytes]:
    """Of whole texts, so many bytes of them at a time."""
    out: list[bytes] = []
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for i, j in chunks(offsets, PARSE):
        rows = sketches(np.frombuffer(b"".join(texts[i:j]), np.uint8), offsets[i:j + 1] - offsets[i])
        out += [r.tobytes() if n else b"" for r, n in zip(rows, sizes[i:j])]
    return out


# ---------------------------------------------------------------- edited texts

def _heads(text: bytes) -> np.ndarray:
    """Where the code points begin."""
    return np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)


def edit(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points, and the text with the last half of them replaced by the first as many of the following one (or all)."""
    own, other = _heads(text), _heads(following[:4 * len(text)])
    n = len(own)
    h = n // 2
    if not h:
        return n, text
    return n, text[:own[n - h]] + (following[:other[h]] if h < len(other) else following)


class _Rows:
    """Answers for documents that come in order; the last one waits for its successor."""

    def __init__(self) -> None:
        self.waiting: tuple | None = None  # id, text, fingerprint, copies, range

    def feed(self, ids: list, texts: list[bytes], copies: list[int], ranges: list[int], own: list[bool]) -> Iterator[tuple]:
        pairs = []
        for i, t, p, c, r, o in zip(ids, texts, fingerprints(texts), copies, ranges, own):
            if self.waiting and self.waiting[4] == r:
                pairs.append((self.waiting, t, p))
            self.waiting = (i, t, p, c, r) if o else None
            if o and c > 1:  # all copies but the last are followed by a copy
                pairs.append(((i, t, p, c - 1, r), t, p))
                self.waiting = (i, t, p, 1, r)
        edited = [edit(w[1], t) for w, t, _ in pairs]
        for (w, _, p), (n, text), q in zip(pairs, edited, fingerprints([t for _, t in edited])):
            row = (w[0], n, hashlib.sha256(text).hexdigest(), w[2].hex(), q.hex(), likeness(w[2], q), likeness(w[2], p))
            for _ in range(w[3]):
                yield row


_ANSWER = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _answers(names: list[str]):
    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done, kind = _Rows(), [], pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for i, j in chunks(byte_view(batch.column(1))[1], PARSE):
                part = batch.slice(i, j - i)
                ids, texts, *rest = (c.to_pylist() for c in part.columns)
                for row in state.feed(ids, [t.encode() for t in texts], *rest):
                    done.append(row)
                    if len(done) == ANSWER:
                        yield table(done, kind)
                        done = []
            trim()
        if done:
            yield table(done, kind)

    return run


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text.

    A sorted table of ids and text hashes, much smaller than the texts, is cut into ranges; texts
    are then shuffled once, by range, and the first of each range goes to the range before as
    well, so that each document meets its successor.  Rows of the same id and text that are more than
    a ten-thousandth of all are counted instead of sent.
    """
    spark = docs.sparkSession
    order = ["_r0", "_r1", "_r2"]
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("_id"), whole.alias("_text")).withColumns({
        "_r0": F.col("_id").isNull().cast("int"), "_r1": F.coalesce(F.bitwise_not(F.col("_id").cast("long")), F.lit(0).cast("long")), "_r2": F.xxhash64("_text"),
    })
    keys = stash(base.select(*order, F.octet_length("_text").alias("_size")))
    total, n = keys.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    kind = docs.schema[key].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"`{key}` {kind}, {_ANSWER}")
    copied = keys.groupBy(*order).agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > max(1000, n // 10_000))
    hot = copied.collect()  # fewer than 10,000, by the bound on copies
    ranges = int(min(RANGES, -(-total // RANGE_BYTES), n)) or 1
    ordered = stash(keys.select(*order).repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()))
    firsts = sorted(tuple(r["_first"]) for r in ordered.groupBy("_part").agg(F.min(F.struct(*order)).alias("_first")).select("_first").collect())
    discard(keys)
    discard(ordered)
    border = spark.sparkContext.broadcast(firsts)

    @F.pandas_udf("array<int>")
    def places(r0: pd.Series, r1: pd.Series, r2: pd.Series) -> pd.Series:
        """The row's range, and the one before if it is the first of its range (as -1 less that)."""
        known = border.value
        out = []
        for row in zip(r0, r1, r2):
            at = max(0, bisect_right(known, row) - 1)
            out.append([at, -1 - (at - 1) % len(known)] if known[at] == row else [at])
        return pd.Series(out)

    rows = base.withColumn("_copies", F.lit(1).cast("long"))
    if hot:
        many = F.broadcast(spark.createDataFrame(hot, copied.schema))
        rows = base.join(many.drop("_copies"), order, "left_anti").withColumn("_copies", F.lit(1).cast("long")).unionByName(
            base.join(many.drop("_copies"), order, "left_semi").groupBy("_id", "_text", *order).agg(F.count(F.lit(1)).alias("_copies")))
    rows = rows.withColumn("_at", F.explode(places(*order))).withColumns({"_own": F.col("_at") >= 0, "_range": F.when(F.col("_at") >= 0, F.col("_at")).otherwise(-1 - F.col("_at"))})
    sent = rows.select("_id", "_text", "_copies", "_range", "_own", *order).repartitionById(len(firsts), "_range")
    sent = sent.sortWithinPartitions("_range", F.desc("_own"), *order, "_text").drop(*order)
    return sent.mapInArrow(_answers([key, *(p.split()[0] for p in _ANSWER.split(", "))]), f"`{key}` {kind}, {_ANSWER}")
