"""N-gram Jaccard self-join of documents by MinHash banding.

A document's set holds the hashes of its five-word shingles.  Equal sets are one class
first, so copies cost nothing later.  The classes' MinHash signatures are cut into bands;
the number of bands and rows is chosen for a target recall at the threshold.  Band hashes
are shuffled, each band bucket is tied to its least member, and the components of these
ties are the candidate groups.  A group's full sets are sent once to the tasks that verify
it: a large group is cut into blocks, and every pair of blocks is a task of its own, so no
task holds more than two blocks.  A pair is a link when it shares a band and its exact
Jaccard similarity reaches the threshold.  Tasks return counts and a spanning forest of
the links, never all pairs.

Defined results: null texts are empty; a text of one to four words has one shingle, all of
its words; a text without words has the empty set, which equals other empty sets and is
linked to nothing else; rows with a null key link as others do but represent a class
only if all its rows have null keys; repeated rows are copies, and a key that stands at
several texts is a document for each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .textkit import SpanHash, mix, ragged, stash, text_chunks, trim, word_spans

WORDS = 5
#: Similarity of at least 4/5; kept as a fraction, so that comparisons are exact.
THRESHOLD = (4, 5)
#: Share of the pairs at the threshold that share a band.
RECALL = 0.9999
#: Members and shingles of a block that is verified against another one.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000

_U = np.uint64


def bands_and_rows(recall: float, similarity: float, most_rows: int = 8, most_hashes: int = 96) -> tuple[int, int]:
    """The most selective rows for which the bands that reach ``recall`` need at most ``most_hashes`` hashes."""
    best = (1, 1)
    for rows in range(1, most_rows + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of every text, one after the other, and their offsets."""
    starts, ends, first = word_spans(data, offsets)
    words = SpanHash(data).spans(starts, ends)
    n = len(offsets) - 1
    count = np.diff(first)
    many = np.maximum(count - width + 1, (count > 0).astype(np.int64))
    at = ragged(first[:-1], many)
    h = np.zeros(len(at), np.uint64)
    text = np.repeat(np.arange(n), many)
    left = first[1:][text]
    for k in range(width):
        here = at + k < left  # a short text's only shingle has fewer words
        step = np.where(here, words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else _U(0), _U(k + 1))
        h = mix(h * _U(0x9E3779B97F4A7C15) + step)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[keep], text[keep]
    return h, np.searchsorted(text, np.arange(n + 1))


def set_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every set."""
    total = np.zeros(len(h) + 1, np.uint64)
    other = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + _U(0x1234567)), out=total[1:])
    np.cumsum(mix(h ^ _U(0xABCDEF0123456789)), out=other[1:])
    n = np.diff(at).astype(np.uint64)
    return mix(total[at[1:]] - total[at[:-1]] + n), mix((other[at[1:]] - other[at[:-1]]) ^ n)


def band_hashes(h: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) hashes of the bands of 32-bit MinHash signatures; empty sets get 0."""
    n, full = len(at) - 1, np.flatnonzero(np.diff(at))
    out = np.zeros((n, bands), np.uint64)
    if not len(full):
        return out
    x, starts = (h >> _U(32)).astype(np.uint32), at[full]
    draw = np.random.default_rng(5).integers(1, 1 << 32, (bands * rows, 2), dtype=np.uint64).astype(np.uint32)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(full), b + 1, np.uint64)
            for r in range(rows):
                mult, add = draw[b * rows + r]
                key = mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * (mult | np.uint32(1)) + add, starts).astype(np.uint64))
            out[full, b] = key
    return out


def signatures(docs: DataFrame, bands: int, rows: int, width: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, s1, s2 (the set's hashes), n (its size), bands (array), th (hash of the text) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                h, at = shingle_sets(data, offsets, width)
                s1, s2 = set_keys(h, at)
                b = band_hashes(h, at, bands, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(np.diff(at)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, b.size + 1, bands), pa.int32()), pa.array(b.ravel())),
                    batch.column(2).slice(i, j - i),
                ], names=[key, "s1", "s2", "n", "bands", "th"])

    return docs.select(key, text, F.xxhash64(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, s1 long, s2 long, n long, bands array<long>, th long")


# ---------------------------------------------------------------- verification

def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the pairs (left[k], right[k])."""
    m = len(sets)
    if len(left) <= 8 * m:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)
    size = np.array([len(s) for s in sets])
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), size)
    often = np.bincount(column, minlength=len(value)) > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((m, m), np.float32)
    for c in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(column, [c, c + 4096])
        part = np.zeros((m, 4096), np.float32)
        part[row[lo:hi], column[lo:hi] - c] = 1
        total += part @ part.T
    return total[left, right].astype(np.int64)


def verify(ids: np.ndarray, block: np.ndarray, across: bool, weight: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked sets, linked documents and the least linked member (as a root) of every member of a pair of blocks.

    ``across``: the blocks are two, though one may have no member.
    """
    m = len(ids)
    near = np.zeros((m, m), bool)
    for b in bands.T:
        near |= b[:, None] == b[None, :]
    if across:
        near &= block[:, None] != block[None, :]  # pairs inside a block are another task's
    size = np.array([len(s) for s in sets], np.int64)
    p, q = threshold
    near &= (q * np.minimum(size[:, None], size[None, :]) >= p * np.maximum(size[:, None], size[None, :])) & (size[:, None] > 0)
    left, right = np.nonzero(np.triu(near, 1))
    both = _overlaps(sets, left, right)
    link = (p + q) * both >= p * (size[left] + size[right])
    left, right = left[link], right[link]
    sets_linked = np.bincount(left, minlength=m) + np.bincount(right, minlength=m)
    docs_linked = np.bincount(left, weight[right], m) + np.bincount(right, weight[left], m)
    root = np.arange(m)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    root = rank.copy()
    while len(left):  # least ranks spread along the links
        least = root.copy()
        np.minimum.at(least, left, root[right])
        np.minimum.at(least, right, root[left])
        least = least[order[least]]
        if (least == root).all():
            break
        root = least
    return sets_linked, docs_linked.astype(np.int64), ids[order[root]]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with equal leading columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and last != tuple(c[0] for c in cols)
        at = [0, *np.flatnonzero(change), batch.num_rows]
        if not change[0]:
            at = at[:1] + [x for x in at[1:] if x]
        for i, j in zip(at, at[1:]):
            if i == j:
                continue
            if change[i] and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def linked_sets(docs: DataFrame, members: DataFrame, width: int, threshold: tuple[int, int], text: str, key: str) -> DataFrame:
    """sid, sets_linked, docs_linked, root for every pair of blocks that a member of ``members`` is in.

    ``members``: sid (of the set), rep and th (key and text hash of a document that has it), copies,
    s1, s2, bands, comp (candidate group), blocks (of the group).
    """
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # rows that repeat a document meet in a task; its set is read and sent once
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = [i for i, r in enumerate(rows) if r not in seen and not seen.add(r)]
            if len(new) < len(rows):
                batch = batch.take(pa.array(new, pa.int64()))
            for i, j, data, offsets in text_chunks(batch.column(6)):
                h, at = shingle_sets(data, offsets, width)
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((8 * at).astype(np.int32)), pa.py_buffer(h)])
                s1, s2 = set_keys(h, at)
                same = (batch.column(3).slice(i, j - i).to_numpy() == s1.view(np.int64)) & (batch.column(4).slice(i, j - i).to_numpy() == s2.view(np.int64))
                out = pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1, 2, 5, 7)), raw], names=["comp", "sid", "copies", "bands", "blocks", "sets"])
                yield out.filter(pa.array(same))

    texts = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_th"), text)
    found = members.select("sid", "rep", "th", "copies", "s1", "s2", "bands", "comp", "blocks").join(texts, F.col("rep").eqNullSafe(F.col("_key")) & (F.col("th") == F.col("_th")))
    found = found.select("comp", "sid", "copies", "s1", "s2", "bands", text, "blocks")
    full = found.mapInArrow(shingle, "comp long, sid long, copies long, bands array<long>, blocks int, sets binary")
    own = F.pmod(F.xxhash64("sid", F.lit(3)), F.col("blocks")).cast("int")
    # Block pairs (i, j), i <= j; a group of one block has the pair (0, 0), others leave (i, i) to pairs of their own.
    full = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "copies", "bands", "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            sid = t.column("sid").to_numpy()
            _, once = np.unique(sid, return_index=True)
            t, sid = t.take(pa.array(once)), sid[once]
            bands = np.array(t.column("bands").combine_chunks().flatten().to_numpy()).reshape(len(sid), -1)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("sets").to_pylist()]
            across = t.column("i")[0] != t.column("j")[0]
            n, d, root = verify(sid, t.column("own").to_numpy(), across, t.column("copies").to_numpy(), bands, sets, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(n.astype(np.int64)), pa.array(d), pa.array(root)], names=["sid", "sets_linked", "docs_linked", "root"])
        trim()

    placed = full.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return placed.mapInArrow(check, "sid long, sets_linked long, docs_linked long, root long")


def jaccard_join(docs: DataFrame, width: int = WORDS, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, text: str = "text", key: str = "doc_id", text_hash: bool = False) -> DataFrame:
    """One row for each document: key, th (xxhash64 of its text, if ``text_hash``), class_id (least key of the documents it is tied to by links),
    set_id (least key with the same shingles), n_links (documents linked to it, copies too) and
    n_set_links (different sets linked to its own).
    """
    bands, rows = bands_and_rows(recall, threshold[0] / threshold[1])
    seen = stash(signatures(docs, bands, rows, width, text, key))
    one = F.struct(key, "th", "bands")
    best = F.coalesce(F.min(F.when(F.col(key).isNotNull(), one)), F.min(one))
    sets = seen.groupBy("s1", "s2").agg(best.alias("x"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    # A key may stand at several texts, so a set has a number of its own.
    sets = stash(sets.select("s1", "s2", F.col(f"x.{key}").alias("rep"), "x.th", "copies", "n", "x.bands", F.monotonically_increasing_id().alias("sid")))
    keyed = sets.where(F.col("n") > 0)
    banded = keyed.select("sid", F.posexplode("bands").alias("band", "hash"))
    hubs = banded.groupBy("band", "hash").agg(F.min("sid").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    ties = stash(banded.join(hubs, ["band", "hash"]).where("sid <> hub").select("sid", "hub").distinct())
    tied = stash(components(ties, "sid", "hub").select(F.col("node").alias("sid"), F.col("root").alias("comp")))
    members = keyed.join(tied, "sid")
    need = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    groups = members.groupBy("comp").agg(need.alias("blocks"))
    checked = stash(linked_sets(docs, members.join(groups, "comp"), width, threshold, text, key))
    linked = stash(components(checked.where("sid <> root"), "sid", "root").select(F.col("node").alias("sid"), "root"))
    least = linked.join(sets.select("sid", "rep"), "sid").groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = linked.join(least, "root").select("sid", "class_id")
    links = checked.groupBy("sid").agg(F.sum("sets_linked").alias("sets_linked"), F.sum("docs_linked").alias("docs_linked"))
    known = sets.select("s1", "s2", "sid", "rep", "copies").join(links, "sid", "left").join(classes, "sid", "left")
    known = stash(known.select("s1", "s2", F.col("rep").alias("set_id"), F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("docs_linked", F.lit(0))).alias("n_links"), F.coalesce("sets_linked", F.lit(0)).alias("n_set_links")))
    own = [key, "th"] if text_hash else [key]
    return seen.select(*own, "s1", "s2").join(known, ["s1", "s2"]).select(*own, "class_id", "set_id", "n_links", "n_set_links")
