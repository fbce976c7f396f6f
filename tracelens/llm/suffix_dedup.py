"""Removal of repeated passages by a distributed suffix sort.

A byte is removed when it lies in a ``width``-byte string that also starts elsewhere.  Of
a suffix only its first ``width`` bytes matter, so that is a question about equal prefixes
of suffixes.  All suffixes of a corpus would be ``width`` times its size; what can't repeat
is set aside first, without loss:

1. Every suffix has an anchor: of the ``GRAM``-byte strings in its first ``width`` bytes
   the one with the least hash, the leftmost of equals.  Suffixes with equal prefixes have
   equal anchors at equal distances.  Neighbouring suffixes share their anchor, so a text
   falls into runs of suffixes; a run is a row with the hash of its anchor (its leading
   token) and the hash of its bytes.
2. Runs whose leading token occurs once hold unique suffixes only.  Runs with equal bytes
   are repeated throughout.  What remains are the edges of repeated passages.
3. The edges' bytes are range-partitioned by leading token, between splitters that Spark
   samples; a border never parts suffixes of one leading token, so neighbours across it
   differ.  A bucket sorts its suffixes by multikey quicksort, token after token of
   ``TOKEN`` bytes, and leaves those out that have become unique; what is left at the end
   is equal byte by byte.  Leading tokens with more than ``HOT`` different runs go to several
   buckets: their suffixes become rows, and equal ones meet across buckets in a partial
   aggregate, by two 62-bit hashes of their bytes.

A row is known by two 64-bit hashes of its id and text.

Defined results: null texts are empty; texts shorter than ``width`` keep everything;
strings overlap freely; repeated rows are documents of their own, so they remove each
other; null ids are ids like others; matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import SpanHash, byte_view, chunks, discard, ragged, release, stash, text_chunks, trim

WIDTH, GRAM = 200, 32
#: Different runs of one leading token that one bucket sorts: 20,000 runs are 6 MB of text, and about
#: 150 MB while they are sorted.  More go to several buckets.
HOT = 20_000
#: Bytes of a token in the local sort.
TOKEN = 8
_POSITION_BITS = 24
_PIECE = 1 << 23


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks to either side."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of suffixes with one anchor: text number, first and last start in the text, leading token, hash of the bytes."""
    if len(data) > 2 * _PIECE and len(offsets) == 2:  # one very long text, piece by piece
        parts = [(s, runs(data[s:s + _PIECE + width - 1], np.array([0, min(_PIECE + width - 1, len(data) - s)]), width, gram)) for s in range(0, len(data) - width + 1, _PIECE)]
        return {k: np.concatenate([p[k] + (s if k in ("first", "last") else 0) for s, p in parts]) for k in parts[0][1]}
    none = {k: np.zeros(0, np.int64) for k in ("text", "first", "last", "token", "body")}
    if len(data) < width:
        return none
    hashes = SpanHash(data)
    grams = hashes.windows(gram)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(ranked, width - gram + 1) & low).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int8)  # suffixes that have ``width`` bytes in their text
    size = np.diff(offsets)
    full = size >= width
    np.add.at(inside, offsets[:-1][full], 1)
    np.add.at(inside, offsets[1:][full] - width + 1, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    # Texts that follow each other without a gap can't: the last width-1 starts of a text are outside.
    end = inside.copy()
    end[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    if not len(first):
        return none
    text = np.searchsorted(offsets, first, "right") - 1
    body = hashes.spans(first, last + width)
    return {"text": text, "first": first - offsets[text], "last": last - offsets[text], "token": grams[anchor[first]].view(np.int64), "body": body.view(np.int64)}


def suffix_runs(docs: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """r1, r2 (of the row), first, last, token, body: a row for each run of suffixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(2), 1 << 20):
                r = runs(data, offsets, width)
                rows = pa.array(r["text"] + i)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(r["first"], pa.int32()), pa.array(r["last"], pa.int32()), pa.array(r["token"]), pa.array(r["body"]),
                ], names=["r1", "r2", "first", "last", "token", "body"])

    return docs.select(*row_hashes(text, key), text).mapInArrow(run, "r1 long, r2 long, first int, last int, token long, body long")


def row_hashes(text: str, key: str) -> list[Column]:
    """r1 and r2, by which a row is known; equal rows are alike."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.lit(salt), F.col(key).isNull(), F.col(key), whole).alias(name) for salt, name in ((1, "r1"), (2, "r2"))]


# ---------------------------------------------------------------- the local sort

def multikey_equal(token: Callable[[int, np.ndarray], np.ndarray], levels: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of suffixes: numbers of those whose tokens all equal a neighbour's, and their final group.

    ``token(k, some)`` gives the k-th tokens of some suffixes; ``group`` is a first key.  A level
    sorts what is left by one more token, within the groups that the levels before made,
    and drops what stands alone.
    """
    order = np.arange(len(group))
    for k in range(levels):
        if not len(order):
            break
        t = token(k, order)
        by = np.lexsort((t, group))
        order, group, t = order[by], group[by], t[by]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (t[1:] != t[:-1])
        alone = new.copy()
        alone[:-1] &= new[1:]
        group = np.cumsum(new)[~alone]
        order = order[~alone]
    return order, group


def repeated_suffixes(data: np.ndarray, at: np.ndarray, count: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Flags of the suffixes (``count`` of each run of bytes, from ``at``) that equal another one of their group."""
    start = ragged(at, count)
    flags = np.zeros(len(start), bool)
    if not len(start):
        return flags
    size = min(TOKEN, width)
    words = np.zeros(len(data) - size + 1, np.uint64)  # the bytes from every place on, as a number
    for k in range(size):
        words <<= np.uint64(8)
        words |= data[k:k + len(words)]
    places = [min(k, width - size) for k in range(0, width, size)]  # together they cover all bytes
    order, _ = multikey_equal(lambda k, some: words[start[some] + places[k]], len(places), np.repeat(group, count))
    flags[order] = True
    return flags


def _spans_of(flags: np.ndarray, count: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, starts and ends of the bytes that flagged suffixes cover."""
    row = np.repeat(np.arange(len(count)), count)
    start = ragged(first.astype(np.int64), count)
    open_ = flags.copy()
    open_[1:] &= ~(flags[:-1] & (row[1:] == row[:-1]))
    close = flags.copy()
    close[:-1] &= ~(flags[1:] & (row[1:] == row[:-1]))
    return row[open_], start[open_], start[close] + width


def edge_spans(edges: DataFrame, width: int) -> DataFrame:
    """r1, r2, start, end: covered bytes of the runs in ``edges`` (token, n, first, bytes) that occur once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(rows: pa.Table) -> pa.RecordBatch:
            data, at = byte_view(rows.column("bytes"))
            count = np.diff(at) - (width - 1)
            flags = repeated_suffixes(data, at[:-1], count, rows.column("token").to_numpy(), width)
            once = rows.column("n").to_numpy() == 1
            flags &= np.repeat(once, count)
            row, start, end = _spans_of(flags, count, rows.column("first").to_numpy(), width)
            where = pa.array(row)
            return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks().take(where) for c in ("r1", "r2")), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["r1", "r2", "start", "end"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(batch.schema.get_field_index("bytes")).nbytes
            if size > 1 << 20:
                rows = pa.Table.from_batches(held)
                token = rows.column("token").to_numpy()
                cut = int(np.searchsorted(token, token[-1]))  # the last token may go on
                if cut:
                    yield flush(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    size = sum(b.column(b.schema.get_field_index("bytes")).nbytes for b in held)
        if held:
            yield flush(pa.Table.from_batches(held))
        trim()

    parted = edges.repartitionByRange("token").sortWithinPartitions("token")
    return parted.mapInArrow(run, "r1 long, r2 long, start int, end int")


def hot_spans(edges: DataFrame, width: int) -> DataFrame:
    """The same for leading tokens with many different runs: equal suffixes meet by two hashes of their bytes."""
    names = ["r1", "r2", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in text_chunks(batch.column(batch.schema.get_field_index("bytes")), 1 << 19):
                part = batch.slice(i, j - i)
                count = np.diff(at) - (width - 1)
                start = ragged(at[:-1], count)
                rows = pa.array(np.repeat(np.arange(j - i), count))
                first = ragged(part.column(part.schema.get_field_index("first")).to_numpy(zero_copy_only=False).astype(np.int64), count)
                h1, h2 = (SpanHash(data, seed).spans(start, start + width).view(np.int64) for seed in (1, 2))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)).take(rows) for c in names), pa.array(first, pa.int32()), pa.array(h1), pa.array(h2)], names=[*names, "start", "h1", "h2"])

    rows = stash(edges.mapInArrow(run, "r1 long, r2 long, n long, start int, h1 long, h2 long"))
    often = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2")
    return rows.where("n = 1").join(often, ["h1", "h2"]).select("r1", "r2", "start", (F.col("start") + width).cast("int").alias("end"))


def run_bytes(docs: DataFrame, wanted: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """r1, r2, token, n, hot, first and the bytes of the runs in ``wanted``."""
    lists = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("first", "last", "token", "n", "hot")).alias("runs"))
    both = docs.select(*row_hashes(text, key), F.col(text).alias("_text")).join(lists, ["r1", "r2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # copies of a row meet in a task, and are cut once
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = [i for i, r in enumerate(rows) if r not in seen and not seen.add(r)]
            if len(new) < len(rows):
                batch = batch.take(pa.array(new, pa.int64()))
            data, offsets = byte_view(batch.column(2))
            lists = batch.column(3)
            flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), size)
            first, last = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            length = last - first + width
            for i, j in chunks(np.concatenate([[0], np.cumsum(length)]), 1 << 23):  # so many bytes of runs at a time
                mine, part = pa.array(row[i:j]), flat.slice(i, j - i)
                body = data[ragged(offsets[row[i:j]] + first[i:j], length[i:j])]
                ends = np.concatenate([[0], np.cumsum(length[i:j])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(mine), batch.column(1).take(mine), part.field(2), part.field(3), part.field(4), part.field(0),
                    pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))]),
                ], names=["r1", "r2", "token", "n", "hot", "first", "bytes"])
            trim()

    return both.select("r1", "r2", "_text", "runs").mapInArrow(cut, "r1 long, r2 long, token long, n long, hot boolean, first int, bytes binary")


# ---------------------------------------------------------------- the whole job

def repeated_spans(docs: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """r1, r2 (of :func:`row_hashes`), start, end: byte spans that repeated strings cover (spans of a text may overlap)."""
    spark = docs.sparkSession
    found = stash(suffix_runs(docs, width, text, key))
    often = stash(found.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token"))
    release(spark)
    kept = stash(found.join(often, "token"))
    discard(found)
    release(spark)
    whole = F.struct("first", "last", "r1", "r2")
    distinct = stash(kept.groupBy("token", "body").agg(F.count(F.lit(1)).alias("n"), F.min(whole).alias("x")).select("token", "body", "n", "x.*"))
    again = distinct.where("n > 1").select("token", "body")
    full = kept.join(again, ["token", "body"]).select("r1", "r2", F.col("first").alias("start"), (F.col("last") + width).cast("int").alias("end"))
    sizes = distinct.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1")
    edges = distinct.join(sizes, "token").select("r1", "r2", "first", "last", "token", "n", (F.col("c") > HOT).alias("hot"))
    edges = stash(run_bytes(docs, edges, width, text, key))
    release(spark)
    spans = full.unionByName(edge_spans(edges.where("not hot"), width)).unionByName(hot_spans(edges.where("hot"), width))
    spans = stash(spans)
    for x in (kept, edges):
        discard(x)
    release(spark)
    return spans


def remove_repeats(docs: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with ``removed`` (array of start, end byte spans, maximal) and ``kept`` (the remaining bytes)."""
    spans = repeated_spans(docs, width, text, key)
    lists = spans.groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))  # copies of a row have the same spans
    both = docs.select(F.struct(*docs.columns).alias("_row"), *row_hashes(text, key)).join(lists, ["r1", "r2"], "left")
    both = both.select("_row", F.coalesce(F.col(f"_row.{text}"), F.lit("")).cast("binary").alias("_text"), F.coalesce("_spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(byte_view(batch.column(1))[1], 1 << 24):
                part = batch.slice(i, j - i)
                spans, kept = [], []
                for body, found in zip(part.column(1).to_pylist(), part.column(2)):
                    if not len(found.values):
                        spans.append([])
                        kept.append(body)
                        continue
                    start, end = (found.values.field(k).to_numpy() for k in (0, 1))
                    spans.append(merged(start, end))
                    at, left = 0, []
                    for s in spans[-1]:
                        left.append(body[at:s["start"]])
                        at = s["end"]
                    kept.append(b"".join(left) + body[at:])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["_row", "removed", "kept"])

    schema = f"_row {both.schema['_row'].dataType.simpleString()}, removed array<struct<start:int,end:int>>, kept binary"
    return both.mapInArrow(run, schema).select("_row.*", "removed", "kept")


def kept_text(done: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of :func:`remove_repeats`, with ``text`` cut: a character is kept if all its bytes are."""
    others = [c for c in done.columns if c not in (text, "removed", "kept")]
    kinds = {f.name: f.dataType.simpleString() for f in done.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(byte_view(batch.column(0))[1], 1 << 24):
                part = batch.slice(i, j - i)
                texts = []
                for whole, spans in zip(part.column(0).to_pylist(), part.column(1)):
                    if whole is None or not len(spans.values):
                        texts.append(whole)
                        continue
                    body, at, left = whole.encode(), 0, []
                    for s in spans.values.to_pylist():
                        left.append(body[at:s["start"]].decode("utf-8", "ignore"))
                        at = s["end"]
                    texts.append("".join(left) + body[at:].decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([*(part.column(k + 2) for k in range(len(others))), pa.array(texts, pa.string())], names=[*others, text])

    return done.select(text, "removed", *others).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"`{text}` string"]))


def merged(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """Maximal runs of the spans' union; spans that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return [{"start": int(a), "end": int(b)} for a, b in zip(start[new], end[last])]
