"""Groups of spelling variants, by Bloom-guided neighbourhoods.

Words of all texts are counted.  A word's neighbourhood (one code point deleted or replaced; an
insertion is a deletion seen from the other word) is generated in place and each edit is looked up in
blocked Bloom filters of the vocabulary, one for each length.  Only edits that the filters know
are shuffled, to an exact join with the vocabulary that removes false positives.  Filters are
built by Spark, block by block, and broadcast in waves of at most ``WAVE_BYTES``, so that
nothing broadcast grows with the vocabulary; a larger one takes more waves.

Nulls, ties and repeats: a null text has no words, a null id is written as empty text, repeated rows
count again.  Of near words with equal counts the first in code-point order is the form.  Extra
columns are ignored; no documents give no words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import LOWER, byte_view, chunks, mix, ragged, stash, text_chunks, trim, word_spans

#: Code points and occurrences that a word needs.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many (document, word) pairs loses a code point.
SLIP = 97
#: Bits of filter for each word, bytes of the largest filter, and of all that are broadcast together.
BITS, SHARD_BYTES, WAVE_BYTES = 16, 1 << 23, 1 << 25
#: All longer words share the filters of this length.
LONG = 64
#: Distinct words that a task holds before it hands them on, and probes made together.
HELD, PROBES = 300_000, 1 << 18

_U = np.uint64
#: Letters, and the byte before which all code points from U+00C0 to U+00FF go in UTF-8.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


# ---------------------------------------------------------------- words

def _crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reversed polynomial)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc_after(prefix: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, carried on from the CRC of what stands before it."""
    out = np.empty(len(starts), np.uint32)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    long = int(np.count_nonzero(size > 64))
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(prefix[i]))
    order = order[long:]
    crc, at = ~prefix[order], starts[order]
    left = np.bincount(size[order], minlength=1)[::-1].cumsum()[::-1] if len(order) else np.zeros(1, np.int64)
    for k in range(1, len(left)):
        n = int(left[k])  # spans of at least k bytes
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + (k - 1)]) & 255] ^ (crc[:n] >> 8)
    out[order] = ~crc
    return out


def words_of(ids: list, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """All words of the texts that are long enough, after slips, as binary (UTF-8)."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    starts, ends, firsts = word_spans(np.where(inside, np.uint8(97), np.uint8(32)), offsets)
    low = LOWER[data]
    owner = np.repeat(np.arange(len(ids)), np.diff(firsts))
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = crc_after(prefix[owner], low, starts, ends)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    length = heads[ends] - heads[starts]
    slip = crc % np.uint32(SLIP) == 0
    keep = ~slip & (length >= LEAST_LENGTH)
    size = (ends - starts)[keep]
    body = low[ragged(starts[keep], size)]
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    whole = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(body)])
    cut = []
    for i in np.flatnonzero(slip & (length > LEAST_LENGTH)):
        w, k = low[starts[i]:ends[i]].tobytes().decode(), int(crc[i]) % int(length[i])
        cut.append((w[:k] + w[k + 1:]).encode())
    return pa.concat_arrays([whole, pa.array(cut, pa.binary())])


def _counted(parts: list[tuple[pa.Array, pa.Array]]) -> tuple[pa.Array, pa.Array]:
    t = pa.table([pa.concat_arrays([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts])], names=["word", "n"])
    t = t.group_by("word").aggregate([("n", "sum")])
    return t["word"].combine_chunks(), t["n_sum"].combine_chunks()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[pa.Array, pa.Array]] = []

    def out(words: pa.Array, n: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words.cast(pa.string()), n], names=["word", "n"])

    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(1)):
            found = pc.value_counts(words_of(batch.column(0).slice(i, j - i).to_pylist(), data, offsets))
            parts.append((found.field("values"), found.field("counts")))
            if sum(len(p[0]) for p in parts) > HELD:
                parts = [_counted(parts)]
                if len(parts[0][0]) > HELD // 2:
                    yield out(*parts[0])
                    parts = []
    if parts:
        yield out(*_counted(parts))


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, n of all words with enough code points and occurrences."""
    counted = docs.select(key, text).mapInArrow(_count_batches, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- filters

#: A number for each code point (all are below 256), and the base of the words' polynomial hash with its inverse.
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = _U(pow(_BASE, -1, 1 << 64))
#: Odd factors that pick a bit in each of a block's eight words.
_PICK = (mix(np.arange(101, 109, dtype=np.uint64)) >> _U(32)).astype(np.uint32) | np.uint32(1)


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * _BASE & (1 << 64) - 1
    return out


def _finish(raw: np.ndarray, length: int) -> np.ndarray:
    return mix(raw + _U(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix): the words of one length as rows of Latin-1 code points, not too many at once."""
    texts = [w.encode("latin-1") for w in words.to_pylist()]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        step = max(1, PROBES // (int(n) * 64))
        for i in range(0, len(rows), step):
            some = rows[i:i + step]
            yield some, np.frombuffer(b"".join(texts[k] for k in some), np.uint8).reshape(-1, n)


class Filters:
    """Where a hash belongs: its filter (by length, and by part where a length has many words), its block and bits."""

    def __init__(self, counts: dict[int, int]):
        """``counts``: words of each length class."""
        most = SHARD_BYTES * 8 // BITS
        self.parts = {n: -(-c // most) for n, c in counts.items()}
        self.blocks = {n: max(1, -(-c * BITS // (256 * self.parts[n]))) for n, c in counts.items()}
        self.shards = [(n, p) for n in sorted(counts) for p in range(self.parts[n])]

    def waves(self) -> list[list[tuple[int, int]]]:
        out, size = [], WAVE_BYTES + 1
        for s in self.shards:
            own = 32 * self.blocks[s[0]]
            if size + own > WAVE_BYTES:
                out.append([])
                size = 0
            out[-1].append(s)
            size += own
        return out

    def place(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Part and block of hashes of words of length class n."""
        block = ((h >> _U(32)) * _U(self.blocks[n])) >> _U(32)
        return ((h >> _U(8)) % _U(self.parts[n])).astype(np.int32), block.astype(np.int32)


def _bit(h: np.ndarray, k: int) -> np.ndarray:
    return np.uint32(1) << ((h.astype(np.uint32) * _PICK[k]) >> np.uint32(27))


def build(spark: SparkSession, words: DataFrame, filters: Filters, wave: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The filters of a wave: blocks of 8 x 32 bits, joined by Spark, at most ``WAVE_BYTES`` in all."""
    wanted = set(wave)
    names = ["length", "part", "block", *(f"w{k}" for k in range(8))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, m in by_length(batch.column(0)):
                n = min(m.shape[1], LONG)
                h = _finish(_CODE[m] @ _powers(m.shape[1]), m.shape[1])
                part, block = filters.place(h, n)
                ok = np.isin(part, [p for x, p in wanted if x == n])
                h, part, block = h[ok], part[ok], block[ok]
                if len(h):
                    bits = [pa.array(_bit(h, k).view(np.int32)) for k in range(8)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(part), pa.array(block), *bits], names=names)

    rows = words.select("word").where(F.least(F.char_length("word"), F.lit(LONG)).isin([x for x, _ in wave])).mapInArrow(run, ", ".join(f"{c} int" for c in names))
    joined = rows.groupBy("length", "part", "block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)]).toArrow()
    out = {s: np.zeros((filters.blocks[s[0]], 8), np.uint32) for s in wave}
    length, part, block = (joined[c].to_numpy() for c in names[:3])
    bits = np.stack([joined[f"w{k}"].to_numpy() for k in range(8)], axis=1).view(np.uint32) if len(block) else np.zeros((0, 8), np.uint32)
    for s in wave:
        own = (length == s[0]) & (part == s[1])
        out[s][block[own]] = bits[own]
    return out


def known(found: dict[tuple[int, int], np.ndarray], filters: Filters, h: np.ndarray, n: int) -> np.ndarray:
    """Which hashes of words of length class n the filters of this wave may hold."""
    none = np.zeros(0, np.int64)
    if n not in filters.blocks:
        return none
    part, block = filters.place(h, n)
    out = [none]
    for p in range(filters.parts[n]):
        bits = found.get((n, p))
        if bits is None:
            continue
        left = np.flatnonzero(part == p) if filters.parts[n] > 1 else np.arange(len(h))
        for k in range(8):
            left = left[(bits[block[left], k] & _bit(h[left], k)) != 0]
        out.append(left)
    return np.concatenate(out)


def edits(m: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, rows, letters put there or none, hashes) of the edits of words of one length.

    Deletions: the first of equal neighbours only, so that each result comes once.  Replacements: by
    later letters only, as the other half are the same pairs seen from the other word.
    """
    n = m.shape[1]
    power = _powers(n)
    terms = _CODE[m] * power
    before = np.concatenate([np.zeros((len(m), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1]
    for i in range(n):
        if n > LEAST_LENGTH:
            own = np.flatnonzero(m[:, i] != m[:, i - 1]) if i else np.arange(len(m))
            yield i, own, np.zeros(0, np.uint8), _finish(before[own, i] + (whole[own] - before[own, i + 1]) * _INVERSE, n - 1)
        own, letter = np.nonzero(letters[None, :] > m[:, i, None])
        put = letters[letter]
        yield i, own, put, _finish(whole[own] + (_CODE[put] - _CODE[m[own, i]]) * power[i], n)


def _candidates(filters: Filters, shared, letters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            count = batch.column(1).to_numpy(zero_copy_only=False)
            for rows, m in by_length(batch.column(0)):
                n = m.shape[1]
                for i, own, put, h in edits(m, letters):
                    hit = known(found, filters, h, min(n if len(put) else n - 1, LONG))
                    if not len(hit):
                        continue
                    new = m[own[hit]]
                    if len(put):
                        new = new.copy()
                        new[:, i] = put[hit]
                    else:
                        new = np.delete(new, i, axis=1)
                    at = rows[own[hit]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(count[at]), pa.array([x.tobytes().decode("latin-1") for x in new])], names=["word", "n", "other"])
        trim()

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, m: each pair of near words once, with their counts.  ``words`` is read once a wave, and joined."""
    spark = words.sparkSession
    length = F.least(F.char_length("word"), F.lit(LONG))
    counts = {r[0]: r[1] for r in words.groupBy(length.alias("length")).agg(F.count(F.lit(1))).collect()}
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()
    letters = np.array(sorted(ord(r[0]) for r in letters), np.uint8)  # at most 90
    filters, pairs = Filters(counts), None
    tasks = max(spark.sparkContext.defaultParallelism, sum(counts.values()) // 50_000)
    exact = words.select(F.col("word").alias("other"), F.col("n").alias("m"))
    for wave in filters.waves():
        shared = spark.sparkContext.broadcast(build(spark, words, filters, wave))
        lengths = sorted({x for n, _ in wave for x in (n, n + 1, LONG if n == LONG else n)})
        some = words.where(length.isin(lengths)).repartition(tasks, "word").mapInArrow(_candidates(filters, shared, letters), "word string, n long, other string")
        part = stash(some.join(exact, "other").select("word", "n", "other", "m"))
        shared.destroy()
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs if pairs is not None else spark.createDataFrame([], "word string, n long, other string, m long")


# ---------------------------------------------------------------- groups

def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last.  Each round doubles the steps; a form has twice the count, so chains are short."""
    at = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("top"))
        nxt = stash(at.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.select("word", "root")
        at = nxt.select("word", "root")


def spelling_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = stash(vocabulary(docs, text, key))
    pairs = near_pairs(words)
    sides = F.explode(F.array(F.struct("word", "other", "m"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("m"))))
    best = pairs.select(sides.alias("x")).select("x.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("b"))
    known_ = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("b.m") >= 2 * F.col("n"), F.struct(F.col("b.other").alias("form"), (-F.col("b.m")).alias("form_n"))).alias("f"))
    known_ = stash(known_.select("word", "n", "n_near", "f.form", "f.form_n"))
    top = roots(known_.where("form is not null"))
    return known_.join(top, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
