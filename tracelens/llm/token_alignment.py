"""Alignment of two tokenizers over a corpus, every distinct text once.

Documents are shuffled by their full text; each distinct text is tokenised by both tokenizers and
aligned once, counts of linked token pairs are weighted by the text's copies, and the measures
are joined back to the ids.

A is a byte-level BPE in a file of the ``tokenizers`` library, encoded as in :mod:`bpe_stream`; B is a BPE of ``sentencepiece``.  Both see a
space and the text.  Byte offsets where tokens of both end cut them into groups; two tokens of a group
are linked.  Neither tokenizer joins what stands on both sides of a space after a character that isn't
white (:class:`Pair` looks that up in the vocabularies), so texts are cut there into units, and
units that a task has met before are not tokenised again.

Counts of pairs: the commonest ``COMMON`` are broadcast, whatever the corpus; rarer ones, none of which
can be hot, meet their links by a shuffle.

Nulls, ties and repeats: null and empty texts, and those that either tokenizer doesn't keep byte by byte,
have zeros and an empty digest; ids that tie for the highest count of their A id all are best; every
row gets a row, whatever its id.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_stream import Vocabulary, encode_chunk
from .textkit import chunks, discard, ragged, stash, text_chunks, trim

#: Pairs whose counts are broadcast (about 17 bytes each).
COMMON = 2_000_000
#: Units and links of units that a task remembers.
KNOWN_UNITS, KNOWN_LINKS = 150_000, 3_000_000
#: Bytes of text handled together.
CHUNK = 1 << 20
#: Links scored together.
LINKS = 1 << 19
#: From this many links on, the tokens of a group are counted before they are linked.
LARGE = 64

#: How B writes a space.
_SPACE = "▁"

_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


# ---------------------------------------------------------------- tokenizers

class Pair:
    """Both tokenizers, the bytes of their tokens, and whether texts can be cut before spaces."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Vocabulary(path_a)
        self.a.special = {}  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        text_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = self.a.size, len(text_b)
        self.bytes = [_Table(self.a.bytes), _Table(text_b)]
        # Decimals of ids, by side and by what follows: another id of the side, or the other side or group.
        self.marks = _Table([b"%d%c" % (i, c) for n, ends in ((self.size_a, b",|"), (self.size_b, b",;")) for c in ends for i in range(n)])
        self.cuts = not any(p[k] == _SPACE != p[k - 1] for p in pieces for k in range(1, len(p)))

    def encode(self, units: list[bytes], data: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, number in each unit) of A and of B; every unit begins with the space that B adds itself."""
        a, at = encode_chunk(self.a, data, np.concatenate([[0], np.cumsum(sizes)]))
        b = self.b.encode([u[1:].decode() for u in units], num_threads=1)
        n = np.fromiter(map(len, b), np.int64, len(b))
        return [(a.astype(np.int64), np.diff(at)), (np.fromiter(chain.from_iterable(b), np.int64, int(n.sum())), n)]

    def written(self, a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups as text, ids of A and of B with their marks, and its bytes for each token's group in order."""
        ends = [np.append(g[1:] != g[:-1], True)[:len(g)] for g in (ga, gb)]
        mark = np.concatenate([a + self.size_a * ends[0], b + 2 * self.size_a + self.size_b * ends[1]])
        group = np.concatenate([ga, gb])
        order = np.argsort(group, kind="stable")
        mark, group = mark[order], group[order]
        size = self.marks.lengths[mark]
        return self.marks.data[ragged(self.marks.offsets[mark], size)], np.bincount(group, weights=size).astype(np.int64)


class _Table:
    """Bytes of all tokens."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def whole(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which units' tokens give exactly the unit's bytes."""
        size = self.lengths[ids]
        owner = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(owner, weights=size, minlength=len(counts)).astype(np.int64)
        ok = total == sizes
        if not ok.all():
            ids, size = ids[ok[owner]], size[ok[owner]]
            data = data[np.repeat(ok, sizes)]
        apart = np.flatnonzero(self.data[ragged(self.offsets[ids], size)] != data)
        if len(apart):
            good = np.flatnonzero(ok)
            ok[good[np.searchsorted(np.cumsum(sizes[good]), apart, "right")]] = False
        return ok


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


# ---------------------------------------------------------------- alignment

def unit_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where texts begin (``first``), and spaces that follow a character that surely isn't white."""
    at = np.flatnonzero(data == 32)
    at = at[at > 3]
    b1, b2, b3, b4 = (data[at - k] for k in (1, 2, 3, 4))
    rest = [(b & 0xC0) == 0x80 for b in (b1, b2, b3)]
    solid = (b1 > 32) & (b1 < 127)
    solid |= rest[0] & (b2 >= 0xC3) & (b2 <= 0xDF)
    solid |= rest[0] & rest[1] & ((b3 == 0xE0) | (b3 >= 0xE4) & (b3 <= 0xEF))
    solid |= rest[0] & rest[1] & rest[2] & (b4 >= 0xF0)
    start = np.zeros(len(data), bool)
    start[at[solid]] = True
    start[np.append(first[1:], len(data)) - 1] = False  # a last space alone is no unit: B would have nothing to put it before
    start[first] = True
    return np.flatnonzero(start)


def links(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, b: np.ndarray, size_b: int) -> tuple[np.ndarray, ...]:
    """Groups and linked pairs of token ids a and b that end at these bytes.

    Returns where groups end, the group of each A and each B token, code and count of linked pairs as
    two rows (a pair may come more than once), and the group of each of them.
    """
    ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
    ga, gb = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
    na, nb = np.bincount(ga, minlength=len(ends)), np.bincount(gb, minlength=len(ends))
    small = na * nb <= LARGE
    # Small groups: every A token meets the B tokens of its group, which stand together.
    own = np.flatnonzero(small[ga])
    times = nb[ga[own]]
    left = np.repeat(own, times)
    right = ragged((np.cumsum(nb) - nb)[ga[own]], times)
    code, group = [a[left] * size_b + b[right]], [ga[left]]
    count = [np.ones(len(left), np.int64)]
    for g in np.flatnonzero(~small):
        xa, ca = np.unique(a[np.searchsorted(ga, g):np.searchsorted(ga, g, "right")], return_counts=True)
        xb, cb = np.unique(b[np.searchsorted(gb, g):np.searchsorted(gb, g, "right")], return_counts=True)
        code.append((xa[:, None] * size_b + xb[None, :]).ravel())
        count.append((ca[:, None] * cb[None, :]).ravel())
        group.append(np.full(len(xa) * len(xb), g))
    return ends, ga, gb, np.stack([np.concatenate(code), np.concatenate(count)]), np.concatenate(group)


class Units:
    """What a task knows about units: their figures, group texts and linked pairs."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.figures = np.zeros((0, 4), np.int64)
        self.whole = np.zeros(0, bool)
        self.text, self.begin, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.codes, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, units: list[bytes]) -> np.ndarray:
        """Places of the units, after the new ones have been tokenised and aligned."""
        if len(self.place) > KNOWN_UNITS or len(self.codes) > KNOWN_LINKS:
            self.forget()
        new = [u for u in units if u not in self.place]
        if new:
            self._learn(new)
        return np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))

    def _learn(self, units: list[bytes]) -> None:
        pair, n = self.pair, len(units)
        sizes = np.fromiter(map(len, units), np.int64, n)
        data = np.frombuffer(b"".join(units), np.uint8)
        (a, na), (b, nb) = pair.encode(units, data, sizes)
        whole = pair.bytes[0].whole(a, na, data, sizes) & pair.bytes[1].whole(b, nb, data, sizes)
        a, b = a[np.repeat(whole, na)], b[np.repeat(whole, nb)]
        na, nb = np.where(whole, na, 0), np.where(whole, nb, 0)
        ends, ga, gb, pairs, group = links(np.cumsum(pair.bytes[0].lengths[a]), np.cumsum(pair.bytes[1].lengths[b]), a, b, pair.size_b)
        owner = np.repeat(np.arange(n), na)  # of A tokens; every group has one
        of_group = owner[np.searchsorted(ga, np.arange(len(ends)))] if len(ends) else np.zeros(0, np.int64)
        n_groups = np.bincount(of_group, minlength=n)
        text, size = pair.written(a, ga, b, gb)
        size = np.bincount(of_group, weights=size, minlength=n).astype(np.int64)
        self.begin = np.concatenate([self.begin, len(self.text) + np.cumsum(size) - size])
        self.text, self.length = np.concatenate([self.text, text]), np.concatenate([self.length, size])
        # Linked pairs of a unit, each once, with how often.
        key = of_group[group]
        order = np.lexsort((pairs[0], key))
        key, code, count = key[order], pairs[0][order], pairs[1][order]
        new = np.flatnonzero(np.diff(key, prepend=-1).astype(bool) | np.diff(code, prepend=-1).astype(bool))
        times = np.add.reduceat(count, new) if len(new) else np.zeros(0, np.int64)
        many = np.bincount(key[new], minlength=n)
        n_links = np.bincount(key[new], weights=times, minlength=n).astype(np.int64)
        self.place.update(zip(units, range(len(self.place), len(self.place) + n)))
        self.first = np.concatenate([self.first, len(self.codes) + np.cumsum(many) - many])
        self.many = np.concatenate([self.many, many])
        self.codes, self.times = np.concatenate([self.codes, code[new]]), np.concatenate([self.times, times])
        self.figures = np.concatenate([self.figures, np.stack([na, nb, n_groups, n_links], axis=1)])
        self.whole = np.concatenate([self.whole, whole])


def align(known: Units, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty texts: figures (n x 4), digests of groups, and linked pairs (offsets, codes, times), each once a text."""
    n = len(offsets) - 1
    spaced = np.full(len(data) + n, 32, np.uint8)  # every text after a space
    first = offsets[:-1] + np.arange(n)
    inside = np.ones(len(spaced), bool)
    inside[first] = False
    spaced[inside] = data
    starts = unit_starts(spaced, first) if known.pair.cuts else first
    at = np.append(starts, len(spaced))
    units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(spaced)]).dictionary_encode()
    place = known.find(units.dictionary.to_pylist())[units.indices.to_numpy(zero_copy_only=False)]
    bounds = np.searchsorted(starts, np.append(first, len(spaced)))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    whole = np.ones(n, bool)
    whole[owner[~known.whole[place]]] = False
    figures = np.where(whole[:, None], np.add.reduceat(known.figures[place], bounds[:-1], axis=0), 0)
    length = known.length[place]
    text = known.text[ragged(known.begin[place], length)]
    at = np.concatenate([[0], np.cumsum(length)])[bounds]
    digests = [hashlib.sha256(text[i:j - 1]).hexdigest() if ok else "" for ok, i, j in zip(whole, at, at[1:])]  # without the last semicolon
    keep = whole[owner]
    place, owner = place[keep], owner[keep]
    many = known.many[place]
    rows = ragged(known.first[place], many)
    key = np.repeat(owner, many) * (known.pair.size_a * known.pair.size_b) + known.codes[rows]
    order = np.argsort(key, kind="stable")
    key, times = key[order], known.times[rows[order]]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    key, times = key[new], np.add.reduceat(times, new) if len(new) else times
    text, code = np.divmod(key, known.pair.size_a * known.pair.size_b)
    return figures, digests, np.searchsorted(text, np.arange(n + 1)), code, times


# ---------------------------------------------------------------- on Spark

_kept: dict[tuple[str, str], Units] = {}


def _align_batches(path_a: str, path_b: str):
    names = ["k", "copies", *_COUNTS, "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _kept:
            _kept[path_a, path_b] = Units(tokenizers(path_a, path_b))
        known = _kept[path_a, path_b]
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(2), CHUNK):
                figures, digests, at, codes, times = align(known, data, offsets)
                at = pa.array(at.astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (codes, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(np.ascontiguousarray(c)) for c in figures.T), pa.array(digests, pa.string()), *lists], names=names)
        trim()

    return run


def _score_batches(shared):
    """Sums over the links whose counts are broadcast; the other links stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = shared.value
        for batch in batches:
            where = batch.column(1).offsets.to_numpy()
            for i, j in chunks(where - where[0], LINKS):
                part = batch.slice(i, j - i)
                at = part.column(1).offsets.to_numpy()
                codes, times = (part.column(k).values.to_numpy()[at[0]:at[-1]] for k in (1, 2))
                at = at - at[0]
                hit, place = np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                    hit = known[place] == codes
                count, top = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
                count[hit] = docs[place[hit]] * times[hit]
                top[hit] = best[place[hit]] * times[hit]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (top, count)]
                left = np.concatenate([[0], np.cumsum(~hit)])[at].astype(np.int32)
                rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit])) for x in (codes, times)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(s[at[1:]] - s[at[:-1]]) for s in sums), *rest], names=["k", "n_best", "count_sum", "pairs", "times"])
        trim()

    return run


def pair_counts(texts: DataFrame, size_b: int) -> DataFrame:
    """pair, docs, best: in how many documents ids are linked, and whether none is more often linked to the A id."""
    counts = stash(texts.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("docs")))
    a = F.floor(F.col("pair") / size_b).cast("long")
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))  # a row for each entry of A's vocabulary at most
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _level(docs: str = "docs"):
    """Counts by eighths of a doubling."""
    return F.floor(F.log2(docs) * 8).cast("int")


def align_documents(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    pair = tokenizers(path_a, path_b)
    whole = docs.select(F.col(text).alias("_text")).where("_text <> ''").groupBy("_text").agg(F.count(F.lit(1)).alias("copies"))
    digest = lambda c: F.unhex(F.md5(c))
    columns = "k binary, copies long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, pairs array<long>, times array<long>"
    texts = stash(whole.select(digest("_text").alias("k"), "copies", "_text").mapInArrow(_align_batches(path_a, path_b), columns))
    counts = stash(pair_counts(texts, pair.size_b))
    # The commonest pairs, down to a level at which there are no more than COMMON.
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(_level().alias("level")).agg(F.count(F.lit(1))).collect()), reverse=True)
    taken, least = 0, 1 << 30
    for level, n in levels:
        taken += n
        if taken > COMMON:
            break
        least = level
    common = counts.where(_level() >= least).toArrow().sort_by("pair").combine_chunks()
    shared = spark.sparkContext.broadcast(tuple(common[c].to_numpy() for c in ("pair", "docs", "best")))
    links_ = "k binary, n_best long, count_sum long, pairs array<long>, times array<long>"
    if taken <= COMMON:
        sums = texts.select("k", "pairs", "times").mapInArrow(_score_batches(shared), links_).select("k", "n_best", "count_sum")
    else:
        some = stash(texts.select("k", "pairs", "times").mapInArrow(_score_batches(shared), links_))
        rest = some.select("k", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("k", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        rare = rest.join(counts.where(_level() < least), "pair").select("k", F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).alias("n_best"), (F.col("times") * F.col("docs")).alias("count_sum"))
        sums = some.select("k", "n_best", "count_sum").unionByName(rare).groupBy("k").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    names = [*_COUNTS, "n_best", "count_sum", "groups_sha256"]
    measured = stash(texts.select("k", "copies", *_COUNTS, "groups_sha256").join(sums, "k").select("k", "copies", *names))
    discard(texts)
    return _to_documents(docs.select(F.col(key).alias("_id"), digest(F.nullif(F.col(text), F.lit(""))).alias("k")), measured, names).withColumnRenamed("_id", key)


def _to_documents(ids: DataFrame, measured: DataFrame, names: list[str]) -> DataFrame:
    """Measures of each document's text.  Texts with very many copies, of which there are few, are broadcast; documents without text have zeros."""
    ids = stash(ids)
    n = ids.count()
    hot = F.col("copies") > max(1000, n // 10_000)  # fewer than 10,000 texts
    many, few = measured.where(hot).drop("copies"), measured.where(~hot).drop("copies")
    zero = [F.lit("" if c == "groups_sha256" else 0).cast("string" if c == "groups_sha256" else "long").alias(c) for c in names]
    out = ids.where("k is null").select("_id", *zero)
    own = ids.where("k is not null")
    out = out.unionByName(own.join(F.broadcast(many.select("k")), "k", "left_anti").join(few, "k").select("_id", *names))
    return out.unionByName(own.join(F.broadcast(many), "k").select("_id", *names))
