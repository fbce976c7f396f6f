"""Small helpers that the corpus operators share: scratch tables and vectorised text scans.

Text scans work on whole Arrow batches: one byte buffer for many texts, cut
into bounded chunks, so that memory follows the chunk and not the partition.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the corpus contract: space and the controls 9 to 13.
SPACE_BYTES = (32, 9, 10, 11, 12, 13)
#: The same as a character class for Spark's and DuckDB's regular expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- scratch

def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder; a session of one machine may do without one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tracelens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tracelens-{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str, buckets: int) -> Column:
    """crc32 of an id written as text, modulo ``buckets`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


def kth_largest(table: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a whole-number column (0 <= value < 2**48); None if k < 1 or there are fewer rows."""
    if k < 1:
        return None
    prefix, left = 0, k
    for shift in (32, 16, 0):
        here = table.where(F.shiftright(column, shift + 16) == prefix) if shift < 32 else table
        counts = here.groupBy(F.shiftright(column, shift).alias("p")).count().collect()  # at most 2**16 rows
        for p, n in sorted(counts, reverse=True):
            if n >= left:
                prefix = p
                break
            left -= n
        else:
            return None
    return prefix


# ---------------------------------------------------------------- batches

def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """One uint8 buffer and int64 offsets (n+1) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset:]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts that hold at most ``limit`` bytes together, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, bytes, offsets) for each bounded run of texts of a column."""
    data, offsets = byte_view(column)
    for i, j in chunks(offsets, limit):
        at = offsets[i:j + 1]
        yield i, j, data[at[0]:at[-1]], at - at[0]
    trim()


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between stages, beside the executor's heap."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc only
        libc.malloc_trim(0)


# ---------------------------------------------------------------- words

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE_BYTES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and per text the first word's number (n+1 long)."""
    inside = _IS_WORD[data]
    edge = np.empty(len(data) + 1, np.int8)
    flags = inside.view(np.int8)
    edge[1:-1] = flags[1:] - flags[:-1]
    edge[0], edge[-1] = (flags[0], -flags[-1]) if len(data) else (0, 0)
    starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]]  # words that touch across two texts
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- hashes

def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works in place on a fresh array.  Fixed values: public mixing constants."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


_P = (1 << 31) - 1  # a Mersenne prime, so that remainders are shifts and sums
#: A base for each of the two lanes, and its inverse.
_BASES = (1_103_515_245, 1_664_525_017)
_INVERSES = tuple(pow(b, -1, _P) for b in _BASES)


def _byte_table(seed: int) -> np.ndarray:
    """Different 16-bit values for the bytes."""
    order = np.argsort(mix(np.arange(1, 257, dtype=np.uint64) * _U(_MULT) + _U(seed * 0x1F123BB5)))
    return order.astype(np.uint64) * _U(251) + _U(97 + seed)


def _fold(x: np.ndarray) -> np.ndarray:
    """The same modulo _P, much smaller."""
    out = x >> _U(31)
    out += x & _U(_P)
    return out


def _rest(x: np.ndarray) -> np.ndarray:
    """x modulo _P, for x below 2**63."""
    x = _fold(_fold(x))
    x -= (x >= _U(_P)) * _U(_P)
    return x


_STEP = 1 << 14
#: A multiple of _P above all sums: differences stay positive.
_ABOVE = _U(_P * ((1 << 31) + 8))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo _P, kept for the longest chunk of up to 2 MB so far."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have, step = np.ones(1, np.uint64), base
        while len(have) < size:
            have = np.concatenate([have, _rest(have * _U(step))])
            step = step * step % _P
        have = have[:size]
        if size <= 1 << 21 | 1:
            _powers[base] = have
    return have[:n]


class SpanHash:
    """62-bit hashes of any byte spans of a buffer, from prefix sums: polynomials over two bases modulo a prime."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        self.n, self.sums = len(data), []
        self.back = [_power(i, self.n + 1) for i in _INVERSES]
        for lane, base in enumerate(_BASES):
            table, power, sums = _byte_table(2 * seed + lane), _power(base, self.n), np.zeros(self.n + 1, np.uint64)
            carry = _U(0)
            for i in range(0, self.n, _STEP):  # small blocks stay in the processor's cache
                part = sums[i + 1:i + 1 + min(_STEP, self.n - i)]
                np.take(table, data[i:i + _STEP], out=part, mode="clip")
                part *= power[i:i + _STEP]
                np.cumsum(part, out=part)  # below 2**(16 + 31 + 14)
                part += carry
                carry = part[-1] % _U(_P)
            self.sums.append(sums)

    def _mixed(self, ends: list[np.ndarray], begins: list[np.ndarray], starts) -> np.ndarray:
        """From the lanes' sums at both borders: differences moved to position 0, reduced, and put together."""
        a, b = (_rest(_fold(_fold(e + _ABOVE - s)) * back[starts]) for e, s, back in zip(ends, begins, self.back))
        b <<= _U(32)
        b |= a
        return b

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal spans give equal values, wherever they stand."""
        out = np.empty(len(starts), np.uint64)
        for i in range(0, len(starts), _STEP):
            x, y = starts[i:i + _STEP], ends[i:i + _STEP]
            out[i:i + _STEP] = mix(self._mixed([s[y] for s in self.sums], [s[x] for s in self.sums], x) + (y - x).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        return out

    def windows(self, width: int) -> np.ndarray:
        """Of every window of ``width`` bytes of the buffer."""
        out = np.empty(max(0, self.n - width + 1), np.uint64)
        for i in range(0, len(out), _STEP):
            j = min(i + _STEP, len(out))
            out[i:j] = mix(self._mixed([s[i + width:j + width] for s in self.sums], [s[i:j] for s in self.sums], slice(i, j)))
        return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A representative of each distinct span, and which of them every span is.  Hashes propose, bytes decide."""
    _, where, which = np.unique(SpanHash(data).spans(starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    wrong = size != size[where][which]
    done = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(starts):  # spans of about a block's bytes at a time
        j = max(i + 1, int(np.searchsorted(done, done[i] + (_STEP << 2), "right")) - 1)
        some = np.flatnonzero(~wrong[i:j]) + i
        if len(some):
            n = size[some]
            apart = data[ragged(starts[some], n)] != data[ragged(starts[where[which[some]]], n)]
            if apart.any():
                wrong[np.unique(np.repeat(some, n)[apart])] = True
        i = j
    bad = np.flatnonzero(wrong)
    if len(bad):  # equal hashes of different bytes
        known: dict[bytes, int] = {}
        extra: list[int] = []
        for k in bad:
            body = data[starts[k]:ends[k]].tobytes()
            if body not in known:
                known[body] = len(where) + len(extra)
                extra.append(k)
            which[k] = known[body]
        where = np.concatenate([where, extra])
    return where, which


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, .. of every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


# ---------------------------------------------------------------- room on disk

def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now, not when the driver happens to collect garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(table: DataFrame) -> None:
    """Deletes a stashed table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
