"""Byte-pair encoding and decoding as bounded-lookahead streaming transducers.

The encoder never needs a whole text: a token is emitted as soon as no later
byte can change it.  Two facts make that exact.

* Between pre-tokens nothing merges, and a pre-token is closed by at most four
  following characters.
* Inside a pre-token, a merge can be prevented from the right only by a chain
  of merges of falling rank, each of which takes a token from the right spine
  of the one before.  :func:`lookahead` walks the merge list once and returns
  the longest such chain in bytes.  A token whose end lies that far (plus one
  token length) before the end of the bytes seen so far is final, and the
  rest of the pre-token is encoded on from there.

:class:`TextEncoder` takes a text's bytes piecemeal and emits tokens once they are
stable: those of a pre-token when it is closed, those of one that grows beyond a
slice through :class:`StreamEncoder`.  Its memory is that of a slice, whatever the
text.  Texts that are no longer than a chunk are closed when they are read, so they
are encoded many at a time, as arrays: the distinct pre-tokens (by their bytes)
are merged in lock step, one merge for each in a round.

Decoding is an incremental byte-to-text state machine: token bytes go in, text
comes out as soon as a character is complete, broken bytes become U+FFFD.

Defined results: null and empty texts have no tokens; repeated rows have equal
results; extra columns pass through :func:`encode_documents` only by ``keep``.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import distinct_spans, ragged, text_chunks, trim

#: Pre-tokens above this many bytes are streamed, not merged in lock step with others.
LONG_PIECE = 256
#: Bytes that the streaming encoder takes in at once, besides the lookahead.
FEED = 4096
#: Bytes of a text that are looked at together; longer texts are streamed.
SLICE = 1 << 20
#: Characters that decide where a pre-token ends: a contraction's, and one before and after.
_NEAR = 8

#: The printable stand-ins for bytes in byte-level vocabularies.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


def _byte_of_char() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def lookahead(merges: list[tuple[int, int, int]], lengths: np.ndarray) -> int:
    """Bytes to the right of a token that can still change it, for merges (left, right, made) in rank order.

    Merge j can be undone from the right when a merge of lower rank takes, as its
    left part, a token of the right spine of j's right part.  So the reach of j is
    the length of its right part plus the longest reach of such a merge.
    """
    reach: dict[int, int] = {}  # by left part, over the merges so far
    parts: dict[int, int] = {}  # right part of each made token
    most = 0
    for left, right, made in merges:
        token, best = right, 0
        while token is not None:
            best = max(best, reach.get(token, 0))
            token = parts.get(token)
        here = int(lengths[right]) + best
        reach[left] = max(reach.get(left, 0), here)
        parts.setdefault(made, right)
        most = max(most, here)
    return most + int(lengths.max(initial=1))


class Vocabulary:
    """A byte-level BPE vocabulary: token bytes, merge ranks in an open hash table, character classes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, byte = spec["model"]["vocab"], _byte_of_char()
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        text = [b""] * self.size
        for token, i in ids.items():
            text[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            text[i] = token
        self.bytes = text
        self.lengths = np.array([len(t) for t in text], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(text), np.uint8)
        self.first = np.zeros(256, np.int32)  # the token of each single byte
        for c, b in byte.items():
            self.first[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.ranks = {(a, b): (r, c) for r, (a, b, c) in enumerate(self.merges)}
        self.lookahead = lookahead(self.merges, self.lengths)
        # Open addressing over (left, right), at most a quarter full.
        bits = max(4, int(4 * len(pairs)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._vals = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        for r, (a, b, c) in enumerate(self.merges):
            key = a * self.size + b
            slot = ((key * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> int(self._shift)
            while self._keys[slot] >= 0:
                slot = (slot + 1) & self._mask
            self._keys[slot], self._vals[slot] = key, (r << 32) | c

    NONE = np.int64(1) << 62

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | made token of every pair; NONE where they don't merge."""
        key = left.astype(np.int64) * self.size + right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)
        found = self._keys[slot]
        out = np.where(found == key, self._vals[slot], self.NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self._mask
            found = self._keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self._vals[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# ---------------------------------------------------------------- one pre-token

def merge_piece(vocab: Vocabulary, piece: bytes) -> list[int]:
    """Tokens of one pre-token by the definition: the lowest rank first, the leftmost of equals."""
    ids = [int(vocab.first[b]) for b in piece]
    while len(ids) > 1:
        best = min(((vocab.ranks.get(p, (1 << 60, 0)), i) for i, p in enumerate(zip(ids, ids[1:]))), key=lambda x: (x[0][0], x[1]))
        (rank, made), i = best
        if rank == 1 << 60:
            break
        ids[i:i + 2] = [made]
    return ids


class StreamEncoder:
    """Encodes one pre-token of any length from bytes that arrive piecemeal."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.rest = vocab, b""

    def feed(self, data: bytes) -> list[int]:
        """The tokens that have become stable."""
        self.rest += data
        if len(self.rest) < FEED + self.vocab.lookahead:
            return []
        ids = _merge_many(self.vocab, np.frombuffer(self.rest, np.uint8), np.array([0, len(self.rest)]))[0]
        ends = np.cumsum(self.vocab.lengths[ids])
        stable = int(np.searchsorted(ends, len(self.rest) - self.vocab.lookahead, "right"))
        if stable:
            self.rest = self.rest[int(ends[stable - 1]):]
        return ids[:stable].tolist()

    def finish(self) -> list[int]:
        ids = _merge_many(self.vocab, np.frombuffer(self.rest, np.uint8), np.array([0, len(self.rest)]))[0]
        self.rest = b""
        return ids.tolist()


def stream_piece(vocab: Vocabulary, piece: bytes) -> np.ndarray:
    encoder = StreamEncoder(vocab)
    out: list[int] = []
    for i in range(0, len(piece), FEED):
        out += encoder.feed(piece[i:i + FEED])
    return np.array(out + encoder.finish(), np.int32)


# ---------------------------------------------------------------- many pre-tokens at once

def _merge_many(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many pre-tokens and their offsets.  In a round every unfinished one merges once."""
    n = len(offsets) - 1
    ids = vocab.first[data]
    counts = np.diff(offsets)
    done_ids: list[np.ndarray] = []
    done_no: list[np.ndarray] = []
    no = np.arange(n)
    while len(no):
        starts = np.cumsum(counts) - counts
        value = np.full(len(ids), vocab.NONE, np.int64)
        if len(ids) > 1:
            value[:-1] = vocab.rank(ids[:-1], ids[1:])
        value[starts + counts - 1] = vocab.NONE  # the last token of a piece has no right neighbour
        least = np.minimum.reduceat(value, starts)
        over = least == vocab.NONE
        if over.any():
            out = np.repeat(over, counts)
            done_ids.append(ids[out])
            done_no.append(np.repeat(no[over], counts[over]))
            ids, value, least = ids[~out], value[~out], least[~over]
            no, counts = no[~over], counts[~over]
            if not len(no):
                break
        hit = np.flatnonzero(value == np.repeat(least, counts))
        piece = np.searchsorted(np.cumsum(counts), hit, "right")
        first = np.ones(len(hit), bool)
        first[1:] = piece[1:] != piece[:-1]
        hit = hit[first]
        ids[hit] = (least & 0xFFFFFFFF).astype(np.int32)
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        ids, counts = ids[keep], counts - 1
    if not done_no:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    no, ids = np.concatenate(done_no), np.concatenate(done_ids)
    order = np.argsort(no, kind="stable")
    counts = np.bincount(no, minlength=n)
    return ids[order], np.concatenate([[0], np.cumsum(counts)])


# ---------------------------------------------------------------- pre-tokens

@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = _LETTER
        elif kind == "N":
            table[c] = _NUMBER
    # Code points with the Unicode property White_Space.
    for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[c] = _SPACE
    return table


_ONE = np.zeros(0x80, bool)
_ONE[[ord(c) for c in "stmd"]] = True


def piece_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, as flags over the code points of texts that start at ``bounds``.

    The rules of the common byte-level pattern: a run of letters, of numbers or of
    other characters takes one space before it; English contractions stand alone
    after an apostrophe that nothing precedes in its run; of white space before
    something else the last character is set apart.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = _classes()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    fresh = fresh[:n]
    start = fresh.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start & ~fresh & (kind != _SPACE))
    after = after[kind[after - 1] == _SPACE]
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    # Contractions.
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~fresh[quote + 1]]
    if len(quote):
        a = points[quote + 1]
        one = quote[(a < 0x80) & _ONE[np.minimum(a, 0x7F)]]
        two = quote[quote + 2 < n]
        two = two[~fresh[two + 2]]
        a, b = points[two + 1], points[two + 2]
        two = two[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
        for at, width in ((one, 1), (two, 2)):
            start[at + 1] = False
            rest = at + 1 + width
            start[rest[rest < n]] = True
            wrong = rest[rest < n]  # a space that the next run takes has been flagged before; others start by class
            wrong = wrong[(kind[wrong] != _LETTER) & ~fresh[wrong] & (kind[wrong] == kind[wrong - 1])]
            start[wrong] = False
    return start


def _utf8_width(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


def encode_chunk(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts of a chunk (UTF-8 bytes and offsets), and their offsets."""
    raw = data.tobytes()
    if any(s in raw for s in vocab.special):
        return _with_special(vocab, raw, offsets)
    if not raw:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        at = np.arange(len(points) + 1, dtype=np.int64)
        bounds = offsets
    else:
        at = np.concatenate([[0], np.cumsum(_utf8_width(points))])
        bounds = np.searchsorted(at, offsets)
    firsts = np.flatnonzero(piece_starts(points, bounds))
    starts = at[firsts]
    ends = np.concatenate([starts[1:], [len(data)]])
    first_piece = np.searchsorted(starts, offsets)
    ids, total = encode_pieces(vocab, raw, data, starts, ends)
    return ids, total[first_piece]


def encode_pieces(vocab: Vocabulary, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of pre-tokens of a buffer (as bytes and as array), and their offsets; different ones are merged once."""
    where, which = distinct_spans(data, starts, ends)
    starts, lengths = starts[where], (ends - starts)[where]
    ids, at = _distinct(vocab, raw, data, starts, lengths)
    counts = np.diff(at)
    return ids[ragged(at[:-1][which], counts[which])], np.concatenate([[0], np.cumsum(counts[which])])


def _distinct(vocab: Vocabulary, raw: bytes, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    long_ = np.flatnonzero(lengths > LONG_PIECE)
    short = lengths.copy()
    short[long_] = 0
    some = np.flatnonzero(short)
    order = some[np.argsort(short[some], kind="stable")]
    got, at = _merge_many(vocab, data[ragged(starts[order], short[order])], np.concatenate([[0], np.cumsum(short[order])]))
    counts = np.zeros(len(starts), np.int64)
    counts[order] = np.diff(at)
    streamed = {int(i): stream_piece(vocab, raw[starts[i]:starts[i] + lengths[i]]) for i in long_}
    for i, x in streamed.items():
        counts[i] = len(x)
    begin = np.zeros(len(starts), np.int64)
    begin[order] = at[:-1]
    if streamed:
        tail = np.cumsum([0, *map(len, streamed.values())]) + len(got)
        begin[list(streamed)] = tail[:-1]
        got = np.concatenate([got, *streamed.values()])
    return got[ragged(begin, counts)], np.concatenate([[0], np.cumsum(counts)])


def _with_special(vocab: Vocabulary, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same where a special token's text occurs: it is cut out first and is one token."""
    parts: list[bytes] = []
    marks: list[int] = []  # the special token after each part, -1 for none
    firsts = [0]
    for i in range(len(offsets) - 1):
        rest = raw[offsets[i]:offsets[i + 1]]
        while hits := [(p, -len(s), s) for s in vocab.special if (p := rest.find(s)) >= 0]:
            p, _, s = min(hits)
            parts.append(rest[:p])
            marks.append(vocab.special[s])
            rest = rest[p + len(s):]
        parts.append(rest)
        marks.append(-1)
        firsts.append(len(parts))
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    plain = Vocabulary.__new__(Vocabulary)
    plain.__dict__ = vocab.__dict__ | {"special": {}}
    ids, where = encode_chunk(plain, np.frombuffer(b"".join(parts), np.uint8), at)
    out, counts = [], []
    for i, mark in enumerate(marks):
        mine = ids[where[i]:where[i + 1]]
        out.append(mine if mark < 0 else np.append(mine, np.int32(mark)))
        counts.append(len(out[-1]))
    total = np.concatenate([[0], np.cumsum(counts)])
    return np.concatenate(out).astype(np.int32), total[firsts]


# ---------------------------------------------------------------- a text of any length

class TextEncoder:
    """Encodes one text of any length from bytes that arrive piecemeal, in the memory of a slice.

    ``rest`` holds what isn't encoded yet.  While a pre-token is open, its bytes are in ``open``
    but for the last two characters, which stay in ``rest`` so that its borders are seen rightly.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.rest, self.open, self.seen = vocab, b"", None, 0
        self.special = max(map(len, vocab.special), default=1) - 1

    def feed(self, data: bytes) -> np.ndarray:
        """The tokens that have become stable."""
        self.rest += data
        out = []
        while hits := [(p, -len(t), t) for t in self.vocab.special if (p := self.rest.find(t)) >= 0]:
            p, _, token = min(hits)
            if p + len(token) + self.special > len(self.rest) and any(len(t) > len(token) and t.startswith(token) for t in self.vocab.special):
                break  # it may be a longer one
            after, self.rest = self.rest[p + len(token):], self.rest[:p]
            out += [self._close(), np.array([self.vocab.special[token]], np.int32)]
            self.rest = after
        out.append(self._advance())
        return np.concatenate(out)

    def finish(self) -> np.ndarray:
        """The remaining tokens."""
        return self._close()

    def _close(self) -> np.ndarray:
        return self._until(len(self.rest), self._starts(len(self.rest))[0])

    def _starts(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens start in ``rest[:end]``, and the characters, as bytes."""
        points = np.frombuffer(self.rest[:end].decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(_utf8_width(points))])
        starts = np.flatnonzero(piece_starts(points, np.zeros(1, np.int64)))
        return at[starts[at[starts] >= self.seen]], at

    def _until(self, end: int, starts: np.ndarray) -> np.ndarray:
        """Tokens of ``rest[:end]``, where a pre-token ends."""
        out, first = [], 0
        if self.open is not None:
            first = int(starts[0]) if len(starts) and starts[0] < end else end
            out += [self._stream(self.rest[self.seen:first]), np.array(self.open.finish(), np.int32)]
            self.open = None
        if first < end:
            mine = starts[(starts >= first) & (starts < end)]
            out.append(encode_pieces(self.vocab, self.rest, np.frombuffer(self.rest, np.uint8), mine, np.append(mine[1:], end))[0])
        self.rest, self.seen = self.rest[end:], 0
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _stream(self, data: bytes) -> np.ndarray:
        return np.array([x for i in range(0, len(data), FEED) for x in self.open.feed(data[i:i + FEED])], np.int32)

    def _advance(self) -> np.ndarray:
        """Encodes up to the last start of a pre-token that no later byte can move."""
        none, end = np.zeros(0, np.int32), len(self.rest) - self.special
        if end < SLICE:
            return none
        while end and self.rest[end] & 0xC0 == 0x80:
            end -= 1
        starts, at = self._starts(end)
        sure = int(at[max(0, len(at) - 1 - _NEAR)])
        before = starts[(starts <= sure) & (starts > 0)]
        if len(before):
            return self._until(int(before[-1]), starts)
        if self.open is None:
            self.open = StreamEncoder(self.vocab)
        ids = self._stream(self.rest[self.seen:sure])
        back = int(at[max(0, len(at) - 3 - _NEAR)])
        self.rest, self.seen = self.rest[back:], sure - back
        return ids


def encode_stream(vocab: Vocabulary, data: np.ndarray) -> Iterator[np.ndarray]:
    """Tokens of one long text, slice by slice."""
    encoder = TextEncoder(vocab)
    for i in range(0, len(data), SLICE):
        yield encoder.feed(data[i:i + SLICE].tobytes())
    yield encoder.finish()


def encode_texts(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts of a chunk, and their offsets: of many short ones together, or of a long one slice by slice."""
    if len(data) <= 2 * SLICE:
        return encode_chunk(vocab, data, offsets)
    parts = [np.concatenate(list(encode_stream(vocab, data[a:b]))) for a, b in zip(offsets, offsets[1:])]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


# ---------------------------------------------------------------- decoding

class StreamDecoder:
    """Token ids to text, as soon as characters are complete."""

    def __init__(self, vocab: Vocabulary, skip: Iterable[int] = ()):
        self.vocab, self.skip = vocab, set(skip)
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        if self.skip:
            ids = ids[~np.isin(ids, list(self.skip))]
        return self.state.decode(token_bytes(self.vocab, ids).tobytes())

    def finish(self) -> str:
        return self.state.decode(b"", True)


def token_bytes(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    return vocab.data[ragged(vocab.offsets[ids], vocab.lengths[ids])]


def decode(vocab: Vocabulary, ids: np.ndarray, step: int = 1 << 16) -> str:
    """The text of any number of tokens, through the state machine."""
    decoder = StreamDecoder(vocab)
    return "".join([decoder.feed(ids[i:i + step]) for i in range(0, len(ids), step)] + [decoder.finish()])


# ---------------------------------------------------------------- on Spark

def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` (binary: little-endian unsigned 32-bit token ids) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(len(keep))):
                ids, at = encode_texts(vocab, data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keep))), _binary(ids.astype("<u4"), at)], names=[*keep, "ids"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*keep, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", ids binary")


def _binary(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode every text: key, n_tokens, ids_sha256, decoded_sha256.  Digests grow with the stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                if j - i == 1 and len(data) > SLICE:
                    parts = [encode_stream(vocab, data)]
                else:
                    ids, at = encode_chunk(vocab, data, offsets)
                    parts = [[ids[a:b]] for a, b in zip(at, at[1:])]
                done = [_digests(vocab, p) for p in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array([d[k] for d in done]) for k in range(3))], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
            trim()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _digests(vocab: Vocabulary, parts: Iterable[np.ndarray], step: int = 1 << 16) -> tuple[int, str, str]:
    """Number of tokens, and digests of them and of their text."""
    n, packed, text, decoder = 0, hashlib.sha256(), hashlib.sha256(), StreamDecoder(vocab)
    for ids in parts:
        n += len(ids)
        packed.update(ids.astype("<u4"))
        for i in range(0, len(ids), step):
            text.update(decoder.feed(ids[i:i + step]).encode("utf-8"))
    text.update(decoder.finish().encode("utf-8"))
    return n, packed.hexdigest(), text.hexdigest()
