"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word goes in as the sum of what it is (an embedding by hash of the whole word) and what
it is made of (the mean of embeddings of its character pairs).  All windows of
``WINDOW`` words, one starting at every word, are scored; training takes those ``STRIDE``
apart, which cover the whole text too.  Each is read in both directions by gated
recurrent units, pooled by attention and scored.  A text's score comes from its strongest
window, calibrated to the share of toxic texts.

The states of two windows at one word are the same but for rounding once they have met, and most meet after a few
words.  So a window's states are read until they meet those that run on through the text, which give its other
words; what does not meet, and all that comes near a text's strongest window, is read in full, and a score
comes from windows read in full only (:meth:`Network._whole`).  A score is rounded, so for most texts it is 0 or 1 whatever
their logit is exactly: all windows are first gone through with rough states, and only the texts that this leaves open again.

The network is trained on the driver, on a sample of bounded size: whole texts in the order
of a hash of their ids, at most ``TRAIN_ROWS`` of each label and ``TRAIN_BYTES`` bytes of each
label together (a text that goes beyond what is left of these bytes is passed over).
A long text's gradient runs through its ``STRONGEST`` windows of highest score.  Scoring
runs in Arrow batches over all texts.

Defined results: null texts are empty; a text without words gets the score of the bias;
equal texts get equal scores; ids, language and source are never inputs; an id with both
labels is toxic; labels other than 0 and 1, and null ids, are not learned from; without
texts of both kinds in the sample every score is the share of toxic labels (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import fold, LOWER, ragged, SpanHash, stash, text_chunks, trim, word_spans

WINDOW, STRIDE = 32, 24
#: Embedding buckets and sizes, hidden units of a direction, attention units.
WORD_BUCKETS, PAIR_BUCKETS, WORD_DIM, PAIR_DIM, HIDDEN, ATTEND = 1 << 14, 1 << 12, 8, 8, 8, 8
TRAIN_ROWS, TRAIN_BYTES, STRONGEST = 2000, 1 << 23, 256
EPOCHS, BATCH, RATE = 12, 48, 8e-3
#: Labels are learned from rows whose crc32(id) modulo this is not 0.
FOLDS = 5
#: Windows that are worked on together: any ones, and those of a stream.
_BLOCK, _STREAM = 2048, 8192
#: Pieces of a stream that are read on together, windows of each, and windows that are worked on together while states meet.
_PIECES, _PIECE, _SIDE = 1536, 128, 8192
#: States closer than this have met; logits from met states are taken to be right within ``NEAR``, and checked.
MET, NEAR = 2.0 ** -11, 2.0 ** -6
#: The same where a text is only to be told from those whose score is not 0.
ROUGH_MET, ROUGH_NEAR = 2.0 ** -5, 2.0
#: There, exp(x) is the float whose bits are those of the integer x * _SLOPE + _BASE: right within 3 in a hundred.
_SLOPE, _BASE, _TOP = 2.0 ** 23 / np.log(2), 127 * 2.0 ** 23 - 366393, 254 * 2.0 ** 23
#: One window of so many is read in full as a check.
_CHECK = 256
#: Share of unmet windows that is read in full at once, that one more step must save, and above which a block is read in full.
_FEW, _LESS, _MANY = 0.03, 0.02, 0.25
#: Decimals of a score, and the log odds from which it is 1 (0) with these, with room for rounding.
DECIMALS, SURE = 6, 15.0
_f = np.float32


@dataclass
class Words:
    """The distinct words of a chunk and where they stand."""

    inverse: np.ndarray  # distinct word of every token
    at: np.ndarray  # tokens of each text
    bucket: np.ndarray  # of each distinct word
    pair: np.ndarray  # character-pair buckets of all distinct words, one after the other
    pair_at: np.ndarray


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each UTF-8 character (its bytes put together), and where words from the bytes ``at`` on begin."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    if len(start) == len(data):
        return data, at
    width = np.diff(np.append(start, len(data)))
    out = data[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(width > k)
        out[more] = out[more] << np.uint32(8) | data[start[more] + k]
    return out, np.searchsorted(start, at)


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = LOWER[data]
    starts, ends, at = word_spans(data, offsets)
    h, where, inverse = np.unique(SpanHash(data).spans(starts, ends), return_index=True, return_inverse=True)
    first, last = starts[where], ends[where]
    # Pairs of neighbouring characters, with one mark before and one after the word.
    size = last - first
    letters, at_letter = characters(data[ragged(first, size)], np.concatenate([[0], np.cumsum(size)]))
    n = np.diff(at_letter) + 1
    left = ragged(at_letter[:-1] - 1, n)
    begin = np.zeros(len(left), bool)
    begin[np.cumsum(n) - n] = True
    finish = np.zeros(len(left), bool)
    finish[np.cumsum(n) - 1] = True
    a = np.where(begin, 2, letters[np.maximum(left, 0)]).astype(np.uint32) if len(left) else np.zeros(0, np.uint32)
    b = np.where(finish, 3, letters[np.minimum(left + 1, max(len(letters) - 1, 0))]).astype(np.uint32) if len(left) else np.zeros(0, np.uint32)
    pair = ((a * np.uint32(40503) + b) * np.uint32(2654435761)) >> np.uint32(20)
    return Words(inverse, at, (h >> np.uint64(50)).astype(np.int64), pair.astype(np.int64), np.concatenate([[0], np.cumsum(n)]))


def windows(at: np.ndarray, width: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, number of tokens and text of all windows; every text has one at least."""
    size = np.diff(at)
    n = np.maximum(1, -(-(size - width) // stride) + 1)
    text = np.repeat(np.arange(len(size)), n)
    first = ragged(np.zeros(len(size), np.int64), n) * stride
    return at[text] + first, np.minimum(width, size[text] - first), text


def exponentials(x: np.ndarray, rough: bool) -> np.ndarray:
    """exp(x), in place of x; ``rough``: of x that is given as x * _SLOPE + _BASE, nearly."""
    if not rough:
        return np.exp(x, out=x)
    return np.clip(x, _f(0), _f(_TOP), out=x).astype(np.int32).view(_f)


def step(u: np.ndarray, x: np.ndarray, h: np.ndarray, g: np.ndarray, out: np.ndarray, rough: bool = False) -> np.ndarray:
    """The states after one more word: ``x`` its gate inputs, ``h`` the states before, ``g`` room to work in.

    A gate is 1 / (1 + exp(-x)), a candidate 1 - 2 / (1 + exp(2 x)), as numpy's exp takes less time
    than its tanh; gates divide by 1 + exp(-x).  The factors are in the weights, and an overflow gives the limit.
    """
    one, gate, c = _f(1), g[:2 * HIDDEN], g[2 * HIDDEN:]
    np.matmul(u, h, out=g)
    gate += x[:2 * HIDDEN]
    gate = exponentials(gate, rough)
    gate += one
    z, r = gate[:HIDDEN], gate[HIDDEN:]
    c /= r
    c += x[2 * HIDDEN:3 * HIDDEN]
    c = exponentials(c, rough)
    c += one
    np.divide(_f(-2), c, out=c)
    c += one
    np.subtract(h, c, out=out)
    out /= z
    out += c
    return out


def runs(values: np.ndarray, width: int) -> np.ndarray:
    """Sums of ``width`` neighbours along the last axis, from sums of 1, 2, 4 and so on."""
    n, at, size = values.shape[-1] - width + 1, 0, 1
    out = np.zeros_like(values[..., :n])
    while True:
        if width & size:
            out += values[..., at:at + n]
            at += size
        if 2 * size > width:
            return out
        values = values[..., :-size] + values[..., size:]
        size *= 2


class Network:
    """Parameters as float32 arrays by name."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        d = WORD_DIM + PAIR_DIM

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(_f)

        self.p = {"word": draw(WORD_BUCKETS, WORD_DIM, scale=0.1), "pair": draw(PAIR_BUCKETS, PAIR_DIM, scale=0.3)}
        for s in "fb":  # forward, backward
            self.p |= {f"w{s}": draw(d, 3 * HIDDEN, scale=d ** -0.5), f"u{s}": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN ** -0.5), f"c{s}": np.zeros(3 * HIDDEN, _f)}
        self.p |= {"wa": draw(2 * HIDDEN, ATTEND, scale=0.3), "ba": np.zeros(ATTEND, _f), "va": draw(ATTEND, scale=0.3), "wo": draw(2 * HIDDEN, scale=0.3), "bo": np.zeros(1, _f)}
        self.scale, self.shift = 1.0, 0.0

    def vectors(self, w: Words) -> np.ndarray:
        """Input vectors of the distinct words."""
        n = np.diff(w.pair_at)
        if not len(n):
            return np.zeros((1, WORD_DIM + PAIR_DIM), _f)
        made = np.add.reduceat(self.p["pair"][w.pair], w.pair_at[:-1]) / n[:, None].astype(_f)
        return np.concatenate([self.p["word"][w.bucket], made], axis=1)

    def projections(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Gate inputs of the distinct words, by direction: (update, reset, candidate) x words x units."""
        return {s: np.ascontiguousarray((x @ self.p[f"w{s}"] + self.p[f"c{s}"]).reshape(len(x), 3, HIDDEN).swapaxes(0, 1)) for s in "fb"}

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray | None, cache: dict | None = None, projected: dict | None = None) -> np.ndarray:
        """Logits of windows: ``index`` (windows, steps) into word vectors ``x``, ``mask`` of real words
        (None: all are); ``projected`` is :meth:`projections` of x."""
        projected, index = projected or self.projections(x), np.ascontiguousarray(index.T)
        real = None if mask is None else np.ascontiguousarray(mask.T)
        return self._read(lambda s, k: np.take(projected[s], index[k], axis=1), index.shape[1], real, cache, len(index))

    def _read(self, gates, n: int, real: np.ndarray | None = None, cache: dict | None = None, t: int = WINDOW) -> np.ndarray:
        """Logits of ``n`` windows whose k-th words have the gate inputs ``gates(direction, k)``; ``real`` marks words (steps, windows)."""
        p, h_, half = self.p, HIDDEN, _f(0.5)
        states = {}
        for s, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            held = np.empty((t, n, h_), _f)
            u = np.ascontiguousarray(p[f"u{s}"].reshape(h_, 3, h_).swapaxes(0, 1))
            h, steps = np.zeros((n, h_), _f), []
            for k in order:
                xs, hu = gates(s, k), h @ u
                zr, inner = hu[:2], hu[2]
                zr += xs[:2]
                zr *= half
                np.tanh(zr, out=zr)
                zr *= half
                zr += half
                z, r = zr
                c = r * inner
                c += xs[2]
                np.tanh(c, out=c)
                new = np.subtract(h, c, out=held[k])
                new *= z
                new += c
                if cache is not None:
                    steps.append((k, h, z, r, c, inner))
                if real is not None:
                    new -= h
                    new *= real[k][:, None]
                    new += h
                h = new
            states[s] = held
            if cache is not None:
                cache[s] = steps
        att = states["f"] @ p["wa"][:h_]
        att += states["b"] @ p["wa"][h_:]
        att += p["ba"]
        np.tanh(att, out=att)
        e = att @ p["va"]
        if real is not None:
            e = np.where(real, e, _f(-1e9))
        e = np.exp(e - e.max(axis=0))
        if real is not None:
            e *= real
        a = e / np.maximum(e.sum(axis=0), _f(1e-9))
        pooled = np.concatenate([np.einsum("tn,tnh->nh", a, states[s]) for s in "fb"], axis=1)
        if cache is not None:
            cache |= {"states": np.concatenate([states["f"], states["b"]], axis=2), "att": att, "a": a, "pooled": pooled}
        return pooled @ p["wo"] + p["bo"][0]

    def _for_exp(self, projected: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Gate inputs as rows (update, reset, candidate units) over words, with the factors of :func:`step`, then the states that a word gives as the first of a window."""
        factor, out = np.array([-1, -1, 2], _f)[:, None, None], {}
        for s, v in projected.items():
            rows = np.empty((4 * HIDDEN, v.shape[1]), _f)
            rows[:3 * HIDDEN] = (v * factor).swapaxes(1, 2).reshape(3 * HIDDEN, -1)
            z, c, h = rows[:HIDDEN], rows[2 * HIDDEN:3 * HIDDEN], rows[3 * HIDDEN:]
            with np.errstate(over="ignore"):
                h[:] = (1 - 2 / (1 + np.exp(c))) * (1 - 1 / (1 + np.exp(z)))
            out[s] = rows
        return out

    def _weights(self) -> dict[str, np.ndarray]:
        """Weights of the states, with the factors of :meth:`_for_exp`."""
        return {s: np.ascontiguousarray(self.p[f"u{s}"].T) * np.repeat(np.array([-1, -1, 2], _f), HIDDEN)[:, None] for s in "fb"}

    def _pool(self, seen: np.ndarray, out: np.ndarray, rough: bool = False) -> np.ndarray:
        """The exponents of attention, but for what is the same for all words, to ``out``; ``seen`` are the products of :meth:`_heads` with twice the bias, of which it takes the first as room."""
        att = exponentials(seen[:ATTEND], rough)
        att += _f(1)
        np.reciprocal(att, out=att)
        return np.matmul(-2 * self.p["va"], att.reshape(ATTEND, -1), out=out.reshape(-1))

    def _heads(self) -> np.ndarray:
        """Twice the attention's weights, and the logit's, of both directions' states: one product a step gives both."""
        return np.concatenate([2 * self.p["wa"].T, self.p["wo"][None]])

    def _slide(self, inputs, n: int, states: np.ndarray) -> np.ndarray:
        """Logits of ``n`` whole windows: :meth:`forward` with windows side by side in memory.

        ``inputs(direction, k)`` are the gate inputs of their k-th words, ``states`` is room to work in.
        """
        weights, g = self._weights(), np.empty((3 * HIDDEN, n), _f)
        for d, (s, order) in enumerate((("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1)))):
            h = np.zeros((HIDDEN, n), _f)
            for k in order:
                h = step(weights[s], inputs(s, k), h, g, states[k, d * HIDDEN:(d + 1) * HIDDEN])
        # The 1 of a tanh adds the same to all of a window's e.
        heads, e, gives, seen = self._heads(), np.empty((WINDOW, n), _f), np.empty((WINDOW, n), _f), np.empty((ATTEND + 1, n), _f)
        twice = 2 * self.p["ba"][:, None]
        for k in range(WINDOW):
            np.matmul(heads, states[k], out=seen)
            seen[:ATTEND] += twice
            self._pool(seen, e[k])
            gives[k] = seen[ATTEND]
        e -= e.max(axis=0)
        np.exp(e, out=e)
        gives *= e
        return gives.sum(axis=0) / e.sum(axis=0) + self.p["bo"][0]

    def _meet(self, rows: dict[str, np.ndarray], words: np.ndarray, met: float, rough: bool) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the whole windows at all words of a stream, and which of these windows are unmet (their logits are of no use).

        The stream has whole pieces of ``_PIECE`` windows, which lie side by side in memory.  In each the network reads on through
        all words.  A window's own states are read until they have met those (by ``met``), which stand for its further words.
        """
        pieces, long, h_ = (len(words) - WINDOW + 1) // _PIECE, _PIECE + WINDOW - 1, HIDDEN
        words = words[np.arange(long)[:, None] + np.arange(pieces) * _PIECE].ravel()
        weights, heads, twice = self._weights(), {s: np.ascontiguousarray(v) for s, v in zip("fb", np.split(self._heads(), 2, axis=1))}, 2 * self.p["ba"][:, None]
        if rough:
            weights, twice = {s: v * _f(_SLOPE) for s, v in weights.items()}, twice * _f(_SLOPE) + _f(_BASE)
            for v in heads.values():
                v[:ATTEND] *= _f(_SLOPE)
        stream, on, given, g = {}, {}, {}, np.empty((3 * h_, pieces), _f)
        for s in "fb":
            stream[s], on[s], h = np.take(rows[s], words, axis=1), np.empty((h_, len(words)), _f), np.zeros((h_, pieces), _f)
            for k in range(long) if s == "f" else range(long - 1, -1, -1):
                at = slice(k * pieces, (k + 1) * pieces)
                h = step(weights[s], stream[s][:, at], h, g, on[s][:, at], rough)
            given[s] = heads[s] @ on[s]
            given[s][:ATTEND] += twice
        both = given["f"] + given["b"]
        both[:ATTEND] -= twice
        e = np.empty(len(words), _f)
        self._pool(both, e, rough)
        np.exp(e, out=e)
        both[ATTEND] *= e
        pooled, sums = np.stack([e, both[ATTEND]]).reshape(2, long, pieces), {}
        about, open_ = np.zeros((_PIECE, pieces), _f), np.ones((_PIECE, pieces), bool)
        side = max(1, _SIDE // pieces)
        n = side * pieces
        g, seen, e, gap, room = np.empty((3 * h_, n), _f), np.empty((ATTEND + 1, n), _f), np.empty(n, _f), np.empty((h_, n), _f), np.empty((2, h_, n), _f)
        for i in range(0, _PIECE, side):
            m = min(side, _PIECE - i) * pieces
            done = self._side(stream, on, given, weights, heads, met, rough, i * pieces, pieces, g[:, :m], seen[:, :m], e[:m], gap[:, :m], room[:, :, :m])
            if done is None:
                continue
            total, own, unmet = done
            left = WINDOW - own["f"] - own["b"]
            if left:
                if left not in sums:
                    sums[left] = runs(pooled.swapaxes(1, 2), left).swapaxes(1, 2)
                total += sums[left][:, i + own["f"]:i + own["f"] + m // pieces].reshape(2, -1)
            about[i:i + side] = (total[1] / total[0] + self.p["bo"][0]).reshape(-1, pieces)
            open_[i:i + side] = unmet.reshape(-1, pieces)
        return about.T.ravel(), open_.T.ravel()

    def _side(self, stream: dict[str, np.ndarray], on: dict[str, np.ndarray], given: dict[str, np.ndarray], weights: dict[str, np.ndarray], heads: dict[str, np.ndarray], met: float, rough: bool, first: int, pieces: int, g: np.ndarray, seen: np.ndarray, e: np.ndarray, gap: np.ndarray, room: np.ndarray):
        """Of the windows from ``first`` on, for :meth:`_meet`: the sums of attention and of logits over the words read by own states, how many these are, and which windows are unmet.  None: too many."""
        n = len(e)
        total, unmet, left, own = np.zeros((2, n), _f), np.zeros(n, bool), WINDOW, {}
        for s in "fb":
            other, part = given["b" if s == "f" else "f"], 1.0
            for i in range(left):
                k = i if s == "f" else WINDOW - 1 - i
                at = slice(first + k * pieces, first + k * pieces + n)
                h = step(weights[s], stream[s][:, at], h, g, room[i % 2], rough) if i else stream[s][3 * HIDDEN:, at]
                np.matmul(heads[s], h, out=seen)
                seen += other[:, at]
                self._pool(seen, e, rough)
                np.exp(e, out=e)
                total[0] += e
                e *= seen[ATTEND]
                total[1] += e
                if i < 3:
                    continue
                np.subtract(h, on[s][:, at], out=gap)
                apart, before = np.abs(gap, out=gap).max(axis=0) > met, part
                part = np.count_nonzero(apart) / n
                if part <= _FEW or part <= _MANY and before - part <= _LESS:
                    break
            if part > _MANY:
                return None
            own[s], unmet = i + 1, unmet | apart
            left -= own[s]
            if left < 6 and s == "f":
                return None
        return total, own, unmet

    def _whole(self, rows: dict[str, np.ndarray], inverse: np.ndarray, at: np.ndarray, low: float = -np.inf, high: float = np.inf) -> np.ndarray:
        """The strongest logit of the whole windows of each text; every text has one.

        All windows are scored by :meth:`_meet` first.  Then the strongest of each text is read in full, and one of ``_CHECK`` as a check,
        then those that are unmet and those within 2 * NEAR of their text's strongest, and the strongest read in full counts.  Where the two
        ways differ by more than NEAR / 2, or states do not meet, all windows are read in full.

        With ``low`` and ``high``, logits below ``low``, and those from ``high`` on, are not told apart.  Then states need to meet roughly
        only.  A text with a logit of ``high`` or more is settled, and one whose met windows are below ``low`` by ROUGH_NEAR at least and
        whose unmet ones, read in full, are below ``low`` too; all others are gone through again without these limits.
        """
        last, block = len(inverse) - WINDOW + 1, _PIECES * _PIECE
        rough = low > -np.inf
        met, near = (ROUGH_MET, ROUGH_NEAR) if rough else (MET, NEAR)
        begin, end = at[:-1], at[1:] - WINDOW + 1  # of windows
        about, open_ = np.full(last, -np.inf, _f), np.ones(last, bool)
        meets = float(np.abs(self.p["va"]).sum()) < 40  # its exp needs no shift
        inputs = {s: np.concatenate([v[:3 * HIDDEN] * _f(_SLOPE) + _f(_BASE), v[3 * HIDDEN:]]) for s, v in rows.items()} if rough else rows
        for i in range(0, last if meets else 0, block):
            n = min(block, last - i)
            words = inverse[i:i + n + WINDOW - 1]
            words = np.append(words, np.zeros(-n % _PIECE, words.dtype))
            with np.errstate(over="ignore"):
                each, unmet = self._meet(inputs, words, met, rough)
            about[i:i + n], open_[i:i + n] = each[:n], unmet[:n]
        window, text = ragged(begin, end - begin), np.repeat(np.arange(len(begin)), end - begin)
        about, open_, starts = about[window], open_[window], np.concatenate([[0], np.cumsum(end - begin)[:-1]])
        about[open_] = -np.inf
        top = np.maximum.reduceat(about, starts)
        exact = np.full(len(window), -np.inf, _f)

        def read(chosen: np.ndarray) -> bool:
            """Reads windows in full; False where one is not as near as was taken."""
            exact[chosen] = self._full(rows, inverse, window[chosen])
            sure = chosen[~open_[chosen]]
            return not np.any(np.abs(exact[sure] - about[sure]) > near / 2)

        strongest = np.flatnonzero(about == top[text])
        strongest = strongest[np.flatnonzero(np.diff(text[strongest], prepend=-1))]
        chosen = np.zeros(len(window), bool)
        chosen[strongest] = chosen[::_CHECK] = True
        right = read(np.flatnonzero(chosen))
        if rough:
            again = np.ones(len(begin), bool)
            if right:
                settled, quiet = np.maximum.reduceat(exact, starts) >= high, top + near < low
                read(np.flatnonzero(~chosen & open_ & (quiet & ~settled)[text]))
                best = np.maximum.reduceat(exact, starts)
                again = ~settled & ~(quiet & (best < low)) & (best < high)
            if again.any():
                size = np.diff(at)[again]
                best = np.full(len(begin), -np.inf, _f) if not right else best
                best[again] = self._whole(rows, inverse[ragged(at[:-1][again], size)], np.concatenate([[0], np.cumsum(size)]))
            return best
        if right:
            right = read(np.flatnonzero(~chosen & (open_ | (about >= top[text] - _f(2 * near)))))
        if not right:
            read(np.arange(len(window)))
        return np.maximum.reduceat(exact, starts)

    def _full(self, rows: dict[str, np.ndarray], inverse: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Logits of the whole windows from the words ``first`` on, each read in full."""
        out, states = np.empty(len(first), _f), np.empty((WINDOW, 2 * HIDDEN, min(_STREAM, len(first))), _f)
        for i in range(0, len(first), _STREAM):
            here = first[i:i + _STREAM]
            with np.errstate(over="ignore"):
                out[i:i + len(here)] = self._slide(lambda s, k: np.take(rows[s][:3 * HIDDEN], inverse[here + k], axis=1), len(here), states[:, :, :len(here)])
        return out

    def backward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, cache: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters, and of the word vectors."""
        p, h_, g = self.p, HIDDEN, {}
        states, att, a, pooled = (cache[k] for k in ("states", "att", "a", "pooled"))
        g["wo"], g["bo"] = pooled.T @ d_logit, np.array([d_logit.sum()], _f)
        d_pooled = d_logit[:, None] * p["wo"]
        d_states = a[:, :, None] * d_pooled
        d_a = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["va"] = np.einsum("tn,tnk->k", d_e, att)
        d_att = d_e[:, :, None] * p["va"] * (1 - att * att)
        g["wa"], g["ba"] = np.einsum("tnh,tnk->hk", states, d_att), d_att.sum(axis=(0, 1))
        d_states = d_states + d_att @ p["wa"].T
        d_x = np.zeros_like(x)
        for s in "fb":
            u, w = p[f"u{s}"], p[f"w{s}"]
            d_u, carry = np.zeros_like(u), np.zeros((len(index), h_), _f)
            d_projected = np.zeros((len(x), 3 * h_), _f)
            part = slice(0, h_) if s == "f" else slice(h_, None)
            seen, flow = [], []
            for k, h, z, r, c, hn in reversed(cache[s]):
                m = mask[:, k, None]
                d = d_states[k, :, part] + carry
                d_new, skip = d * m, d * (1 - m)
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (h - c) * z * (1 - z)
                d_r = d_c * hn * r * (1 - r)
                d_h = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_u += h.T @ d_h
                carry = d_new * z + skip + d_h @ u.T
                seen.append(index[:, k])
                flow.append(np.concatenate([d_z, d_r, d_c], axis=1))
            flow, seen = np.concatenate(flow), np.concatenate(seen)
            for k in range(3 * h_):
                d_projected[:, k] = np.bincount(seen, flow[:, k], len(x))
            g[f"u{s}"], g[f"w{s}"], g[f"c{s}"] = d_u, x.T @ d_projected, d_projected.sum(axis=0)
            d_x += d_projected @ w.T
        return g, d_x

    def window_logits(self, x: np.ndarray, w: Words, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logits of any windows, in blocks of bounded size."""
        projected, step, out = self.projections(x), np.arange(WINDOW), np.empty(len(first), _f)
        for i in range(0, len(first), _BLOCK):
            k = slice(i, i + _BLOCK)
            index = w.inverse[np.minimum(first[k, None] + step, len(w.inverse) - 1)]
            out[k] = self.forward(x, index, (step < size[k, None]).astype(_f), projected=projected)
        return out

    def logits(self, w: Words, low: float = -np.inf, high: float = np.inf) -> np.ndarray:
        """The strongest window's logit of each text of a chunk, in blocks of bounded size; see :meth:`_whole` for ``low`` and ``high``."""
        x = self.vectors(w)
        projected, count = self.projections(x), np.diff(w.at)
        out = np.full(len(count), -np.inf, _f)
        whole = np.flatnonzero(count >= WINDOW)
        if len(whole):
            words = ragged(w.at[whole], count[whole])
            out[whole] = self._whole(self._for_exp(projected), w.inverse[words], np.concatenate([[0], np.cumsum(count[whole])]), low, high)
        short = np.flatnonzero(count < WINDOW)
        step, inverse = np.arange(WINDOW), w.inverse if len(w.inverse) else np.zeros(1, np.int64)
        for i in range(0, len(short), _BLOCK):
            k = short[i:i + _BLOCK]
            index = inverse[np.minimum(w.at[k, None] + step, len(inverse) - 1)]
            out[k] = self.forward(x, index, (step < count[k, None]).astype(_f), projected=projected)
        return out

    def scores(self, w: Words) -> np.ndarray:
        """Rounded, as single-precision sums depend on how many texts are worked on together."""
        # Logits that give 0, or 1, for sure need not be told apart.
        limits = ((-SURE - self.shift) / self.scale, (SURE - self.shift) / self.scale) if self.scale > 0 else ()
        return np.round(1 / (1 + np.exp(-(self.scale * self.logits(w, *limits).astype(np.float64) + self.shift))), DECIMALS)


def train(texts: list[str], labels: np.ndarray, share: float, seed: int = 1) -> Network:
    """A network fitted to whole texts; ``share`` is the share of toxic texts to calibrate to."""
    net, rng = Network(seed), np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    columns = [pa.array([t]) for t in texts]
    step_no, span = 0, np.arange(WINDOW)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            some = order[i:i + BATCH]
            column = pa.concat_arrays([columns[k] for k in some])
            for _, _, data, offsets in text_chunks(column, 1 << 30):
                w = read_words(data, offsets)
            if not len(w.inverse):
                continue
            x = net.vectors(w)
            first, size, text = windows(w.at)
            if len(first) > STRONGEST and np.bincount(text).max() > STRONGEST:
                strength = net.window_logits(x, w, first, size)
                order_in = np.lexsort((-strength, text))
                place = np.arange(len(text)) - np.searchsorted(text, text)
                strong = np.sort(order_in[place < STRONGEST])
                first, size, text = first[strong], size[strong], text[strong]
            index = w.inverse[np.minimum(first[:, None] + span, len(w.inverse) - 1)]
            mask = (span < size[:, None]).astype(_f)
            cache: dict = {}
            logit = net.forward(x, index, mask, cache)
            # A text is toxic if a window is: soft maximum over its windows.
            bounds = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            top = np.maximum.reduceat(logit, bounds)
            e = np.exp(logit - top[text])
            total = np.add.reduceat(e, bounds)
            whole = top + np.log(total)
            d_whole = (1 / (1 + np.exp(-whole)) - labels[some]) / len(some)
            d_logit = (d_whole[text] * e / total[text]).astype(_f)
            g, d_x = net.backward(x, index, mask, cache, d_logit)
            g["word"], g["pair"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["pair"])
            n = np.diff(w.pair_at)
            d_made = np.repeat(d_x[:, WORD_DIM:] / n[:, None].astype(_f), n, axis=0)
            for k in range(WORD_DIM):
                g["word"][:, k] = np.bincount(w.bucket, d_x[:, k], WORD_BUCKETS)
            for k in range(PAIR_DIM):
                g["pair"][:, k] = np.bincount(w.pair, d_made[:, k], PAIR_BUCKETS)
            step_no += 1
            rate = RATE * min(1.0, step_no / 30) * (1 - 0.8 * epoch / EPOCHS)
            norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
            clip = min(1.0, 1.0 / (norm + 1e-9))
            for k, v in g.items():
                v = v * _f(clip)
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                net.p[k] -= (rate * (m1[k] / (1 - 0.9 ** step_no)) / (np.sqrt(m2[k] / (1 - 0.99 ** step_no)) + 1e-7)).astype(_f)
    net.scale, net.shift = _calibrate(net, texts, labels, share)
    return net


def _calibrate(net: Network, texts: list[str], labels: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic regression of the label on the text's logit, weighted to the share of toxic texts."""
    logit = np.concatenate([net.logits(read_words(data, offsets)) for _, _, data, offsets in text_chunks(pa.array(texts), 1 << 20)]).astype(np.float64)
    weight = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-(a * logit + b)))
        g = np.array([np.sum(weight * (q - labels) * logit) + 1e-3 * (a - 1), np.sum(weight * (q - labels))])
        c = weight * np.maximum(q * (1 - q), 1e-6)
        hess = np.array([[np.sum(c * logit * logit) + 1e-3, np.sum(c * logit)], [np.sum(c * logit), np.sum(c)]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    return float(max(a, 0.05)), float(b)


# ---------------------------------------------------------------- on Spark

def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", folds: int = FOLDS, rows: int = TRAIN_ROWS) -> Network:
    """Train on a bounded sample of the labelled rows outside fold 0."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key, folds) != 0)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    total = {int(r["y"]): int(r["count"]) for r in usable.groupBy("y").count().collect()}
    share = total.get(1, 0) / sum(total.values()) if total else 0.5
    # About twice the rows wanted, by hash, as texts may be missing.
    draw, million = F.pmod(F.xxhash64(key, F.lit(23)), F.lit(1_000_000)), 1_000_000
    drawn = {y: min(million, int(2.0 * million * rows / n)) for y, n in total.items()}
    chosen = usable.where(draw < F.when(F.col("y") == 1, drawn.get(1, 0)).otherwise(drawn.get(0, 0)))  # 4 * rows at most, but for chance
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(key, whole.alias("text")).join(F.broadcast(chosen), key)
    found = found.select("y", "text", F.xxhash64(key, F.lit(29)).alias("o"), F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    # Copies of a text are counted; of each label the first texts in order reach the driver, several times as many as are taken.
    counted = stash(found.groupBy("y", "o", "h").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")))
    groups = [r for y in total for r in counted.where(F.col("y") == y).orderBy("o", "h").limit(8 * rows).collect()]
    kept = _within([r.asDict() for r in groups], rows, TRAIN_BYTES)
    if {y for y, _, _, _ in kept} != {0, 1}:
        return constant(share)
    wanted = docs.sparkSession.createDataFrame(kept, "y int, o long, h long, times long")
    texts = found.join(F.broadcast(wanted), ["y", "o", "h"]).groupBy("y", "o", "h").agg(F.max("times").alias("times"), F.min("text").alias("text")).toArrow().to_pylist()
    texts = sorted((r for r in texts for _ in range(r["times"])), key=lambda r: (r["o"], r["text"]))
    net = train([r["text"] for r in texts], np.array([r["y"] for r in texts], _f), share)
    del texts
    trim()
    return net


def _within(found: list[dict], rows: int, size: int) -> list[tuple[int, int, int, int]]:
    """(label, order, hash, copies) of the texts to learn from: in order, while ``rows`` and ``size`` bytes of each label last."""
    out, used, left = [], {0: 0, 1: 0}, {0: size, 1: size}
    for r in sorted(found, key=lambda r: (r["o"], r["h"])):
        y = r["y"]
        take = min(r.get("copies", 1), rows - used[y], left[y] // r["n"] if r["n"] else rows)
        if take > 0:
            used[y], left[y] = used[y] + take, left[y] - take * r["n"]
            out.append((y, r["o"], r["h"], take))
    return out


def constant(share: float) -> Network:
    """A network whose score is ``share`` for every text."""
    net = Network()
    net.scale, net.shift = 0.0, float(np.clip(np.log(max(share, 1e-30) / max(1 - share, 1e-30)), -60, 60))
    return net


def score(docs: DataFrame, net: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``keep`` and score (0 to 1) of every whole text; ``keep`` may hold the text itself (``with_text``)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    read = [*keep] if with_text else [*keep, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(read.index(text)), 1 << 20):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(keep))), pa.array(net.scores(read_words(data, offsets)))], names=[*keep, "score"])

    return docs.select(*read).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double")


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted of every document."""
    docs = docs.select(key, "text", (fold(key, FOLDS) == 0).alias("held_out"))
    done = score(docs, fit(docs, labels, key=key), keep=(key, "held_out"))
    return done.select(key, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
