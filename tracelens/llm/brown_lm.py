"""Brown class-based bigram model: exchange clustering, and perplexity of whole texts.

Every word belongs to a class; a token's probability is P(class | class before) times
P(word | class), interpolated with an additively smoothed unigram model.

* Counts of all words come from all training texts, by hash of the word.
* The ``CLUSTERED`` most frequent words (ties at the border stay out) start as units of their
  own, all others as ``ENDINGS`` units by their last two bytes.  Unit bigrams are counted over
  all training texts and stay a distributed table.  In a round of the exchange algorithm Spark
  sums them to unit-by-class counts for the current classes (units x 2 classes, a fixed size);
  then each unit moves to the class with the largest gain of the bigram likelihood.
* Then every other word of the training texts, however rare, leaves its unit and moves by the
  same gain to a class of its own, from the classes of all its neighbours.  These words stay
  distributed; their counts are small beside those of classes, so the gain is taken to first
  order.  Endings only serve words that training texts don't have.
* Words emit by absolute discounting: a class gives what it saves to words unseen in it.
* Transitions are counted over all training texts.  As the class before a token, a word beyond
  the ``LOOKUP`` most frequent counts by its ending; it is emitted by its own class.
* Scoring broadcasts counts and classes of the ``LOOKUP`` most frequent words; occurrences of
  others are joined with the whole table.

Defined results: null texts are empty and consist of the end token; lower-casing covers
A to Z; repeated rows count as often as they occur; an empty training set gives every
token the uniform base probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, SpanHash, discard, fold, release, stash, text_chunks, trim, word_spans

CLASSES, CLUSTERED, ENDINGS, LOOKUP = 48, 8192, 1024, 1 << 17
ROUNDS = 8
#: Weight of the class model, absolute discount, weight of class frequencies in transitions.
CLASS_WEIGHT, DISCOUNT, TRANSITION_PRIOR = 0.97, 0.5, 5.0
#: Additive smoothing of the base model.
ADD = 0.1
#: Training texts are those whose crc32(id) modulo this is not 0.
FOLDS = 10
#: Hash of the end token.
END = 0x0DDC0FFEE0DDF00D


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts with the end token after each, offsets, and hashes of the words' last two bytes."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = SpanHash(data).spans(starts, ends)
    n = len(offsets) - 1
    at = first + np.arange(n + 1)
    place = np.ones(at[-1], bool)
    place[at[1:] - 1] = False
    out = np.full(at[-1], END, np.uint64)
    out[place] = words
    tail = np.zeros(at[-1], np.uint32)
    last = data[ends - 1].astype(np.uint32)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint32)
    tail[place] = ((before << np.uint32(8) | last) * np.uint32(2654435761)) >> np.uint32(22)
    return out, at, tail.astype(np.int64) % ENDINGS


class HashTable:
    """Whole numbers by 64-bit hash: open addressing, looked up as arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.values, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool)
        left, slot = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(left):
            free = ~self.used[slot]
            _, once = np.unique(slot[free], return_index=True)
            mine = np.flatnonzero(free)[once]
            self.keys[slot[mine]], self.values[slot[mine]], self.used[slot[mine]] = keys[left[mine]], values[left[mine]], True
            rest = np.ones(len(left), bool)
            rest[mine] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        slot = (keys >> self.shift).astype(np.int64)
        hit = self.used[slot] & (self.keys[slot] == keys)
        out = np.where(hit, self.values[slot], missing)
        open_ = np.flatnonzero(self.used[slot] & ~hit)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            s = slot[open_]
            hit = self.used[s] & (self.keys[s] == keys[open_])
            out[open_[hit]] = self.values[s[hit]]
            open_ = open_[self.used[s] & ~hit]
        return out


# ---------------------------------------------------------------- counts

def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (hash), c: how often every word, and the end token, occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), 1 << 21):
                word, c = np.unique(tokens(data, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c)], names=["word", "c"])

    return docs.select(text).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, at most ``most`` of them: a whole number of count ranges."""
    rank = F.floor(F.log2("c") * 16).cast("int")
    sizes = counts.groupBy(rank.alias("r")).count().collect()  # at most 16 * 63 rows
    least, total = 1 << 30, 0
    for r, n in sorted(sizes, reverse=True):
        if total + n > most:
            break
        least, total = r, total + n
    rows = counts.where(rank >= least).toArrow()
    word, c = rows.column("word").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.lexsort((word, -c))
    return word[order], c[order]


def unit_bigrams(docs: DataFrame, units: tuple[np.ndarray, int], text: str = "text") -> DataFrame:
    """u, v, n: how often unit v follows unit u; the end token comes before each text too."""
    words, size = units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashTable(words, np.arange(len(words)))
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), 1 << 21):
                word, at, tail = tokens(data, offsets)
                unit = table.get(word, -1)
                unit = np.where(unit < 0, len(words) + tail, unit)
                end = unit[-1] if len(unit) else 0
                before = np.empty_like(unit)
                before[1:] = unit[:-1]
                before[at[:-1]] = end
                pair, n = np.unique(before * size + unit, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((pair // size).astype(np.int32)), pa.array((pair % size).astype(np.int32)), pa.array(n)], names=["u", "v", "n"])

    return docs.select(text).mapInArrow(run, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- exchange clustering

def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(right: np.ndarray, left: np.ndarray, own: np.ndarray, classes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """One round: each unit, most frequent first, moves to its best class.

    ``right[w, c]``: how often class c follows unit w; ``left[w, c]``: precedes it; ``own[w]``:
    w follows itself.  Class counts follow the moves; the units' counts are those of the
    round's beginning.  The likelihood is the sum of N log N over class pairs, less the sums
    over the classes' margins.
    """
    pairs = np.zeros((k, k))
    np.add.at(pairs, classes, right)
    out, moved = classes.copy(), 0
    weight = right.sum(axis=1) + left.sum(axis=1)
    margin_r, margin_l = right.sum(axis=1), left.sum(axis=1)
    row, col = pairs.sum(axis=1), pairs.sum(axis=0)
    everything = np.arange(k)
    for w in np.argsort(-weight, kind="stable"):
        if not weight[w]:
            break
        a = out[w]
        r, l, s = right[w].copy(), left[w].copy(), own[w]
        # Without w: what it contributes beside its own bigram leaves row and column a.
        r[classes[w]] -= s
        l[classes[w]] -= s
        base = pairs.copy()
        base[a] -= r
        base[:, a] -= l
        base[a, a] -= s
        np.maximum(base, 0, out=base)
        rows, cols = row.copy(), col.copy()
        rows[a] -= margin_r[w]
        cols[a] -= margin_l[w]
        # With w in b, for all b at once.
        gain = (_xlogx(base + r) - _xlogx(base)).sum(axis=1) + (_xlogx(base.T + l) - _xlogx(base.T)).sum(axis=1)
        diagonal = base[everything, everything]
        gain += _xlogx(diagonal + r + l + s) - _xlogx(diagonal + r) - _xlogx(diagonal + l) + _xlogx(diagonal)
        gain -= _xlogx(np.maximum(rows + margin_r[w], 0)) - _xlogx(np.maximum(rows, 0)) + _xlogx(np.maximum(cols + margin_l[w], 0)) - _xlogx(np.maximum(cols, 0))
        b = int(np.argmax(gain))
        if b != a and gain[b] > gain[a] + 1e-9 * abs(gain[a]):
            out[w], moved = b, moved + 1
            base[b] += r
            base[:, b] += l
            base[b, b] += s
            pairs = base
            row, col = rows, cols
            row[b] += margin_r[w]
            col[b] += margin_l[w]
    return out, moved


def unit_class_counts(bigrams: DataFrame, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """right and left of :func:`exchange` for these classes; Spark sums, units x classes cells come back."""
    of = F.expr(f"cast(split('{','.join(map(str, classes))}', ',') as array<int>)")
    size = len(classes)
    out = []
    for unit, other in (("u", "v"), ("v", "u")):
        rows = bigrams.groupBy(F.col(unit).alias("w"), F.get(of, F.col(other)).alias("c")).agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros((size, k))
        table[rows.column("w").to_numpy(), rows.column("c").to_numpy()] = rows.column("n").to_numpy()
        out.append(table)
    return out[0], out[1]


def other_words(docs: DataFrame, words: np.ndarray, classes: np.ndarray, pairs: np.ndarray, text: str = "text") -> DataFrame:
    """word, tail, c, class of all words outside ``words``: each in the class that gains most from its neighbours.

    With b's transitions kept, n tokens more in class b change the likelihood by the sum of
    log P(class after | b) over the classes after them, and of log P(b | ..) turned round over those before.
    """
    k = len(pairs)
    size = ENDINGS * k * k
    after = np.log((pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * k))  # [b, class after]
    before = np.log((pairs + 0.5) / (pairs.sum(axis=0, keepdims=True) + 0.5 * k))  # [class before, b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashTable(words, np.arange(len(words)))
        end = classes[table.get(np.array([END], np.uint64), 0)[0]]
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), 1 << 21):
                word, at, tail = tokens(data, offsets)
                unit = table.get(word, -1)
                cls = classes[np.where(unit < 0, len(words) + tail, unit)]
                mine = np.flatnonzero(unit < 0)  # the end token is never one of them, so each has a word after it
                distinct, number = np.unique(word[mine], return_inverse=True)
                # The word's ending and its neighbours' classes in one number.
                info, n = np.unique(number * size + (tail[mine] * k + _before(cls, at, end)[mine]) * k + cls[mine + 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct[info // size].view(np.int64)), pa.array((info % size).astype(np.int32)), pa.array(n.astype(np.int32))], names=["word", "info", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(rows: pa.Table) -> pa.RecordBatch:
            word, info, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("word", "info", "n"))
            distinct, first, number = np.unique(word, return_index=True, return_inverse=True)
            left, right = (np.bincount(number * k + x, n, len(distinct) * k).reshape(-1, k) for x in (info // k % k, info % k))
            best = np.argmax(left @ before + right @ after.T, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(distinct), pa.array((info[first] // (k * k)).astype(np.int16)), pa.array(left.sum(axis=1).astype(np.int64)), pa.array(best.astype(np.int32))], names=["word", "tail", "c", "class"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size > 1 << 15:
                rows = pa.Table.from_batches(held)
                word = rows.column("word").to_numpy()
                cut = int(np.searchsorted(word, word[-1]))  # the last word may go on
                if cut:
                    yield settle(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
                    size = rows.num_rows - cut
        if held:
            yield settle(pa.Table.from_batches(held))
        trim()

    # Summed first, a word has at most k x k rows, however often it occurs.
    rows = docs.select(text).mapInArrow(run, "word long, info int, n int").groupBy("word", "info").agg(F.sum("n").alias("n"))
    parted = rows.repartition("word").sortWithinPartitions("word")
    return parted.mapInArrow(choose, "word long, tail short, c long, class int")


def class_pairs(docs: DataFrame, known: tuple[np.ndarray, np.ndarray], endings: np.ndarray, k: int, text: str = "text") -> np.ndarray:
    """How often a class follows another, over all texts; ``known``: words and their classes, others go by ending."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = HashTable(*known), np.zeros(k * k, np.int64)
        end = table.get(np.array([END], np.uint64), 0)[0]
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), 1 << 21):
                word, at, tail = tokens(data, offsets)
                cls = table.get(word, -1)
                cls = np.where(cls < 0, endings[tail], cls)
                total += np.bincount(_before(cls, at, end) * k + cls, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total)], names=["p", "n"])

    rows = docs.select(text).mapInArrow(run, "p int, n long").groupBy("p").agg(F.sum("n").alias("n")).toArrow()  # k * k rows
    out = np.zeros(k * k)
    out[rows.column("p").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(k, k)


def _before(cls: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """The class before each token; the end token's before a text."""
    out = np.empty_like(cls)
    out[1:] = cls[:-1]
    out[at[:-1]] = end
    return out


@dataclass
class Model:
    """Arrays of fixed size; all words with count and class stay in ``table`` (word, c, class)."""

    table: DataFrame
    total: int
    distinct: int
    lookup: tuple[np.ndarray, np.ndarray, np.ndarray]  # most frequent words: hash, count, class
    endings: np.ndarray  # class of unseen words, by ending
    transition: np.ndarray  # P(class | class before)
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def base_total(self) -> float:
        return self.total + ADD * (self.distinct + 1)


def train(docs: DataFrame, text: str = "text", k: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """Counts and classes from all of ``docs``."""
    spark = docs.sparkSession
    counts = stash(word_counts(docs, text))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words, _ = most_frequent(counts, CLUSTERED)
    words = np.unique(np.append(words, np.uint64(END)))  # the end token is always a unit of its own
    size = len(words) + ENDINGS
    bigrams = stash(unit_bigrams(docs, (words, size), text))
    release(spark)
    repeats = bigrams.where("u = v").toArrow()
    own = np.zeros(size)
    own[repeats.column("u").to_numpy()] = repeats.column("n").to_numpy()
    classes = np.random.default_rng(3).integers(0, k, size)
    for _ in range(rounds):
        right, left = unit_class_counts(bigrams, classes, k)
        classes, moved = exchange(right, left, own, classes, k)
        if moved <= size // 500:
            break
    right, _ = unit_class_counts(bigrams, classes, k)
    discard(bigrams)
    pairs = np.zeros((k, k))
    np.add.at(pairs, classes, right)
    rest = stash(other_words(docs, words, classes, pairs, text))
    release(spark)
    units = spark.createDataFrame([(int(w), int(c)) for w, c in zip(words.view(np.int64), classes)], "word long, class int")  # CLUSTERED + 1 rows
    table = stash(rest.select("word", "c", "class").unionByName(counts.join(F.broadcast(units), "word").select("word", "c", "class")))
    # Endings of unseen words: the class that most rare words of that ending went to.
    endings = classes[len(words):].copy()
    votes = rest.groupBy(F.col("tail").cast("int").alias("tail"), "class").count().toArrow()  # ENDINGS x classes rows at most
    table_of = np.zeros((ENDINGS, k))
    table_of[votes.column("tail").to_numpy(), votes.column("class").to_numpy()] = votes.column("count").to_numpy()
    voted = table_of.any(axis=1)
    endings[voted] = table_of[voted].argmax(axis=1)
    sizes = table.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()  # one row a class
    class_tokens, class_words = np.zeros(k), np.zeros(k)
    for cls, c, n in sizes:
        class_tokens[cls], class_words[cls] = c, n
    _, c = most_frequent(table.select("word", "c"), LOOKUP)
    found = table.where(F.col("c") >= int(c.min())).toArrow() if len(c) else table.limit(0).toArrow()
    for x in (counts, rest):
        discard(x)
    release(spark)
    lookup = tuple(found.column(x).to_numpy() for x in ("word", "c", "class"))
    lookup = (lookup[0].view(np.uint64), lookup[1], lookup[2].astype(np.int64))
    if total and not (lookup[0] == np.uint64(END)).any():  # the end token is always known to the tasks
        end = table.where(F.col("word") == END).first()
        lookup = tuple(np.append(x, np.array([v], x.dtype)) for x, v in zip(lookup, (END, end["c"], end["class"])))
    pairs = class_pairs(docs, (lookup[0], lookup[2]), endings, k, text)
    share = pairs.sum(axis=0) / max(1.0, pairs.sum())
    transition = (pairs + TRANSITION_PRIOR * share) / (pairs.sum(axis=1, keepdims=True) + TRANSITION_PRIOR)
    return Model(table, int(total), int(distinct), lookup, endings, transition, class_tokens, class_words)


# ---------------------------------------------------------------- scoring

def _logs(count: np.ndarray, before: np.ndarray, cls: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """log10 of base and full probability for counts, classes before and classes."""
    base = (count + ADD) / model.base_total
    of_class = np.maximum(model.class_tokens, 1e-9)
    emit = np.where(count > 0, (count - DISCOUNT) / of_class[cls], DISCOUNT * model.class_words[cls] / of_class[cls])
    return np.log10(base), np.log10(CLASS_WEIGHT * model.transition[before, cls] * emit + (1 - CLASS_WEIGHT) * base)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, n_known, base_score and score (log10) of every whole text.

    A rare word's token leaves its hash, the class before it and the class of its ending; joined
    with the words' table, these give its probability.
    """
    plain = Model(None, *(getattr(model, f) for f in list(Model.__dataclass_fields__)[1:]))  # without the table, for the tasks
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    k = len(model.transition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = HashTable(plain.lookup[0], np.arange(len(plain.lookup[0])))
        counts, classes = (np.append(x, 0).astype(np.int64) for x in plain.lookup[1:])
        end = int(classes[known.get(np.array([END], np.uint64), -1)[0]])
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(len(keep))):
                word, at, tail = tokens(data, offsets)
                found = known.get(word, -1)
                here = (found >= 0) | (word == END)
                cls, count = np.where(here, classes[found], plain.endings[tail]), np.where(found >= 0, counts[found], 0)
                before = _before(cls, at, end)
                base, full = _logs(count, before, cls, plain)
                base, full = np.where(here, base, 0.0), np.where(here, full, 0.0)
                text_of = np.repeat(np.arange(j - i), np.diff(at))
                rare = np.flatnonzero(~here)
                pair = pa.array((before[rare] * k + cls[rare]).astype(np.int16))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(i, j - i) for c in range(len(keep))),
                    pa.array(row + np.arange(j - i)), pa.array(np.diff(at)),
                    pa.array(np.bincount(text_of, here & (count > 0), j - i).astype(np.int64)), pa.array(np.add.reduceat(base, at[:-1])), pa.array(np.add.reduceat(full, at[:-1])),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, at), pa.int32()), pa.StructArray.from_arrays([pa.array(word[rare].view(np.int64)), pair], names=["word", "pair"])),
                ], names=[*keep, "row", "n_tokens", "n_known", "base_score", "score", "rare"])
                row += j - i

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", row long, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:long,pair:short>>"
    local = stash(docs.select(*keep, text).mapInArrow(run, schema))
    each = local.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.pair")
    joined = each.join(model.table, "word", "left").select("row", "pair", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", F.lit(-1)).alias("cls"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, c, cls = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (1, 2, 3))
            base, own = _logs(c, pair // k, np.where(cls < 0, pair % k, cls), plain)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((c > 0).astype(np.int64)), pa.array(base), pa.array(own)], names=["row", "k", "b", "s"])

    added = joined.mapInArrow(finish, "row long, k long, b double, s double").groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    zero = F.lit(0)
    return local.drop("rare").join(added, "row", "left").select(
        *keep, "n_tokens", (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = FOLDS) -> DataFrame:
    """Train on all folds but the first and score every text: key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    docs = docs.select(key, text, (fold(key, folds) == 0).alias("held_out"))
    model = train(docs.where("not held_out"), text)
    done = score(docs, model, text, (key, "held_out"))
    return done.select(key, "held_out", "n_tokens", "n_known", F.lit(model.total).alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
