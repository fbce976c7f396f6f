"""Class-based language model: counts and base score against plain Python; classes must help."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.llm import brown_lm

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    tokens = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOW)) + [None] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    return {i: (held[i], len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def test_against_plain_counts(docs, rows, monkeypatch):
    monkeypatch.setattr(brown_lm, "LOOKUP", 64)  # so that most words need the join
    monkeypatch.setattr(brown_lm, "CLUSTERED", 100)
    want, got = plain(rows), {r["doc_id"]: r for r in brown_lm.score_documents(docs).collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4]) and r["score"] < 0


def word_numbers(text):
    """Hash and ending of each token of a text, in order."""
    import pyarrow as pa

    from tracelens.llm.textkit import text_chunks

    for _, _, data, offsets in text_chunks(pa.array([text or "x"])):
        word, _, tail = brown_lm.tokens(data, offsets)
    return ([], []) if not text else (word.view(np.int64).tolist(), tail.tolist())


def test_scores_by_brute_force(docs, rows, monkeypatch):
    """Every token's probability from the model's tables, one after the other; most words need the join."""
    monkeypatch.setattr(brown_lm, "LOOKUP", 30)
    monkeypatch.setattr(brown_lm, "CLUSTERED", 40)
    keyed = docs.select("doc_id", "text")
    train = docs.where("doc_id % 3 <> 0")
    m = brown_lm.train(train, k=6)
    known = {r["word"]: (r["c"], r["class"]) for r in m.table.collect()}
    assert len(m.lookup[0]) < 45 < len(known)
    got = {r["doc_id"]: r["score"] for r in brown_lm.score(keyed, m).collect()}
    end, frequent = known[brown_lm.END][1], set(m.lookup[0].view(np.int64).tolist())
    for r in rows:
        words, tails = word_numbers(r[1])
        words, tails = (words, tails) if words else ([brown_lm.END], [0])
        before, total = end, 0.0
        for w, t in zip(words, tails):
            c, cls = known.get(w, (0, m.endings[t]))
            emit = (c - brown_lm.DISCOUNT) / m.class_tokens[cls] if c else brown_lm.DISCOUNT * m.class_words[cls] / m.class_tokens[cls]
            total += math.log10(brown_lm.CLASS_WEIGHT * m.transition[before, cls] * emit + (1 - brown_lm.CLASS_WEIGHT) * (c + 0.1) / m.base_total)
            before = cls if w in frequent else m.endings[t]
        assert got[r[0]] == pytest.approx(total, rel=1e-9), r[0]


def test_every_word_has_a_class_of_its_own(docs, rows, monkeypatch):
    """Words outside the clustered ones: counts, and the class with the largest gain, by plain loops."""
    tokens = [word_numbers(r[1]) for r in rows]
    count = Counter(w for ws, _ in tokens for w in ws)
    top = sorted(w for w, _ in count.most_common(20)) + [brown_lm.END]
    units = np.unique(np.array(top, np.int64).view(np.uint64))
    k = 5
    classes = np.random.default_rng(1).integers(0, k, len(units) + brown_lm.ENDINGS)
    pairs = np.random.default_rng(2).integers(0, 50, (k, k)).astype(float)
    unit = {int(w): i for i, w in enumerate(units.view(np.int64))}
    of = lambda w, t: classes[unit[w]] if w in unit else classes[len(units) + t]
    gain = {}
    for ws, ts in tokens:
        for i, (w, t) in enumerate(zip(ws, ts)):
            if w in unit:
                continue
            left = of(ws[i - 1], ts[i - 1]) if i else classes[unit[brown_lm.END]]
            right = of(ws[i + 1], ts[i + 1])
            row = gain.setdefault(w, np.zeros(k))
            for b in range(k):
                row[b] += math.log((pairs[b, right] + 0.5) / (pairs[b].sum() + 0.5 * k)) + math.log((pairs[left, b] + 0.5) / (pairs[:, b].sum() + 0.5 * k))
    got = {r["word"]: r for r in brown_lm.other_words(docs, units, classes, pairs).collect()}
    assert set(got) == set(gain)
    for w, row in gain.items():
        assert got[w]["c"] == count[w] and row[got[w]["class"]] == pytest.approx(row.max())
    # Repeated rows change no class: they are summed before the choice.
    often = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40)))).repartition(16)
    again = {r["word"]: r for r in brown_lm.other_words(often, units, classes, pairs).collect()}
    assert {w: r["c"] for w, r in again.items()} == {w: 40 * r["c"] for w, r in got.items()}
    assert all(gain[w][r["class"]] == pytest.approx(gain[w].max()) for w, r in again.items())


def test_classes_find_structure(spark):
    rng = np.random.default_rng(0)
    sets = [[f"{p}{i}" for i in range(40)] for p in ("a", "b")]
    docs = [(i, " ".join(rng.choice(sets[i % 2], 60))) for i in range(120)]
    rows = brown_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").collect()
    assert rows and all(r["score"] > r["base_score"] for r in rows)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} x{i % 3} y") for i in range(40)], "doc_id long, text string")
    m = brown_lm.train(docs, k=4)
    assert np.allclose(m.transition.sum(axis=1), 1)
    known = m.table.collect()
    total = sum((r["c"] + 0.1) / m.base_total for r in known) + 0.1 / m.base_total
    assert total == pytest.approx(1)


def test_empty_table(empty):
    assert brown_lm.score_documents(empty).count() == 0


def test_hash_table():
    keys = np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    t = brown_lm.HashTable(keys, np.arange(len(keys)))
    assert (t.get(keys, -1) == np.arange(len(keys))).all() and (t.get(keys + np.uint64(1), -1) == -1).all()


def test_exchange_improves_likelihood():
    rng = np.random.default_rng(1)
    u, k = 30, 3
    big = rng.integers(0, 5, (u, u)) + 40 * (np.arange(u)[:, None] % 3 == np.arange(u) % 3)
    classes = rng.integers(0, k, u)

    def fold_(c):
        right, left = np.zeros((u, k)), np.zeros((u, k))
        for x in range(u):
            np.add.at(right[x], c, big[x])
            np.add.at(left[x], c, big[:, x])
        return right, left

    def likelihood(c):
        pairs = np.zeros((k, k))
        np.add.at(pairs, c, fold_(c)[0])
        x = lambda a: float(brown_lm._xlogx(a).sum())
        return x(pairs) - x(pairs.sum(axis=0)) - x(pairs.sum(axis=1))

    before = likelihood(classes)
    for _ in range(6):
        classes, moved = brown_lm.exchange(*fold_(classes), np.diag(big).astype(float), classes, k)
    assert likelihood(classes) > before
    assert len(set(classes[::3])) == len(set(classes[1::3])) == 1
