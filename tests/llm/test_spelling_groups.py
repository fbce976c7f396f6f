"""Spelling variants against all pairs of words."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracelens.llm import spelling_groups as S


def lower(x: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def counts(rows: list[tuple]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] = out.get(w, 0) + 1
    return {w: n for w, n in out.items() if n >= 3 and len(w) >= 5}


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(rows: list[tuple]) -> set[tuple]:
    n = counts(rows)
    friends = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(friends[w], key=lambda x: (-n[x], x.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        top = w
        while form[top]:
            top = form[top]
        out.add((w, form[w], top, n[w], len(friends[w]), n[form[w]] if form[w] else None))
    return out


def sloppy(rng: random.Random, size: int) -> list[tuple]:
    """Texts of a small vocabulary with many slips of the pen."""
    base = ["".join(rng.choice("abcdéß") for _ in range(rng.randrange(4, 10))) for _ in range(60)] + ["aaaaaa", "aaaaa", "ÀÉÎÕÜ", "x÷y×zé", "w" * 80, "w" * 79]
    def slip(w):
        if rng.random() < 0.3:
            i = rng.randrange(len(w))
            return w[:i] + rng.choice(["", "x", "é", w[i] * 2]) + w[i + 1:]
        return w
    return [(i, " ".join(rng.choice([str.upper, str, str])(slip(base[int(rng.random() ** 2 * len(base))])) for _ in range(rng.randrange(30))) + rng.choice(["", "7", "字", "!"])) for i in range(size)]


def result(df) -> set[tuple]:
    rows = [tuple(r) for r in S.spelling_groups(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def texts():
    return sloppy(random.Random(3), 700) + [(None, None), (None, "slips slips slips slips slip"), (5, ""), (5, "aaaaaa " * 2000)]


def test_all_pairs(spark, texts):
    df = spark.createDataFrame([(*r, "x", 1) for r in texts], "doc_id long, text string, word string, n long").repartition(4)
    want = expected(texts)
    assert result(df) == want and len(want) > 200 and any(r[2] != r[1] and r[1] for r in want)


def test_many_small_filters(spark, texts, monkeypatch):
    """Filters in parts, waves of one filter, and small batches give the same."""
    for name, value in (("SHARD_BYTES", 64), ("WAVE_BYTES", 64), ("HELD", 20), ("BITS", 8)):
        monkeypatch.setattr(S, name, value)
    some = texts[:150] + texts[-4:]
    assert len(S.Filters({5: 200}).waves()) > 2
    assert result(spark.createDataFrame(some, "doc_id long, text string").repartition(3)) == expected(some)


def test_no_words(spark, empty):
    assert S.spelling_groups(empty).collect() == []
    assert S.spelling_groups(spark.createDataFrame([(1, None), (2, "one two")], "doc_id long, text string")).collect() == []


def test_checksums_carry_on():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 9, 64, 65, 300]))) for _ in range(200)]
    ends = np.cumsum([len(p) for p in parts])
    prefix = np.array([zlib.crc32(b"%d:" % i) for i in range(len(parts))], np.uint32)
    got = S.crc_after(prefix, np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + p) for i, p in enumerate(parts)]


def test_edits_are_all_deletions_and_later_replacements():
    letters = np.frombuffer("abcé".encode("latin-1"), np.uint8)
    for w in ("aabbc", "aabbcc", "ééabca"):
        _, m = next(S.by_length(pa.array([w])))
        got = [h for _, _, _, hashes in S.edits(m, letters) for h in hashes.tolist()]
        each = {w[:i] + x + w[i + 1:] for i in range(len(w)) for x in "abcé" if x > w[i]}
        each |= {w[:i] + w[i + 1:] for i in range(len(w))} if len(w) > 5 else set()
        want = [S._finish(S._CODE[x] @ S._powers(x.shape[1]), x.shape[1])[0] for x in (next(S.by_length(pa.array([e])))[1] for e in each)]
        assert sorted(got) == sorted(map(int, want))
