"""Fingerprints by locally consistent parsing, against a parse in plain Python."""

import hashlib
import random

import numpy as np
import pytest

from tracelens.llm import phrase_prints as P

M = (1 << 64) - 1


def scramble(x: int) -> int:
    x &= M
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * c & M
    return x ^ x >> 33


def toss(labels: list[int]) -> list[int]:
    out = []
    for i, x in enumerate(labels):
        y = labels[i - 1] if i else x ^ 1
        k = ((x ^ y) & -(x ^ y)).bit_length() - 1
        out.append(2 * k + (x >> k & 1))
    return out


def parse(text: bytes) -> list[tuple[int, int]]:
    """(name, bytes) of all phrases, level by level, one symbol at a time."""
    level, out, rounds = [(b, 1) for b in text], [], 3
    while level:
        runs: list[list] = []
        for s, n in level:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
                runs[-1][2] += n
            else:
                runs.append([s, 1, n])
        colours = [r[0] for r in runs]
        for _ in range(rounds):
            colours = toss(colours)
        for c in (3, 4, 5):
            colours = [min({0, 1, 2} - set(colours[max(0, i - 1):i] + colours[i + 1:i + 2])) if x == c else x for i, x in enumerate(colours)]
        assert all(a != b for a, b in zip(colours, colours[1:])) and max(colours) < 3
        last = len(runs) - 1
        starts = [i for i in range(len(runs)) if i == 0 or 1 < i < last and colours[i] > max(colours[i - 1], colours[i + 1])]
        level = []
        for a, b in zip(starts, [*starts[1:], len(runs)]):
            total = sum(scramble(s + n * int(P._RUN) + (i - a) * int(P._PLACE)) for i, (s, n, _) in enumerate(runs[a:b], a))
            level.append((scramble(total), sum(r[2] for r in runs[a:b])))
        out += level
        rounds = 4
        if len(level) == 1:
            return out
    return out


def sketch(text: bytes) -> bytes:
    names = {scramble(n + int(P._SHIFT)) for n, size in parse(text) if size >= P.LEAST or size == len(text)}
    least: dict[int, int] = {}
    for h in names:
        slot, value = h >> 57, h & (1 << 57) - 1
        least[slot] = min(value, least.get(slot, M))
    if not least:
        return b""
    out = []
    for s in range(P.SLOTS):
        far = next(d for d in range(P.SLOTS) if (s + d) % P.SLOTS in least)
        out.append(scramble(least[(s + far) % P.SLOTS] + far * int(P._SHIFT)) & 255)
    return bytes(out)


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefé字") for _ in range(rng.randrange(1, 8))) for _ in range(n))


def test_parse_is_that_of_plain_python():
    rng = random.Random(2)
    texts = [b"", b"a", b"aa", b"ab", b"aba", b"abab", b"a" * 500, b"ab" * 300, "字".encode() * 90, bytes(range(256))]
    texts += [prose(rng, rng.randrange(1, 120)).encode() for _ in range(40)] + [bytes(rng.choices(range(3), k=rng.randrange(1, 60))) for _ in range(60)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    names, sizes, owners = P.phrases(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, t in enumerate(texts):
        got = list(zip(names[owners == i].tolist(), sizes[owners == i].tolist()))
        assert got == parse(t), t
    assert P.fingerprints(texts) == [sketch(t) for t in texts]
    assert P.fingerprints(texts[10:12]) == P.fingerprints(texts)[10:12]  # neighbours in a batch don't matter


def test_equal_substrings_share_interior_names():
    rng = random.Random(5)
    shared = prose(rng, 400).encode()
    for n in (0, 1, 7, 50):
        other = prose(rng, n).encode() + shared + prose(rng, n).encode()
        mine, theirs = parse(shared), {x for x, _ in parse(other)}
        small = [(x, s) for x, s in mine if s < len(shared) / 20]
        assert sum(s for x, s in small if x in theirs) > 0.9 * sum(s for _, s in small)


def test_likeness():
    rng = random.Random(6)
    a, b = (prose(rng, 600).encode() for _ in range(2))
    half = a[:len(a) // 2] + b[len(b) // 2:]
    one, two, mixed, shifted = P.fingerprints([a, b, half, b"x" + a])
    assert P.likeness(one, one) == 1 and P.likeness(one, two) < 0.1
    assert 0.2 < P.likeness(one, mixed) < 0.5 and 0.2 < P.likeness(two, mixed) < 0.5 and P.likeness(one, shifted) > 0.8
    assert P.likeness(b"", b"") == 1 and P.likeness(b"", one) == 0


def expected(rows: list[tuple]) -> list[tuple]:
    """Of (id, text) rows in order, by whole strings."""
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        h = len(text) // 2
        edited = (text[:len(text) - h] + after[:h]).encode()
        a, b, c = sketch(text.encode()), sketch(edited), sketch(after.encode())
        out.append((i, len(text), hashlib.sha256(edited).hexdigest(), a.hex(), b.hex(), P.likeness(a, b), P.likeness(a, c)))
    return out


@pytest.mark.parametrize("size", [1 << 24, 2000])
def test_documents(docs, rows, monkeypatch, size):
    """In one range and in many."""
    monkeypatch.setattr(P, "RANGE_BYTES", size)
    got = sorted(tuple(r) for r in P.fingerprint_documents(docs).collect())
    assert got == sorted(expected([(r[0], r[1] or "") for r in sorted(rows, reverse=True)]))
    assert [r[3] for r in got if r[0] in (10, 11)] == [sketch(rows[10][1].encode()).hex()] * 2


def test_repeated_rows_and_null_ids(spark, monkeypatch):
    """Copies of a row beyond the bound are counted, and each has a row all the same."""
    monkeypatch.setattr(P, "RANGE_BYTES", 3000)
    many = [(7, "the same text again and again")] * 1500
    some = [(None, None), (None, ""), (9, "before the copies"), (3, "after the copies, and the last but one"), (1, "x"), (1, "x")]
    df = spark.createDataFrame(many + some, "doc_id long, text string").repartition(5)
    out = P.fingerprint_documents(df)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    base = df.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()
    order = sorted(base, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    assert got == sorted(expected([(r[0], r[1]) for r in order]), key=str) and len(got) == 1506


def test_empty_and_one(spark, empty):
    none = P.fingerprint_documents(empty)
    assert none.count() == 0 and none.columns[:3] == ["doc_id", "n_chars", "edited_sha256"]
    r = P.fingerprint_documents(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1 and r[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()


def test_megabytes(spark):
    big = "word and word " * 200_000
    r = P.fingerprint_documents(spark.createDataFrame([(2, big), (1, big + "!")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[1]["n_chars"] == len(big) and r[0]["near_next"] > 0.3
