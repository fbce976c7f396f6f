"""Cross-tokenizer alignment against whole texts in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracelens.llm import token_alignment as T
from tracelens.llm.bpe_stream import _byte_of_char
from tracelens.llm.queries import PIECES, tokenizer_path

A, B = tokenizer_path(), tokenizer_path(PIECES)


@pytest.fixture(scope="module")
def plain():
    """text -> groups of (A ids, B ids), or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), _byte_of_char()
    a.encode_special_tokens = True

    def groups(text):
        if not text:
            return None
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
        parts = [[bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]]]
        parts.append([bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            return None
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        common = sorted(set(ends[0]) & set(ends[1]))
        out = [([], []) for _ in common]
        for side in (0, 1):
            for i, e in zip(ids[side], ends[side]):
                out[next(k for k, c in enumerate(common) if c >= e)][side].append(i)
        return out

    return groups


def expected(rows, groups) -> list[tuple]:
    of = [groups(t) for _, t in rows]
    linked = [Counter((x, y) for a, b in g or [] for x in a for y in b) for g in of]
    docs = Counter(p for c in linked for p in c)
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), g, c in zip(rows, of, linked):
        if g is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(n for p, n in c.items() if docs[p] == most[p[0]])
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), best, sum(n * docs[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def mixed(rng: random.Random, n: int) -> list[str]:
    parts = [*"abst'dlrevm  \n\t0129éßñ—!?.…😀 　²Ⅷ字  ", "'s", "'re", " '", "  ", "<|endoftext|>", "\r\n", " the", " of", "tion", "<s>", "</s>", "<0x0A>", " Ελ", " हि", "\x00", "\x1f "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def result(df) -> list[tuple]:
    return [tuple(r) for r in T.align_documents(df, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def test_units_change_nothing(plain):
    """Texts cut into units, against whole ones."""
    texts = mixed(random.Random(7), 1500) + ["▁ x", "a▁b", " ", "   ", "ab" * 3000, "ba" * 2000, "字" * 500, "word " * 500, "\n\n x\n y", "ends "]
    known = T.Units(T.tokenizers(A, B))
    assert known.pair.cuts
    data = [t.encode() for t in texts]
    figures, digests, at, codes, times = T.align(known, np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
    refused = 0
    for k, t in enumerate(texts):
        g = plain(t)
        refused += g is None
        c = Counter((x, y) for a, b in g or [] for x in a for y in b)
        assert figures[k].tolist() == ([sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values())] if g else [0] * 4), t
        assert {divmod(p, known.pair.size_b): n for p, n in zip(codes[at[k]:at[k + 1]].tolist(), times[at[k]:at[k + 1]].tolist())} == dict(c)
        assert bool(digests[k]) == (g is not None)
    assert 0 < refused < 20


@pytest.mark.parametrize("common", [2_000_000, 40])
def test_documents(spark, docs, rows, plain, monkeypatch, common):
    """All counts broadcast, and most of them by shuffle."""
    monkeypatch.setattr(T, "COMMON", common)
    assert sorted(result(docs)) == sorted(expected([(r[0], r[1]) for r in rows], plain))


def test_copies_weigh(spark, plain, monkeypatch):
    """A text with very many copies, repeated ids and rows, null ids; little is remembered."""
    monkeypatch.setattr(T, "KNOWN_UNITS", 10)
    rows = [(i % 3, "one text for many") for i in range(1300)] + [(None, "one text"), (None, None), (4, ""), (4, "another text for one"), (4, "another text for one")]
    got = result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(got) == Counter(expected(rows, plain))


def test_nothing(spark, empty):
    assert result(empty) == []
    assert result(spark.createDataFrame([(1, None)], "doc_id long, text string")) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_large_groups_are_counted():
    a, b = np.array([5, 5, 7, 7, 7, 1]), np.array([3, 3, 3, 9])
    ends_a, ends_b = np.array([1, 3, 5, 7, 10, 11]), np.array([2, 6, 10, 11])
    want = Counter((x, y) for x in (5, 5, 7, 7, 7) for y in (3, 3, 3)) + Counter([(1, 9)])
    for limit in (64, 2):
        T.LARGE, kept = limit, T.LARGE
        ends, ga, gb, pairs, group = T.links(ends_a, ends_b, a, b, 10)
        T.LARGE = kept
        got = Counter()
        for code, n in pairs.T.tolist():
            got[divmod(code, 10)] += n
        assert got == want and ends.tolist() == [10, 11] and sorted(set(group.tolist())) == [0, 1]
