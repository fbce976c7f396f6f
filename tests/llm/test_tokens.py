"""Byte-pair transducer against the tokenizers library; packing."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelens.llm import best_fit_pack as K
from tracelens.llm import bpe_stream as S
from tracelens.llm import textkit
from tracelens.llm.queries import tokenizer_path
from tracelens.llm.textkit import text_chunks


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def vocab():
    return S.vocabulary(tokenizer_path())


def encode(vocab, texts):
    out = []
    for _, _, data, offsets in text_chunks(pa.array(texts, pa.string())):
        ids, at = S.encode_chunk(vocab, data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


def test_against_library(vocab, library, rows):
    rng = random.Random(1)
    parts = [*"abst'dlrevm  \n\t0129éßñ—!?.…😀\u00a0\u3000²Ⅷ字", "'s", "'re", "'ll", " '", "  ", "<|endoftext|>", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(3000)] + [r[1] or "" for r in rows]
    texts += ["a" * 5000, " " * 3000 + "x", "!" * 1000 + "'s", "".join(rng.choice("ethraoins") for _ in range(30000)), "字" * 3000]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode(vocab, texts) == want
    for ids in want:
        assert S.decode(vocab, np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    vocab = S.vocabulary(tokenizer_path())
    ids = encode(vocab, [text])[0]
    assert S.decode(vocab, np.array(ids, np.int64)) == text


def test_streaming_needs_bounded_memory(vocab, monkeypatch):
    piece = bytes(random.Random(2).choices(b"abcdefgh", k=20_000))
    monkeypatch.setattr(S, "FEED", 64)
    encoder, out, most = S.StreamEncoder(vocab), [], 0
    for i in range(0, len(piece), 37):
        out += encoder.feed(piece[i:i + 37])
        most = max(most, len(encoder.rest))
    assert out + encoder.finish() == S._merge_many(vocab, np.frombuffer(piece, np.uint8), np.array([0, len(piece)]))[0].tolist()
    assert most < 64 + 37 + vocab.lookahead + int(vocab.lengths.max())


def thue_morse(n):
    t = "a"
    for _ in range(n):
        t += t.translate(str.maketrans("ab", "ba"))
    return t


def test_pre_tokens_of_equal_hash_are_told_apart(vocab, library, monkeypatch):
    """Words that collide under polynomials modulo a power of two; then hashes that are all equal."""
    word = thue_morse(10)
    texts = [f"{word} {word.translate(str.maketrans('ab', 'ba'))} {word}", "some words, some more words and  spaces"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode(vocab, texts) == want
    monkeypatch.setattr(textkit.SpanHash, "spans", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    assert encode(vocab, texts) == want


def test_texts_as_streams(vocab, library, monkeypatch):
    """Bytes in pieces of any size, slices smaller than pre-tokens, special tokens across borders."""
    monkeypatch.setattr(S, "SLICE", 300)
    monkeypatch.setattr(S, "FEED", 64)
    rng = random.Random(7)
    parts = [*"abst'dlrevm  \n\t0129éßñ—!?.…😀\u00a0\u3000²Ⅷ字", "'s", "'re", "'ll", " '", "  ", "<|endoftext|>", "\r\n", "a" * 700, " " * 900, "'" * 500, "字" * 400, "12" * 400]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(12)] + ["", "x", " " * 2000 + "x", "!" * 1500 + "'s"]
    for text in texts:
        body, encoder, out, most, i = text.encode(), S.TextEncoder(vocab), [], 0, 0
        while i < len(body):
            n = rng.choice([1, 7, 50, 333, 1000])
            out += encoder.feed(body[i:i + n]).tolist()
            most, i = max(most, len(encoder.rest)), i + n
        assert out + encoder.finish().tolist() == library.encode(text, add_special_tokens=False).ids
        assert most < 2 * (300 + 1000)
    pa_texts = pa.array([t for t in texts if t])
    monkeypatch.setattr(S, "SLICE", 1 << 9)
    for _, _, data, offsets in text_chunks(pa_texts, 1):
        assert np.concatenate(list(S.encode_stream(vocab, data))).tolist() == library.encode(data.tobytes().decode(), add_special_tokens=False).ids


def test_merge_by_definition(vocab):
    rng = random.Random(3)
    for _ in range(200):
        piece = bytes(rng.choices(b"ethaoinsr ", k=rng.randrange(1, 25)))
        assert S.merge_piece(vocab, piece) == S._merge_many(vocab, np.frombuffer(piece, np.uint8), np.array([0, len(piece)]))[0].tolist()


def test_broken_bytes(vocab):
    ids = vocab.first[np.frombuffer(b"\xff\xe5", np.uint8)]
    assert S.decode(vocab, ids) == "\ufffd\ufffd"


def test_documents(docs, rows, empty, library):
    got = {r["doc_id"]: r for r in S.round_trip(docs, tokenizer_path()).collect()}
    import hashlib

    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        x = got[r[0]]
        assert x["n_tokens"] == len(ids) and x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert S.round_trip(empty, tokenizer_path()).count() == 0


# ---------------------------------------------------------------- packing

def least_bins(sizes, capacity):
    """The optimum by search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def check(patterns, count, capacity):
    used = np.zeros_like(count)
    for pattern, n in patterns:
        assert n > 0 and sum(s * c for s, c in pattern) <= capacity
        for s, c in pattern:
            used[s] += c * n
    assert (used == count).all()


@pytest.mark.parametrize("seed", range(40))
def test_plans(seed):
    rng, capacity = random.Random(seed), 20
    sizes = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 11))]
    count = np.bincount(sizes, minlength=capacity + 1)
    left = count.copy()
    fixed = K.reduce_by_dominance(left, capacity)
    check(fixed, count - left, capacity)
    # The reduction keeps the optimum: what is fixed and the best for the rest are the best for all.
    rest = np.repeat(np.arange(capacity + 1), left).tolist()
    assert sum(n for _, n in fixed) + (least_bins(rest, capacity) if rest else 0) == least_bins(sizes, capacity)
    check(K.plan(count, capacity), count, capacity)
    assert sum(n for _, n in K.plan(count, capacity)) <= least_bins(sizes, capacity) + 1


@pytest.mark.parametrize("seed", range(150))
def test_triples_keep_the_optimum(seed):
    """Few sizes from a third of the capacity on, where sets of three are decided, and many copies."""
    rng, capacity = random.Random(seed), rng_capacity(seed)
    low = rng.choice([capacity // 4, capacity // 5, capacity // 3])
    sizes = [rng.randrange(max(1, low), capacity + 1) for _ in range(rng.randrange(3, 12))]
    count = np.bincount(sizes, minlength=capacity + 1)
    left = count.copy()
    fixed = K.reduce_by_dominance(left, capacity)
    check(fixed, count - left, capacity)
    rest = np.repeat(np.arange(capacity + 1), left).tolist()
    assert sum(n for _, n in fixed) + (least_bins(rest, capacity) if rest else 0) == least_bins(sizes, capacity)


def rng_capacity(seed):
    return (20, 30, 50)[seed % 3]


def test_reduction_fixes_triples():
    count = np.bincount([10, 6, 4, 4], minlength=21)  # beside 10: 6 and 4 fill it, and nothing fits with 4 and 4
    assert K.reduce_by_dominance(count.copy(), 20)[0] == (((10, 1), (6, 1), (4, 1)), 1)


def test_reduction_takes_all_copies_at_once():
    """Steps follow the lengths, not the items."""
    count = np.zeros(2049, np.int64)
    count[[1000, 1040, 1]] = 8_000_000, 8_000_000, 1
    assert len(K.reduce_by_dominance(count, 2048)) < 10


def test_large_plan():
    rng = np.random.default_rng(1)
    count = np.bincount(rng.integers(1, 2049, 200_000), minlength=2049)
    plan = K.plan(count, 2048)
    check(plan, count, 2048)
    assert sum(n for _, n in plan) <= np.ceil((count * np.arange(2049)).sum() / 2048) * 1.01


def test_packed_documents(docs, rows, empty, library):
    got = K.pack_documents(docs, tokenizer_path(), 64).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[r[0]], key=lambda x: x["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts))) and sum(p["length"] for p in parts) == len(ids)
        assert all(p["length"] == 64 for p in parts[1:]) and len(parts) == -(-len(ids) // 64)
        for p in parts:
            piece = ids[p["start"]:p["start"] + p["length"]]
            assert p["length"] == len(piece) and p["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda x: x["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64
    assert K.pack_documents(empty, tokenizer_path()).count() == 0


def test_rows_of_one_id_or_none_spread(spark, monkeypatch):
    """20,000 pieces without id, or of one id, are numbered in groups of bounded size, and every place is taken once."""
    groups = []
    plain = K.with_salts

    def watched(items, count, length):
        out = plain(items, count, length)
        groups.extend(r["count"] for r in out.groupBy(length, "_salt").count().collect())
        return out

    monkeypatch.setattr(K, "with_salts", watched)
    items = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("doc_id"), F.lit(0).alias("piece"), F.lit(30).cast("long").alias("length"))
    got = K.pack(items, 64).collect()
    assert len(groups) == 20 and sum(groups) == 20_000 and max(groups) < 1.3 * K.GROUP_ROWS
    assert len(got) == 20_000 and len({(r["sequence_id"], r["offset"]) for r in got}) == 20_000
    assert len({r["sequence_id"] for r in got}) == 10_000 and {r["offset"] for r in got} == {0, 30}


def test_bad_length(spark):
    with pytest.raises(ValueError):
        K.pack(spark.createDataFrame([(1, 0, 99)], "doc_id long, piece int, length long"), 64)
