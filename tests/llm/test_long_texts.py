"""Texts of several megabytes go through every operator whole."""

import hashlib

import numpy as np
import pytest

from tracelens.llm import bpe_stream, brown_lm, ngram_join, ogg_media, quality_llr, suffix_dedup, toxicity_gru
from tracelens.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def long_rows():
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}é" for k in range(3000)])
    long = " ".join(rng.choice(words, 330_000))  # about 2.2 MB, more than two slices
    near = long[: len(long) // 2].rsplit(" ", 1)[0] + " changed " + long[len(long) // 2:].split(" ", 1)[1]
    return [(1, long), (2, near), (3, "short text of a few words"), (4, None)]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame(long_rows, "doc_id long, text string").repartition(2).cache()


def test_counts_and_scores(long_docs, long_rows):
    got = {r["doc_id"]: r for r in brown_lm.score_documents(long_docs).collect()}
    for i, t in long_rows:
        assert got[i]["n_tokens"] == len((t or "").split()) + 1 and got[i]["score"] < 0
    net = toxicity_gru.Network(1)
    scores = {r["doc_id"]: r["score"] for r in toxicity_gru.score(long_docs, net).collect()}
    assert set(scores) == {1, 2, 3, 4} and all(0 <= s <= 1 for s in scores.values())


def test_media(long_docs, long_rows):
    back = {r["doc_id"]: r for r in ogg_media.read_media(ogg_media.write_media(long_docs)).collect()}
    for i, t in long_rows:
        body = (t or "").encode()
        assert back[i]["n_bytes"] == len(body) and bytes(back[i]["payload"])[:len(body)] == body and "bad=0" in back[i]["feature"]


def test_near_copies_and_passages(long_docs, long_rows):
    got = {r["doc_id"]: r for r in ngram_join.jaccard_join(long_docs).collect()}
    assert got[1]["n_links"] == got[2]["n_links"] == 1 and got[2]["class_id"] == 1 and got[3]["n_links"] == 0
    kept = {r["doc_id"]: len(r["kept"]) for r in suffix_dedup.remove_repeats(long_docs).collect()}
    assert kept[3] == len(long_rows[2][1]) and kept[1] < 1000 and kept[2] < 1000


def test_tokens(long_docs, long_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: r for r in bpe_stream.round_trip(long_docs, tokenizer_path()).collect()}
    for i, t in long_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_quality(spark, long_docs, long_rows):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_llr.quality_rules(long_docs, labels).collect()}
    for i, t in long_rows:
        assert got[i]["n_words"] == len((t or "").split())
