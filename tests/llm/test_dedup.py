"""Jaccard join and passage removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracelens.llm import ngram_join as J
from tracelens.llm import suffix_dedup as D
from tracelens.llm.components import components


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1 if w else 0)))
    ids, parent, links = list(sets), {i: i for i in sets}, Counter()

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            same = sets[a] == sets[b]
            union = len(sets[a] | sets[b])
            if same or union and 5 * len(sets[a] & sets[b]) >= 4 * union:
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (find(i), links[i]) for i in ids}


def test_join(docs, rows):
    want = brute_links([(r[0], r[1]) for r in rows])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_join(docs).collect()}
    assert got == want


@pytest.mark.parametrize("block", [512, 7])
def test_join_of_a_large_group(spark, monkeypatch, block):
    """Near copies of one text, all different, in one block and in many."""
    monkeypatch.setattr(J, "BLOCK_ROWS", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(words)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)


def test_join_edges(spark, empty):
    assert J.jaccard_join(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (2, "z")], "doc_id long, text string")
    got = J.jaccard_join(rows).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in got if r["class_id"]) == [(0, 1, 2), (1, 1, 2), (1, 1, 2), (2, 2, 0)]
    assert [r["n_links"] for r in got if r["class_id"] is None] == [0]


def test_join_with_empty_blocks(spark, monkeypatch):
    """Pairs of near copies with more blocks than members: some fall into one block, beside empty ones."""
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 60)
    rows = []
    for g in range(20):
        words = [f"g{g}w{i}" for i in range(100)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words, "tail"]))]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute_links(rows) and {r["n_set_links"] for r in got} == {1}


def test_join_of_repeated_and_null_ids(spark):
    """One id at three texts, each with a near copy of its own, and near copies without ids."""
    text = lambda g, *more: " ".join([*(f"g{g}w{i}" for i in range(100)), *more])
    rows = [(5, text(0)), (5, text(1)), (5, text(2)), (6, text(0, "x")), (7, text(1, "x")), (8, text(2, "x"))]
    rows += [(None, text(0, "y")), (None, text(3)), (None, text(3, "x")), (None, text(3, "x"))]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["set_id"] or 0, r["n_links"], r["n_set_links"]) for r in got)
    assert found == sorted([(5, 5, 5, 2, 2), (5, 5, 5, 1, 1), (5, 5, 5, 1, 1), (6, 5, 6, 2, 2), (7, 5, 7, 1, 1), (8, 5, 8, 1, 1), (0, 5, 0, 2, 2), (0, 0, 0, 2, 1), (0, 0, 0, 2, 1), (0, 0, 0, 2, 1)])


def test_bands():
    bands, rows = J.bands_and_rows(0.9999, 0.8)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999 and bands * rows <= 96


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(parent)}


# ---------------------------------------------------------------- passages

def brute_removed(rows, width):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + width] for _, b in raw for k in range(len(b) - width + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k:k + width]] > 1:
                gone[k:k + width] = b"\1" * width
        kept = bytes(v for v, g in zip(b, gone) if not g)
        out.append((i, len(re.findall(b"\1+", bytes(gone))), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r["doc_id"], len(r["removed"]), sum(s["end"] - s["start"] for s in r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("hot", [20_000, 0])
def test_passages(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(D, "HOT", hot)
    assert result(D.remove_repeats(docs)) == brute_removed([(r[0], r[1]) for r in rows], 200)


def test_planted_passages(spark):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    passage = some(260)
    rows = [(i, some(rng.randrange(0, 300)) + passage[rng.randrange(0, 30):260 - rng.randrange(0, 30)] + some(rng.randrange(0, 300))) for i in range(40)]
    rows += [(100, some(199)), (101, some(200)), (101, rows[0][1]), (None, passage)]
    got, want = D.remove_repeats(spark.createDataFrame([(-1 if i is None else i, t) for i, t in rows], "doc_id long, text string")), [(-1 if i is None else i, t) for i, t in rows]
    assert result(got) == brute_removed(want, 200)
    null = D.remove_repeats(spark.createDataFrame([(None, passage), (None, passage), (1, "x")], "doc_id long, text string"))
    assert [r["kept"] for r in null.orderBy("doc_id").collect()] == [b"", b"", b"x"]


def test_columns_and_text(docs, empty, rows):
    done = D.remove_repeats(docs)
    assert done.columns == [*docs.columns, "removed", "kept"] and D.remove_repeats(empty).count() == 0
    text = {r["doc_id"]: r["text"] for r in D.kept_text(done).collect()}
    assert text[0] is None and text[4] == "one" and text[10] == ""


def test_sliding_least():
    x = np.random.default_rng(0).integers(0, 100, 500)
    for w in (1, 2, 7, 169, 500):
        assert (D.sliding_least(x, w) == [x[i:i + w].min() for i in range(501 - w)]).all()


def test_very_long_text(monkeypatch):
    monkeypatch.setattr(D, "_PIECE", 1000)
    data = np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8)
    whole = np.array([0, len(data)])
    cut = D.runs(data, whole)
    monkeypatch.setattr(D, "_PIECE", 1 << 23)
    one = D.runs(data, whole)
    assert cut["first"][0] == 0 and cut["last"][-1] == one["last"][-1] == 4800
    assert sum(cut["last"] - cut["first"] + 1) == sum(one["last"] - one["first"] + 1) == 4801


def test_rows_of_equal_id_or_none_are_told_apart(spark, monkeypatch):
    """A text that repeats nothing keeps all, whatever the ids and whatever a 32-bit hash says."""
    rng = random.Random(9)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = some(60)
    rows = [(None, some(50) + passage), (None, some(90)), (5, passage + some(40)), (5, some(80)), (5, None), (None, None)]
    done = D.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {r["text"]: r["kept"].decode() for r in done}
    for _, t in rows:
        assert (kept[t] == (t or "")) == (passage not in (t or ""))


def test_sort_compares_bytes():
    """Suffixes of one group that share long prefixes, and widths that the tokens don't divide."""
    rng = np.random.default_rng(3)
    for width in (5, 8, 20, 33):
        data = rng.integers(97, 99, 600).astype(np.uint8)
        at = np.array([0, 300])
        count = np.array([300 - width + 1, 300 - width + 1])
        flags = D.repeated_suffixes(data, at, count, np.zeros(2, np.int64), width)
        starts = [*range(count[0]), *range(300, 300 + count[1])]
        seen = Counter(data[s:s + width].tobytes() for s in starts)
        assert flags.tolist() == [seen[data[s:s + width].tobytes()] > 1 for s in starts]


def test_row_that_stands_thousands_of_times(spark, monkeypatch):
    """3,000 copies of a row beside a near copy: runs cut don't grow with the copies, and results are those of two copies."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120)]
    text, near = " ".join(words), " ".join([*words[:60], "changed", *words[61:]])
    cut, runs = [], D.run_bytes
    monkeypatch.setattr(D, "run_bytes", lambda *a: cut.append(runs(*a)) or cut[-1])
    kept, joined = [], []
    for n in (2, 3000):
        df = spark.createDataFrame([(1, text)] * n + [(2, near), (3, "another text")], "doc_id long, text string").repartition(4)
        kept.append({(r["doc_id"], bytes(r["kept"])) for r in D.remove_repeats(df).collect()})
        joined.append({(r["doc_id"], r["class_id"], r["n_set_links"]) for r in J.jaccard_join(df).collect()})
    assert kept[0] == kept[1] and joined[0] == joined[1] and len(cut) == 2
