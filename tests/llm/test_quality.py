"""Quality rules, importance resampling, toxicity, URL filter, pipeline."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelens.llm import importance_resampling as I
from tracelens.llm import quality_llr as Q
from tracelens.llm import toxicity_gru as T
from tracelens.llm import url_templates as U
from tracelens.llm.queries import URL_RULES
from tracelens.llm.textkit import text_chunks


def figures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = {k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed


def test_base_figures(docs, labels, rows):
    got = {r["doc_id"]: r for r in Q.quality_rules(docs, labels).collect()}
    for r in rows:
        x = got[r[0]]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == figures(r[1]), r[0]
        assert not (x["kept"] and x["base_failed"])


def test_ratio_tells_junk(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(50)]
    good = [(i, " ".join(rng.choice(words, 60))) for i in range(200)]
    junk = [(i + 200, " ".join(x + "###" for x in rng.choice(words, 60))) for i in range(40)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 200 else 0) for i in range(0, 240, 2)], "doc_id long, quality int")
    ratio = Q.fit(docs, labels)
    kept = {r["doc_id"] for r in Q.judge(docs, ratio).where("kept").collect()}
    assert kept == set(range(200))
    assert {r["doc_id"] for r in Q.keep_good(docs, ratio).collect()} == kept
    scores, limit = brute_scores(spark, good + junk, {i for i in range(0, 200, 2)})
    got = {r["doc_id"]: r["llr_score"] for r in Q.judge(docs, ratio).collect()}
    assert got == pytest.approx(scores) and ratio.threshold == pytest.approx(limit)


def brute_features(spark, texts):
    """Buckets of all features of each text, from Spark's hash of single values."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    flat = sorted({w for x in words for w in x})
    h = {r["w"]: (r["h"], r["e"]) for r in spark.createDataFrame([(w,) for w in flat] or [("",)], "w string").select("w", F.xxhash64("w").alias("h"), F.xxhash64(F.expr("right(w, 2)"), F.lit(7)).alias("e")).collect()}
    pairs = sorted({p for x in words for p in zip(x, x[1:])})
    both = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(pairs or [("", "")], "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()}
    n = Q.BUCKETS
    return [[*(h[w][0] % n for w in x), *(both[p] % n + n for p in zip(x, x[1:])), *(h[w][1] % n + 2 * n for w in x)] for x in words]


def brute_weights(features, trusted):
    """The weights of all buckets seen, by the formula."""
    n = Q.BUCKETS
    raw, good = Counter(b for x in features for b in x), Counter(b for x, t in zip(features, trusted) if t for b in x)
    size, good_size = Counter(), Counter()
    for b, c in raw.items():
        size[b // n] += c
    for b, c in good.items():
        good_size[b // n] += c
    return {b: int(np.floor(Q.SCALE * np.log((good[b] * size[b // n] / good_size[b // n] + Q.SHRINK) / (c + Q.SHRINK)) + 0.5)) if good_size[b // n] else 0 for b, c in raw.items()}


def brute_scores(spark, rows, trusted):
    features = brute_features(spark, [r[1] for r in rows])
    weight = brute_weights(features, [r[0] in trusted for r in rows])
    scores = {r[0]: float(np.mean([weight[b] for b in x])) / Q.SCALE if x else 0.0 for r, x in zip(rows, features)}
    low = [scores[r[0]] for r, x in zip(rows, features) if r[0] in trusted and (len(x) + 1) // 3 >= 20]
    return scores, (np.percentile(low, 100 * Q.REJECT) - Q.MARGIN if low else float("-inf"))


def test_scores_and_weights_by_brute_force(spark, docs, labels, rows):
    trusted = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    scores, limit = brute_scores(spark, rows, trusted)
    for r in Q.quality_rules(docs, labels).collect():
        assert r["llr_score"] == pytest.approx(scores[r["doc_id"]], abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["llr_score"] >= limit)
    features = brute_features(spark, [r[1] for r in rows])
    weight = brute_weights(features, [r[0] in trusted for r in rows])
    got = {r["doc_id"]: r for r in I.log_weights(docs, labels).collect()}
    for r, x in zip(rows, features):
        assert got[r[0]]["n_features"] == len(x) and got[r[0]]["log_weight"] == pytest.approx(sum(weight[b] for b in x) / Q.SCALE)


def test_all_trusted_texts_count(spark):
    """Where all of 50,000 texts are labelled good, trusted and raw shares are equal, so every weight is 0 and scores are too."""
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id") % 997).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    weights = Q.fit(docs, labels, threshold=False).weights
    assert weights.count() == 3 * Q.BUCKETS and weights.where("weight <> 0").count() == 0


def test_rows_that_pass_are_those_that_the_query_keeps(spark, docs, labels):
    """The pipeline's stage and the query fit alike."""
    kept = Counter(r["doc_id"] for r in Q.quality_rules(docs, labels).where("kept").collect())
    passed = Q.pass_quality_rules(docs, labels)
    assert kept and Counter(r["doc_id"] for r in passed.collect()) == kept and passed.columns == docs.columns


def test_threshold_is_the_quantile_of_all_trusted_scores(spark):
    values = np.random.default_rng(4).normal(size=3000).round(3)
    scored = spark.createDataFrame([(float(v), 20 if k % 3 else 19) for k, v in enumerate(values)], "llr_score double, n_words long")
    kept = [v for k, v in enumerate(values) if k % 3]
    assert Q.lowest(scored) == pytest.approx(np.percentile(kept, 100 * Q.REJECT) - Q.MARGIN, abs=1e-9)
    assert Q.lowest(scored.limit(0)) == float("-inf")


def test_repeated_rows_ids_and_null_ids(spark, docs, labels, monkeypatch):
    """Rows stay as many, one id may stand at several texts, and equal texts have equal results."""
    monkeypatch.setattr(Q, "_BLOCK", 2)
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(1, good)] * 5 + [(1, "short")] + [(None, good)] * 3 + [(None, None), (None, ""), (2, good)]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    ratio = Q.fit(docs, labels)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted([(r["doc_id"], r["n_words"]) for r in Q.judge(few, ratio).collect()], key=lambda r: (*key(r), r[1]))
    assert got == sorted([(i, len((t or "").split())) for i, t in rows], key=lambda r: (*key(r), r[1]))
    kept = [(r["doc_id"], r["text"]) for r in Q.keep_good(few, ratio).collect()]
    verdict = {r["kept"] for r in Q.judge(few, ratio).where("n_words = 30").collect()}
    assert len(verdict) == 1 and sorted(kept, key=key) == (sorted([r for r in rows if r[1] == good], key=key) if True in verdict else [])
    assert I.resample(few, labels, 0.5).count() == len(rows)


def test_native_plan(docs, labels):
    plan = Q.quality_rules(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_edges(empty, labels, docs):
    assert Q.quality_rules(empty, labels).count() == 0
    none = Q.quality_rules(docs, labels.limit(0))
    assert none.where(F.col("kept") == F.col("base_failed")).count() == 0


def test_resampling(docs, labels, empty):
    got = I.resample(docs, labels, 0.5)
    n = docs.count()
    rows_ = got.collect()
    kept = sorted((r["gumbel_key"] for r in rows_ if r["kept"]), reverse=True)
    assert len(kept) == n // 2 and kept[-1] > max(r["gumbel_key"] for r in rows_ if not r["kept"])
    assert I.resample(docs, labels, 0.0).where("kept").count() == 0 and I.resample(empty, labels).count() == 0
    again = {r["doc_id"]: r["kept"] for r in I.resample(docs.repartition(5), labels, 0.5).collect()}
    assert again == {r["doc_id"]: r["kept"] for r in rows_}


def test_kth_largest(spark):
    values = [int(x) for x in np.random.default_rng(2).integers(0, 1 << 47, 500)] + [5, 5, 5]
    table = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 7, 300, 502, 503):
        assert I.kth_largest(table, "v", k) == sorted(values, reverse=True)[k - 1]
    assert I.kth_largest(table, "v", 0) is None and I.kth_largest(table, "v", 504) is None


def test_gumbel_is_uniform_in_rank(spark):
    x = [r[0] for r in spark.range(4000).select(I.gumbel(F.col("id"), 1)).collect()]
    assert np.mean(x) == pytest.approx(0.577, abs=0.1) and np.var(x) == pytest.approx(np.pi ** 2 / 6, rel=0.15)


# ---------------------------------------------------------------- toxicity

def words_of(texts):
    return [T.read_words(d, o) for _, _, d, o in text_chunks(pa.array(texts), 1 << 30)][0]


def test_gradients():
    """Backward pass against differences."""
    net = T.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w = words_of(["alpha beta gamma delta", "beta beta", "gamma " * 40])
    x = net.vectors(w).astype(np.float64)
    first, size, _ = T.windows(w.at)
    span = np.arange(T.WINDOW)
    index = w.inverse[np.minimum(first[:, None] + span, len(w.inverse) - 1)]
    mask = (span < size[:, None]).astype(np.float64)
    weight = np.array([0.3, -0.7, 0.5, 0.2])[:len(first)]
    old, T._f = T._f, np.float64
    try:
        cache: dict = {}
        net.forward(x, index, mask, cache)
        g, d_x = net.backward(x, index, mask, cache, weight)
        for name in ("uf", "wb", "cf", "wa", "va", "wo", "bo"):
            p = net.p[name]
            at = tuple(0 for _ in p.shape)
            p[at] += 1e-4
            up = net.forward(x, index, mask) @ weight
            p[at] -= 2e-4
            down = net.forward(x, index, mask) @ weight
            p[at] += 1e-4
            assert g[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-4), name
        x[0, 0] += 1e-4
        up = net.forward(x, index, mask) @ weight
        x[0, 0] -= 2e-4
        assert d_x[0, 0] == pytest.approx((up - net.forward(x, index, mask) @ weight) / 2e-4, rel=2e-2, abs=2e-4)
    finally:
        T._f = old


def test_passage_scores_the_same_at_every_offset():
    """The windows that hold a whole passage of 20 to 32 words are all read, wherever it stands."""
    rng = np.random.default_rng(2)
    net, clean = T.Network(5), [f"c{i}" for i in range(200)]
    for length in (20, 32):
        passage = [f"p{i}" for i in rng.integers(0, 50, length)]
        for before in range(0, 100, 3):
            words = [*clean[:before], *passage, *clean[100:140]]
            w = words_of([" ".join(words)])
            alone = words_of([" ".join(words[i:i + T.WINDOW]) for i in range(len(words) - T.WINDOW + 1)])
            assert net.logits(w)[0] == pytest.approx(net.logits(alone).max(), abs=1e-5)


def plain_logit(net, text):
    """The strongest window's logit of a text, word after word, straight from the formulas."""
    p, h_ = {k: v.astype(np.float64) for k, v in net.p.items()}, T.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    w = words_of([text])
    vectors = net.vectors(w).astype(np.float64)
    words = [vectors[k] for k in w.inverse]
    best = -np.inf
    for first in range(max(1, len(words) - T.WINDOW + 1)):
        window, states = words[first:first + T.WINDOW], {}
        for s in "fb":
            h, seen = np.zeros(h_), []
            for x in window if s == "f" else window[::-1]:
                gx, gh = x @ p[f"w{s}"] + p[f"c{s}"], h @ p[f"u{s}"]
                z, r = sigmoid(gx[:h_] + gh[:h_]), sigmoid(gx[h_:2 * h_] + gh[h_:2 * h_])
                h = z * h + (1 - z) * np.tanh(gx[2 * h_:] + r * gh[2 * h_:])
                seen.append(h)
            states[s] = seen if s == "f" else seen[::-1]
        both = np.array([np.concatenate(x) for x in zip(states["f"], states["b"])])
        if len(both):
            e = np.exp(np.tanh(both @ p["wa"] + p["ba"]) @ p["va"])
            best = max(best, (e / e.sum()) @ both @ p["wo"] + p["bo"][0])
        else:
            best = p["bo"][0]
    return best


def test_forward_pass_by_the_formulas():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}é" for k in rng.integers(0, 80, n)) for n in (0, 1, 31, 32, 33, 90, 5)]
    net = T.Network(2)
    net.p = {k: (v * 2 + 0.05).astype(np.float32) for k, v in net.p.items()}
    assert net.logits(words_of(texts)) == pytest.approx([plain_logit(net, t) for t in texts], abs=1e-4)


def test_stream_equals_forward_pass_where_gates_saturate():
    """Whole windows of a stream of several blocks give the logits of the plain pass, also where exp overflows."""
    rng = np.random.default_rng(8)
    w = words_of([" ".join(f"w{k}" for k in rng.integers(0, 300, n)) for n in (T._STREAM + 50, 40, 7)])
    for scale in (1, 400):
        net = T.Network(4)
        net.p = {k: (v * scale).astype(np.float32) for k, v in net.p.items()}
        first, size, text = T.windows(w.at, stride=1)
        each = net.window_logits(net.vectors(w), w, first, size)
        assert net.logits(w) == pytest.approx([each[text == k].max() for k in range(3)], rel=1e-4, abs=1e-4)


def all_in_full(net, w):
    first, size, text = T.windows(w.at, stride=1)
    each = net.window_logits(net.vectors(w), w, first, size)
    return [each[text == k].max() for k in range(len(w.at) - 1)]


def test_windows_are_read_until_their_states_meet(monkeypatch):
    """Fewer steps of the network than 64 a word, and the logits of windows read in full; also where states never meet, or part again."""
    rng = np.random.default_rng(9)
    w = words_of([" ".join(f"w{k}" for k in rng.integers(0, 300, n)) for n in (T._PIECES * T._PIECE + 700, 32, 33, 5, 0, 95, 64, 2000)])
    steps, step = [], T.step
    monkeypatch.setattr(T, "step", lambda u, x, *room: steps.append(x.shape[1]) or step(u, x, *room))

    def work(net):
        net.p["word"], net.p["wo"] = net.p["word"] * 4, net.p["wo"] * 20  # windows differ
        steps.clear()
        assert net.logits(w) == pytest.approx(all_in_full(net, w), abs=1e-4)
        return sum(steps) / len(w.inverse)

    def network(bias):
        net = T.Network(4)
        for s in "fb":
            net.p[f"c{s}"][:T.HIDDEN] = bias
        return net

    assert work(network(-2)) < 45
    assert work(network(7)) > 64  # nothing is forgotten
    some = network(-2)
    for s in "fb":
        some.p[f"w{s}"][0, :T.HIDDEN] = 8
    some.p["word"][::7, 0] = 1  # a seventh of the words keeps what was before
    work(some)
    monkeypatch.setattr(T, "MET", 9.0)  # all are taken to have met at once: this is noticed
    assert work(network(7)) > 64


def test_scores_that_are_0_or_1_need_rough_states_only(monkeypatch):
    """Texts whose rounded score is certain take few steps of the network, all others are read as before: every score is that of windows read in full."""
    rng = np.random.default_rng(10)
    w = words_of([" ".join(f"w{k}" for k in rng.integers(0, 300, n)) for n in (20_000, 31, 32, 33, 0, *rng.integers(60, 900, 60))])
    steps, step = [], T.step
    monkeypatch.setattr(T, "step", lambda u, x, *room: steps.append(x.shape[1]) or step(u, x, *room))

    def network(bias):
        net = T.Network(4)
        net.p["word"], net.p["wo"] = net.p["word"] * 4, net.p["wo"] * 20
        for s in "fb":
            net.p[f"c{s}"][:T.HIDDEN] = bias
        return net, np.array(all_in_full(net, w), np.float64)

    def work(net, each, scale, shift):
        net.scale, net.shift = scale, shift
        steps.clear()
        got, wanted = net.scores(w), np.round(1 / (1 + np.exp(-(scale * each + shift))), 6)
        assert got == pytest.approx(wanted, abs=2e-5 * max(1, scale)) and (got[(wanted == 0) | (wanted == 1)] % 1 == 0).all()
        return sum(steps) / len(w.inverse), wanted

    net, each = network(-2)
    assert work(net, each, 2.0, -60 - 2 * each.max())[0] < 20  # all are 0
    assert work(net, each, 2.0, 60 - 2 * each.min())[0] < 20  # all are 1
    scale = 200 / (each.max() - each.min())
    wanted = work(net, each, scale, -scale * np.quantile(each, 0.7))[1]
    assert 0 < (wanted == 0).sum() and 0 < (wanted == 1).sum() and 0 < ((wanted > 0) & (wanted < 1)).sum()
    work(net, each, 0.0, 0.3)
    net, each = network(7)  # nothing is forgotten
    monkeypatch.setattr(T, "ROUGH_MET", 9.0)  # all are taken to have met at once
    for shift in (-60, -15, 0):
        work(net, each, 2.0, shift - 2 * np.median(each))


def test_sums_of_neighbours():
    x = np.arange(60.0).reshape(2, 30) ** 2
    for width in (1, 2, 3, 7, 8, 29, 30):
        assert T.runs(x, width).tolist() == [[row[k:k + width].sum() for k in range(31 - width)] for row in x]


def test_words_are_made_of_characters():
    """Pairs are of whole characters: é and è share a lead byte, but no pair."""
    pairs = lambda t: words_of([t]).pair.tolist()
    assert len(pairs("éa")) == 3 and len(pairs("字")) == 2 and len(pairs("abc")) == 4
    assert not set(pairs("é")) & set(pairs("è")) and pairs("Éx")[1:] != pairs("éx")[:-1]


def test_long_labelled_texts_are_learned_from(spark):
    """Toxic texts of 25 kB, a third of them: none is too long for the sample."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join([*(f"w{k}" for k in rng.integers(0, 50, 6000 if i % 2 else 40)), *(["vile"] if i % 2 else [])])) for i in range(60)]
    net = T.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    fresh = T.Network()
    assert not np.allclose(net.p["uf"], fresh.p["uf"]) and net.scale > 0


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    for kind in (0, 1):
        marks = spark.createDataFrame([(i, kind) for i in range(20)], "doc_id long, toxic int")
        assert {r["score"] for r in T.score_documents(docs, marks).collect()} == {float(kind)}
    # Labels of both kinds, but no text for one of them: the share of toxic labels.
    marks = spark.createDataFrame([(i, int(i >= 20)) for i in range(40) if T_fold(i)], "doc_id long, toxic int")
    n = [T_fold(i) for i in range(20)].count(True), [T_fold(i) for i in range(20, 40)].count(True)
    assert {r["score"] for r in T.score_documents(docs, marks).collect()} == {round(n[1] / sum(n), 6)}


def T_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % T.FOLDS != 0


def test_sample_is_bounded_by_bytes():
    rows = [{"y": k % 2, "o": k, "h": 0, "n": 10 if k != 4 else 1000} for k in range(10)]
    got = T._within(rows, 3, 25)
    assert [x[1] for x in got] == [0, 1, 2, 3] and len(T._within(rows, 3, 10_000)) == 6


def test_copies_of_a_labelled_text_are_bounded(spark, monkeypatch):
    """A text that stands 3,000 times under its id, and an id with 500 texts: the sample stays within its bounds."""
    got = []
    monkeypatch.setattr(T, "train", lambda texts, y, share: got.append((texts, y)) or T.constant(share))
    ids = [i for i in range(200) if T_fold(i)][:60]
    rows = [(i, f"text of {i}") for i in ids] + [(ids[0], "again and again")] * 3000 + [(ids[1], f"one of many {k}") for k in range(500)]
    T.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int"), rows=40)
    texts, y = got[0]
    assert len(texts) == len(y) <= 80 and 0 < y.sum() <= 40 and 0 < (y == 0).sum() <= 40


def test_windows_cover_texts():
    first, size, text = T.windows(np.array([0, 0, 5, 105, 140]))
    assert text.tolist() == [0, 1, 2, 2, 2, 2, 3, 3] and size[0] == 0
    covered = {(t, k) for f, s, t in zip(first, size, text) for k in range(f, f + s)}
    assert len(covered) == 140


def test_learns_and_holds_out(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(700):
        w = list(rng.choice(words, rng.integers(10, 90)))
        bad = i % 3 == 0
        if bad:
            w[rng.integers(len(w))] = str(rng.choice(["nasty", "vile", "awful"]))
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    done = T.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    held = [(r["predicted"], marks[r["doc_id"]][1]) for r in done if r["held_out"]]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.95


def test_toxicity_edges(docs, labels, empty):
    got = {r["doc_id"]: r for r in T.score_documents(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[0]["score"] == got[1]["score"] == got[2]["score"] and got[10]["score"] == got[11]["score"]
    assert T.score_documents(empty, labels).count() == 0
    assert {r["score"] for r in T.score_documents(docs, labels.limit(0)).collect()} == {0.5}


# ---------------------------------------------------------------- URLs

def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in URL_RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


URLS = [None, "", "nothing", "http://", "https://A.Example.COM/en/71?x=1", "http://example.com/en/8", "http://com/en/", "http://xcom/en/1", "http://b.example.net/de/81#t", "http://b.example.net/de/9", "x://org/es/1://z", "http://É.org/es/1",
        "http://h.example.org?q=/es/", "http://h.example.org#/es/", "http://a.io/p/1/2/3/4/5/6/7/8/9"]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "html", "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in U.filter_urls(pages, URL_RULES).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or "allow")
    assert U.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_contract_verdicts(spark):
    """Every rule's word, written out, on pages that one rule fits."""
    said = {"http://a.com/en/1": "block", "http://example.com/en/71": "allow", "http://b.net/de/1": "allow", "http://example.net/de/9": "allow", "http://example.net/de/81": "block", "http://c.org/es/1": "block"}
    pages = spark.createDataFrame(list(enumerate(said)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(pages, URL_RULES).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())


def test_templates(spark):
    rows = [(i, f"http://h.example.io/{'bad' if i % 2 else 'good'}/item-{i}.html") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = [("io/bad/item-1", "block")]
    got = {r["page_id"]: r for r in U.filter_urls(pages, rules).collect()}
    assert got[0]["template"] != got[1]["template"] and got[0]["template"].endswith(".html")
    assert got[1]["verdict"] == "block" and got[0]["verdict"] == "allow"
    assert got[3]["rule"] is None and got[3]["purity"] > got[0]["purity"]


def dense_alike(a, b):
    """The chi-square test on whole rows of a table."""
    a, b = a.astype(float), b.astype(float)
    a, b = a[a + b > 0], b[a + b > 0]
    df = len(a) - 1
    if df < 1 or not a.sum() or not b.sum():
        return True
    ratio = (b.sum() / a.sum()) ** 0.5
    value = float(((ratio * a - b / ratio) ** 2 / (a + b)).sum())
    return value <= df * (1 - 2 / (9 * df) + U.ALIKE * (2 / (9 * df)) ** 0.5) ** 3


def brute_templates(rows):
    """{(host, segments): (template, purity)} of (host, segments, bad or None), by plain loops."""
    wild = lambda s: s if s == "" else re.sub(r"^.*?(\.[a-z]{2,5})?$", lambda m: "*" + (m.group(1) or ""), s, count=1)
    shape = {(h, s): () for h, s, _ in rows}
    pages = Counter((h, s) for h, s, _ in rows)
    level = 0
    while True:
        live, own, ends = Counter(), Counter(), Counter()
        for (h, s), n in pages.items():
            if len(s) > level and len(shape[h, s]) == level:
                live[h, shape[h, s]] += n
                own[h, shape[h, s], s[level]] += n
                ends[h, shape[h, s], wild(s[level])] += n
        live = {k: n for k, n in live.items() if n >= U.LITERAL_PAGES}
        if not live:
            break
        for h, s in pages:
            t = shape[h, s]
            if len(s) > level and len(t) == level and (h, t) in live:
                fair, w = max(U.LITERAL_PAGES, U.LITERAL_SHARE * live[h, t]), wild(s[level])
                shape[h, s] = (*t, s[level] if s[level] == "" or own[h, t, s[level]] >= fair else w if ends[h, t, w] >= fair else "*")
        level += 1
    for h, s in pages:
        shape[h, s] += tuple(wild(x) for x in s[len(shape[h, s]):])
    name = {(h, shape[h, s]): shape[h, s] for h, s in pages}
    figures = {}
    for h, s, bad in rows:
        x = figures.setdefault((h, shape[h, s]), [0, 0, 0])
        x[0], x[1], x[2] = x[0] + (bad is not None), x[1] + (bad or 0), x[2] + 1
    for level in range(level - 1, -1, -1):
        groups = {}
        for (h, t), x in figures.items():
            if len(t) > level:
                groups.setdefault((h, t[:level]), {}).setdefault(t[level], []).append(("/".join(name[h, t][level + 1:]), x))
        for (h, above), branches in groups.items():
            if sum(x[2] for v in branches.values() for _, x in v) < U.LITERAL_PAGES:
                continue
            every = sorted({b for v in branches.values() for b, _ in v})
            below = {k: np.array([sum(x[2] for b, x in v if b == e) for e in every]) for k, v in branches.items()}
            label = {k: np.array([sum(x[1] for _, x in v) + 1.0, sum(x[0] - x[1] for _, x in v) + 9.0]) for k, v in branches.items()}
            joined = []
            for b in sorted(branches, key=lambda b: (-below[b].sum(), b)):
                for g in joined:
                    if dense_alike(below[g[0]], below[b]) and dense_alike(label[g[0]], label[b]):
                        g.append(b)
                        break
                else:
                    joined.append([b])
            for g in joined:
                for h2, t in figures:
                    if h2 == h and len(t) > level and t[:level] == above and t[level] in g:
                        name[h, t] = (*name[h, t][:level], "|".join(sorted(g)), *name[h, t][level + 1:])
    sums = {}
    for (h, t), x in figures.items():
        for d in range(len(t) + 1):
            y = sums.setdefault((h, name[h, t][:d]), [0, 0])
            y[0], y[1] = y[0] + x[0], y[1] + x[1]
    out = {}
    for h, s in pages:
        t, p = name[h, shape[h, s]], 0.1
        for d in range(len(t) + 1):
            n, bad = sums[h, t[:d]]
            p = (bad + 5 * (p + 0.1)) / (n + 10)
        out[h, s] = ("/" + "/".join(t), p)
    return out


@pytest.mark.parametrize("part", [U.PART_SEGMENTS, 300, 0])
def test_templates_by_brute_force(spark, monkeypatch, part):
    """Deep paths, many branches and suffixes, branches that are alike, few and many labels; nodes in tasks, cut by Spark, and both."""
    monkeypatch.setattr(U, "PART_SEGMENTS", part)
    monkeypatch.setattr(U, "PART_ROWS", 2)
    rng = np.random.default_rng(4)
    rows = []
    for h in ("a.io", "b.io"):
        for _ in range(250):
            first = str(rng.choice(["en", "de", "fr", "shop", "x" + str(rng.integers(99))]))
            s = [first, *(str(rng.choice(["p", "q", "r.html", ""])) for _ in range(rng.integers(0, 5)))]
            s += ["deep"] * int(rng.integers(0, 2) * 3)
            s[-1:] = [s[-1], f"k{rng.integers(400)}.{rng.choice(['html', 'pdf', 'a' + chr(97 + rng.integers(26))])}"][: rng.integers(1, 3)]
            bad = None if rng.random() < 0.6 else int(first in ("shop", "fr") or rng.random() < 0.05)
            rows.append((h, tuple(s), bad))
    rows += [("c.io", (), None), ("c.io", ("",), 1), ("c.io", ("", ""), 0), ("", ("",), None)]
    got = U.templates(spark.createDataFrame([(h, list(s), b) for h, s, b in rows], "host string, segments array<string>, bad int")).collect()
    want = brute_templates(rows)
    assert len(got) == len(want)
    for r in got:
        template, purity = want[r["host"], tuple(r["segments"])]
        assert r["template"] == template and r["purity"] == pytest.approx(purity)
    assert {t for t, p in want.values() if p >= U.LIMIT} and any("|" in t for t, _ in want.values())


def test_jobs_do_not_grow_with_depth(spark):
    """Three pages of five segments and three of five hundred; columns of clashing names and repeated URLs do no harm."""
    def run(depth):
        rows = [(i, "http://t.io" + "".join(f"/{'abc'[i]}{k}" for k in range(depth)), "x", "y", "z") for i in range(3)] * 2
        pages = spark.createDataFrame(rows, "page_id long, url string, segments string, fit string, template string")
        group = f"depth-{depth}"
        spark.sparkContext.setJobGroup(group, group)
        got = U.filter_urls(pages, URL_RULES).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(got) == 6 and len({(r["page_id"], r["template"]) for r in got}) == 3
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    (_, few), (got, many) = run(5), run(500)
    assert abs(many - few) <= 2
    assert all(r["template"].count("/") == 500 and r["verdict"] == "allow" for r in got)


def test_alike():
    rng = np.random.default_rng(1)
    assert dense_alike(np.array([50, 50]), np.array([9, 11])) and not dense_alike(np.array([50, 50]), np.array([90, 10]))
    for _ in range(300):
        a, b = rng.poisson(rng.choice([0.3, 3, 30], 8)), rng.poisson(rng.choice([0.3, 3, 30], 8))
        x, y = a[(a > 0) & (b > 0)], b[(a > 0) & (b > 0)]
        assert U.alike((a.sum(), b.sum()), ((a > 0).sum(), (b > 0).sum()), (x * y / (x + y)).sum(), len(x)) == dense_alike(a, b)


# ---------------------------------------------------------------- pipeline

def test_pipeline(spark, tmp_path, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {"documents": docs}
    current = docs
    for name, stage in P.STAGES:
        out = stage(spark, current, data)
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        current = kept[name] = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        if name != P.STAGES[-1][0]:
            assert current.columns == list(P.COLUMNS)
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in kept.items()}
    names = ["documents", *[n for n, _ in P.STAGES]]
    for a, b in zip(names, names[1:]):
        assert ids[b] <= ids[a]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    judged = {r["doc_id"] for r in Q.quality_rules(docs, labels).where("kept").collect()}
    assert ids["quality rules"] == judged
    whole = P.run(spark, data)
    assert whole.select("doc_id", "piece", "length", "ids_crc32").exceptAll(current.select("doc_id", "piece", "length", "ids_crc32")).count() == 0
    assert whole.count() == current.count() > 0


def test_pipeline_rows_of_one_id_or_none(spark, data):
    """Near copies go row by row: an id at several texts, and rows without ids."""
    import corpus_pipeline as P

    rng = np.random.default_rng(8)
    x, y, z = (" ".join(f"{p}{k}" for k in rng.integers(0, 500, 80)) for p in "xyz")
    rows = [(1, x), (5, x + " more"), (5, y), (None, y), (None, y + " more"), (None, z), (None, z), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.near_duplicates(spark, docs, data)
    assert got.columns == list(P.COLUMNS)
    assert sorted([(r["doc_id"] or 0, r["text"] or "") for r in got.collect()]) == sorted([(1, x), (5, y), (0, z), (7, "")])
