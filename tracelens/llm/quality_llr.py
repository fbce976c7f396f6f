"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text.

Everything is DataFrame functions, and all counts and weights are tables.  A text's features
are its words, its word pairs and the last two characters of its words, hashed into a fixed
number of buckets each.  Raw counts come from all documents; trusted counts from all documents
labelled as good, whose scores also give the threshold, an exact quantile.  A bucket's
weight is the shrunken log ratio of the two multinomials, in units of 1/10000, so
that sums are whole numbers and do not depend on their order.  A text's score is the
mean weight of its features; every document is compared with one threshold.

Words are rows inside a task only: they meet the broadcast weights (a fixed number of rows)
and are summed per text before anything is shuffled, so a shuffle has a row for each text.
Texts meet the trusted ids by a shuffle, as these grow with the labels.  Every text is scored
once; the threshold is then taken from the stored scores.

Defined results: null texts count as empty; texts without a word score 0 and fail the
base rules; equal texts get equal results; repeated rows stay as many; an id is trusted if
any of its labels is good, with all its texts; without trusted rows all weights are 0 and the
base rules decide alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import kth_largest, SPACE_CLASS, stash

#: Buckets of each kind of feature; a power of two.
BUCKETS = 1 << 15
#: Raw counts that a bucket's ratio is shrunk by.
SHRINK = 50
#: Units of a log ratio.
SCALE = 10_000
#: Share of trusted documents that the threshold may reject.
REJECT = 0.002
#: How far below the trusted documents' low quantile the threshold lies, in natural log units.
MARGIN = 0.03

#: Scores are ranked in units of 2**-40, as whole numbers in 48 bits about this offset.
_UNIT, _OFFSET = 1 << 40, 1 << 46
#: Space and the controls 9 to 13, as characters to trim.
_SPACES = " \t\n\x0b\f\r"
#: Repeated rows that are written out from one array.
_BLOCK = 4096


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` worked out once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; no empty ones."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, SPACE_CLASS)).otherwise(F.expr("cast(array() as array<string>)"))


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(BUCKETS - 1).cast("int")


def word_rows(texts: DataFrame, words: str = "words") -> DataFrame:
    """A row for each word of each row (one without words has a row of nulls): the other columns, _pos, and
    the buckets _one of the word, _pair of it and the next one (null at the end) and _end of its last two characters."""
    others = [c for c in texts.columns if c != words]
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    rows = texts.select(*others, F.posexplode_outer(F.arrays_zip(F.col(words).alias("w"), after.alias("v"))).alias("_pos", "_x"))
    rows = rows.select(*others, "_pos", F.col("_x.w").alias("_w"), F.xxhash64("_x.w").alias("_h"), F.when(F.col("_x.v").isNotNull(), F.xxhash64("_x.v")).alias("_g"))
    known = lambda c: F.when(F.col("_w").isNotNull(), c)
    return rows.select(
        *others, "_pos", known(_bucket(F.col("_h"))).alias("_one"),
        F.when(F.col("_g").isNotNull(), _bucket(F.xxhash64("_h", "_g")) + BUCKETS).alias("_pair"),
        known(_bucket(F.xxhash64(F.substring("_w", -2, 2), F.lit(7))) + 2 * BUCKETS).alias("_end"),
    )


@dataclass(frozen=True)
class Ratio:
    """``weights``: a stored table of bucket and weight (in 1/SCALE) of all 3 * BUCKETS buckets; the score below which a document is rejected."""

    weights: DataFrame
    threshold: float

    def totals(self, texts: DataFrame, words: str = "words") -> DataFrame:
        """The rows of ``texts`` with the sum of the weights of the features in ``words`` (total), instead of these.

        Equal rows are summed together and written out again.
        """
        others = [c for c in texts.columns if c != words]
        rows, sums = word_rows(texts, words), []
        for kind in ("_one", "_pair", "_end"):
            rows = rows.join(F.broadcast(self.weights.select(F.col("bucket").alias(kind), F.col("weight").alias(f"{kind}_w"))), kind, "left")
            sums.append(F.coalesce(F.col(f"{kind}_w"), F.lit(0)).cast("long"))
        summed = rows.groupBy(*others).agg(F.sum(sums[0] + sums[1] + sums[2]).alias("_sum"), F.count(F.when(F.coalesce("_pos", F.lit(0)) == 0, 1)).alias("_rows"))
        blocks = summed.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_rows") - 1) / _BLOCK))).alias("_b"))
        again = F.sequence(F.lit(1), F.least(F.lit(_BLOCK), F.col("_rows") - F.col("_b") * _BLOCK).cast("int"))
        return blocks.select(*others, F.expr("_sum div _rows").alias("total"), F.explode(again).alias("_again")).drop("_again")


def score_of(total: Column, n_words: Column) -> Column:
    """Mean weight of a text's features in natural log units; 0 without features."""
    return F.when(n_words > 0, total / ((3 * n_words - 1) * SCALE)).otherwise(F.lit(0.0))


def trusted_ids(labels: DataFrame, good: str = "quality", key: str = "doc_id") -> DataFrame:
    """All distinct ids labelled good."""
    return labels.where(F.col(good) == 1).select(key).where(F.col(key).isNotNull()).distinct()


def trusted_rows(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose id is in ``ids``, however many these are."""
    return rows.join(ids.hint("shuffle_hash"), key, "left_semi")


def bucket_counts(docs: DataFrame, ids: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """bucket, n over all texts, good over those in ``ids``."""

    def counted(some: DataFrame, name: str) -> DataFrame:
        rows = word_rows(some.select(words_of(F.col(text)).alias("words")))
        each = rows.select(F.explode(F.array("_one", "_pair", "_end")).alias("bucket")).where("bucket is not null")
        return each.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))

    good = counted(trusted_rows(docs.select(key, text), ids, key), "good")
    return counted(docs, "n").join(good, "bucket", "left").select("bucket", "n", F.coalesce("good", F.lit(0)).alias("good"))


def bucket_weights(counts: DataFrame) -> DataFrame:
    """bucket, weight of every bucket: the log ratio of the shares in trusted and raw text, shrunk; 0 without trusted text."""
    every = counts.sparkSession.range(3 * BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts), "bucket", "left")
    kind = F.floor(F.col("bucket") / BUCKETS)
    every = every.select("bucket", kind.alias("kind"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"))
    sizes = every.groupBy("kind").agg(F.sum("n").alias("all"), F.sum("good").alias("all_good"))
    expected = F.col("good") * F.col("all") / F.col("all_good")
    weight = F.round(SCALE * F.log((expected + SHRINK) / (F.col("n") + SHRINK))).cast("int")
    return every.join(F.broadcast(sizes), "kind").select("bucket", F.when(F.col("all_good") > 0, weight).otherwise(F.lit(0)).alias("weight"))


def _weighed(docs: DataFrame, ids: DataFrame, text: str, key: str) -> Ratio:
    return Ratio(stash(bucket_weights(bucket_counts(docs, ids, text, key))), float("-inf"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: bool = True) -> Ratio:
    """Both multinomials, their log ratio and, if asked for, the threshold."""
    ids = stash(trusted_ids(labels, key=key))
    ratio = _weighed(docs, ids, text, key)
    return Ratio(ratio.weights, lowest(_scored(trusted_rows(docs, ids, key), ratio, text, key))) if threshold else ratio


def fit_and_score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """:func:`fit` on all of ``docs``, and each of them judged by it: key, _h1, _h2, the base figures,
    base_failed, llr_score and kept.  Texts are scored once."""
    ids = stash(trusted_ids(labels, key=key))
    seen = stash(_scored(docs, _weighed(docs, ids, text, key), text, key))
    return _kept(seen, lowest(trusted_rows(seen, ids, key)))


def lowest(scored: DataFrame) -> float:
    """The threshold: MARGIN below the REJECT quantile (between neighbours, by distance) of the scores of texts of 20 words or more."""
    own = stash(scored.where("n_words >= 20").select((F.round(F.col("llr_score") * _UNIT).cast("long") + F.lit(_OFFSET)).alias("v")))
    n = own.count()
    if not n:
        return float("-inf")
    below = int(REJECT * (n - 1))
    low, high = (kth_largest(own, "v", n - k) for k in (below, min(below + 1, n - 1)))
    return (low + (high - low) * (REJECT * (n - 1) - below) - _OFFSET) / _UNIT - MARGIN


def text_key(text: str, key: str) -> list[Column]:
    """The key and two hashes of the text: they tell texts of one key (a null one, too) apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.col(key), F.xxhash64(whole).alias("_h1"), F.xxhash64(F.lit(7), whole).alias("_h2")]


# ---------------------------------------------------------------- base rules

def repeated_words(pairs: Column) -> Column:
    """Words inside 8-word windows that occur at least twice in the text, from the hashes of its word pairs.

    A window is four pairs.  The windows of fewer words at a text's end have fewer pairs, or
    end in a word alone, so they equal none.
    """
    width = 8
    windows = F.transform(pairs, lambda x, i: F.xxhash64(x, F.get(pairs, i + 2), F.get(pairs, i + 4), F.get(pairs, i + 6)))

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            def same(k: Column, other: Column) -> Column:
                return F.coalesce(F.get(s, k)["h"] == F.get(s, other)["h"], F.lit(False))

            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))) | same(k, k + 1))
            places = F.sort_array(F.transform(at, lambda k: F.get(s, k)["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + (p + width - F.greatest(p, a["end"]))).alias("n"), (p + width).alias("end")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ranked, again))

    return F.when(F.size(pairs) > width, let(windows, covered)).otherwise(F.lit(0)).cast("long")


def with_words(text: Column, body) -> Column:
    """``body(words, pair hashes)``, each worked out once for a row; the last word's pair is itself alone."""
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    pairs = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
    return let(words_of(text), lambda w: let(hashes(w), lambda h: let(pairs(h), lambda p: body(w, p))))


def base_figures(text: Column, words: Column, pairs: Column) -> dict[str, Column]:
    """The plain rules' figures of one text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(pairs),
    }


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scored(docs: DataFrame, ratio: Ratio, text: str, key: str) -> DataFrame:
    """key, _h1, _h2, the base figures, base_failed and llr_score."""
    whole = F.coalesce(F.col(text), F.lit(""))
    row = with_words(whole, lambda w, p: F.struct(*(c.alias(k) for k, c in base_figures(whole, w, p).items()), w.alias("words")))
    seen = ratio.totals(docs.select(*text_key(text, key), row.alias("r")).select(key, "_h1", "_h2", "r.*"))
    seen = seen.withColumn("llr_score", score_of(F.col("total"), F.col("n_words"))).drop("total")
    return seen.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _kept(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr_score") >= F.lit(threshold)))


def _judged(docs: DataFrame, ratio: Ratio, text: str, key: str) -> DataFrame:
    """key, _h1, _h2, the base figures, base_failed, llr_score and kept."""
    return _kept(_scored(docs, ratio, text, key), ratio.threshold)


def judge(docs: DataFrame, ratio: Ratio, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the base figures, base_failed, llr_score and kept for every document."""
    return _judged(docs, ratio, text, key).select(key, *FIGURES, "base_failed", "llr_score", "kept")


def keep_good(docs: DataFrame, ratio: Ratio, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, as they are."""
    return _rows_kept(docs, _judged(docs, ratio, text, key), text, key)


def _rows_kept(docs: DataFrame, judged: DataFrame, text: str, key: str) -> DataFrame:
    good = judged.where("kept").select(F.col(key).alias("_key"), "_h1", "_h2")
    whole = F.coalesce(F.col(text), F.lit(""))
    same = F.col("_d.key").eqNullSafe(F.col("_key")) & (F.col("_d.h1") == F.col("_h1")) & (F.col("_d.h2") == F.col("_h2"))
    mine = docs.select(F.struct(*docs.columns).alias("_row"), F.struct(F.col(key).alias("key"), F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(7), whole).alias("h2")).alias("_d"))
    return mine.join(good, same, "left_semi").select("_row.*")


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fit on all of ``docs`` and judge each of them: the columns of :func:`judge`."""
    return fit_and_score(docs, labels, key=key).select(key, *FIGURES, "base_failed", "llr_score", "kept")


def pass_quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, as they are."""
    return _rows_kept(docs, fit_and_score(docs, labels, text, key), text, key)
