"""Quality classifier by importance resampling: hashed n-gram models and Gumbel top-k.

Two generative models over hashed n-grams, one of labelled good text and one of all raw
text, give every document a log importance weight: the sum of the log ratios of its
features.  Adding Gumbel noise and keeping the k largest keys samples k documents
without replacement in proportion to their weights.  The noise is a hash of the id and
a seed, so a run can be repeated and does not depend on partitioning.

The k-th largest key is found by radix selection: counts by the leading 16 bits, then
by the next ones, so the driver sees at most 65,536 counts at a time, whatever k is.

Defined results: null and empty texts weigh 0; equal texts weigh the same but draw
their own noise; equal keys (equal ids) stand or fall together, so a few more than k
may be kept; k of 0 or an empty table keeps nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_llr import SCALE, fit, text_key, words_of
from .textkit import kth_largest, stash

#: Share of the documents that a resampling keeps.
FRACTION = 0.85
SEED = 17
#: Keys are rounded to 2**-20 and held as whole numbers in 48 bits about this offset.
_UNIT, _OFFSET = 1 << 20, 1 << 46


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of ``key``."""
    uniform = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    return -F.log(-F.log(uniform))


def log_weights(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_features and log_weight (natural log of target over raw probability) of every document."""
    ratio = fit(docs, labels, text, key, threshold=False)
    words = docs.select(*text_key(text, key), words_of(F.col(text)).alias("words")).withColumn("n_features", F.greatest(3 * F.size("words") - 1, F.lit(0)).cast("long"))
    return ratio.totals(words).select(key, "n_features", (F.col("total") / SCALE).alias("log_weight"))


def resample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Every document with log_weight, gumbel_key and kept (boolean)."""
    noisy = log_weights(docs, labels, key=key).withColumn("gumbel_key", F.round((F.col("log_weight") + gumbel(F.col(key), seed)) * _UNIT).cast("long") + F.lit(_OFFSET))
    noisy = stash(noisy.withColumn("gumbel_key", F.greatest(F.lit(0), F.least(F.col("gumbel_key"), F.lit(2 * _OFFSET - 1)))))
    least = kth_largest(noisy, "gumbel_key", int(noisy.count() * fraction))
    kept = F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least)
    return noisy.select(key, "n_features", "log_weight", ((F.col("gumbel_key") - F.lit(_OFFSET)) / _UNIT).alias("gumbel_key"), kept.alias("kept"))
