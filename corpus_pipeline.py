"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Every stage works on all that its predecessor kept.  The first four return the columns of
``documents``; the last returns the packed pieces.  ``run`` applies them to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm import best_fit_pack, ngram_join, quality_llr, suffix_dedup, toxicity_gru
from tracelens.llm.queries import table, tokenizer_path
from tracelens.llm.textkit import stash

#: The columns of ``documents``.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Probability of toxicity from which a document goes.
TOXIC = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules: the base rules and the likelihood ratio."""
    return quality_llr.pass_quality_rules(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below :data:`TOXIC`."""
    net = toxicity_gru.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity_gru.score(docs, net, keep=COLUMNS, with_text=True).where(F.col("score") < TOXIC).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one whose id is the group's, a single row of each of its texts.

    Groups of rows without an id keep a single row of each text; where such rows are like one with an id, they go.
    """
    joined = ngram_join.jaccard_join(docs, text_hash=True).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    first = joined.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left_semi")
    return kept.select(*COLUMNS).dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start elsewhere too; documents of which nothing is left go.

    A character is kept if all its bytes are.
    """
    done = suffix_dedup.remove_repeats(docs.select(*COLUMNS))
    cut = suffix_dedup.kept_text(done)
    return cut.where(F.length(F.trim("text")) > 0).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in token sequences."""
    placed = best_fit_pack.pack_documents(docs, tokenizer_path())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packing),
]

#: No SQL: the network and the token sequences have none; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
