"""Registered queries of the corpus operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_pack, bpe_stream, brown_lm, importance_resampling, ngram_join, ogg_media, oracles, phrase_prints, quality_llr, spelling_groups, suffix_dedup, token_alignment, toxicity_gru, url_templates

#: The tokenizer's file; its place is a parameter of the operators.
TOKENIZER = "byte_bpe_50k.json"
#: The tokenizer that it is aligned with.
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_documents(table(spark, sf_dir, "documents"))


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = ogg_media.write_media(table(spark, sf_dir, "documents"))
    back = ogg_media.read_media(media)
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        "media_bytes", "media_sha256", "feature",
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = best_fit_pack.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gru.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return done.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


#: The contract's rules.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrase_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_prints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.spelling_groups(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


# The columns of the queries above that SQL can express, for comparison with it.

def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_brown_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_ogg_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_url_templates(spark, sf_dir).select("page_id", "host", "path", "rule")


def quality_base_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality_rules(spark, sf_dir).select("doc_id", *quality_llr.FIGURES, "base_failed")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_phrase_prints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_lm": op1_brown_lm,
    "op2_ogg_media": op2_ogg_media,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity_gru": op4_toxicity_gru,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_templates": op7_url_templates,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_quality_rules": op10_quality_rules,
    "op11_phrase_prints": op11_phrase_prints,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_token_alignment": op13_token_alignment,
    "lm_base_scores": lm_base_scores,
    "media_payloads": media_payloads,
    "url_rules": url_rules,
    "quality_base_figures": quality_base_figures,
    "edited_texts": edited_texts,
}

ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op6_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op12_spelling_groups": oracles.SPELLING_GROUPS,
    "lm_base_scores": oracles.LM_BASE,
    "media_payloads": oracles.MEDIA_PAYLOADS,
    "url_rules": oracles.URL_RULES,
    "quality_base_figures": oracles.QUALITY_BASE,
    "edited_texts": oracles.EDITED_TEXTS,
}
