"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovana.llm.common import table

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trovana.llm.bpe import bpe_codec

    return bpe_codec(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), digests=True)


def op8_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovana.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovana.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovana.llm.embedding_dedup import dedup_embeddings

    return dedup_embeddings(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovana.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovana.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovana.llm.secrets import scan_secrets, secret_digest

    return secret_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovana.llm.line_dedup import drop_recurring_lines

    kept = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), digest.alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovana.llm.url_filter import Rule, filter_urls

    rules = (
        Rule("block", "com", "/en/"),
        Rule("allow", "example.com", "/en/7"),
        Rule("allow", "net", "/de/"),
        Rule("block", "example.net", "/de/8"),
        Rule("block", "org", "/es/"),
    )
    out = filter_urls(table(spark, sf_dir, "pages"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict", "template")


def op7_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovana.llm.pii import find_personal_data, pii_digest

    return pii_digest(find_personal_data(table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovana.llm.hard_negatives import mine_hard_negatives

    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trovana.llm.piece_codec import piece_codec

    return piece_codec(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), digests=True)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trovana.llm.vector_codes import code_vectors

    return code_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from trovana.llm import sql

    return dict(sql.ORACLE)
