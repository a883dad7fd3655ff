"""A training corpus from ``documents``: five stages, each one operator.

Every stage takes what its predecessor kept, as written to Parquet, and its decisions
take effect: toxic documents go, recurring lines go, one document of each group of near
duplicates stays, documents with benchmark passages go, and what is left is encoded.

Whatever columns the documents have pass through all stages but the last: they travel as
one struct, so that none can clash with an operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovana.llm.bpe import bpe_codec
from trovana.llm.common import materialise, packed, scratch, table, unpacked
from trovana.llm.decontaminate import decontaminate
from trovana.llm.line_dedup import drop_recurring_lines
from trovana.llm.ngram_join import near_duplicates
from trovana.llm.queries import WORD_BPE
from trovana.llm.toxicity import toxicity_scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below 0.7.

    Null and empty texts score by the model's intercept, and stay; repeated rows fare alike; without confirmed
    toxic labels all stay; an empty table gives no rows; texts of any length are read whole.
    """
    rows = docs.select("doc_id", "text", packed(docs, "text").alias("rest"))
    scored = toxicity_scores(rows, table(spark, sf_dir, "labels"), keep=("text", "rest"))
    return scored.where("predicted = 0").select(*unpacked("rest", docs.columns, text=F.col("text")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines of recurring templates; ``n_chars`` follows the text where lines went.

    Null and empty texts stay as they are; rows with one id and text fare alike; a document may be left with an
    empty text; an empty table gives no rows; texts of any length are whole.
    """
    kept = drop_recurring_lines(docs.select("doc_id", "text", packed(docs, "doc_id", "text").alias("rest")))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("rest.n_chars"))
    return kept.select(*unpacked("rest", docs.columns, **new))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Of several rows with that id the one with the smallest text stays (of equal texts any of them, the same row for
    all columns); rows without an id are of no group and stay, as do null and empty texts of different ids; an empty table
    gives no rows.
    """
    found = near_duplicates(docs.select("doc_id", "text"))
    first = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("is_first")).where("is_first")
    rows = docs.select("doc_id", packed(docs, "doc_id").alias("rest"))
    kept = rows.join(first, "doc_id")
    text = F.col("rest.text")
    # rows of an id that stands several times are few; only they are brought together
    once = kept.where("times = 1").select("doc_id", "rest")
    several = kept.where("times > 1").groupBy("doc_id").agg(F.min_by("rest", F.struct(text, F.to_json(F.struct("rest")))).alias("rest"))
    every = once.unionByName(several).unionByName(rows.where("doc_id is null"))
    return every.select(*unpacked("rest", docs.columns, doc_id=F.col("doc_id")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark.

    Null and empty texts have no words and stay; repeated rows fare alike; an empty benchmark or table is no error.
    """
    rows = docs.select("doc_id", "text", packed(docs).alias("row"))
    found = decontaminate(rows, table(spark, sf_dir, "benchmark"), keep=("row",))
    return found.where("not contaminated").select(*unpacked("row", docs.columns))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to; null and empty texts have no ids."""
    import public_tokenizers

    names = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    done = bpe_codec(docs, public_tokenizers.path(WORD_BPE), keep=tuple(names))
    ids = F.when(F.col("ids") == "", F.array()).otherwise(F.split("ids", " ")).cast("array<int>")
    return done.select(*names, "n_tokens", ids.alias("ids"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The stages learn a model, parse templates and merge byte pairs: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as outside:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", outside)
    return STAGES[-1][1](spark, docs, sf_dir)
