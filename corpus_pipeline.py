"""A corpus pipeline of five stages: language ID, near-dedup, decontamination, mixing and token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.llm import decontam, langid, mixing, simhash, tokens
from ledgerleaf.llm.common import new_dir
from ledgerleaf.llm.queries import mix_path, mix_weights, tokenizer_path

#: The least share of its language that a document needs to stay.
LEAST_SCORE = 0.5
#: The mixed corpus holds this share of the tokens that reach the stage, none twice.
MIX_SHARE = 0.9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, no text, or no language that is likelier than all others."""
    return langid.keep_known(docs, langid.train(docs), LEAST_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each SimHash component: by doc_id, those without one last, then by a hash of the row."""
    return simhash.first_rows(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes a share of the tokens, by the target weights of domains, languages and sources."""
    return mixing.mix(docs, mix_path(), mix_weights(spark), MIX_SHARE, max_epochs=1).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids and returns each document's place among them."""
    return tokens.token_table(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
