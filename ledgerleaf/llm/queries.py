"""The registered queries of this subpackage: each operator over its whole table, in its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, collocations, decontam, html, langid, mixing, negatives, pii, quality, rules, simhash, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The byte-level vocabulary's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose vec_id is divisible by 20."""
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under a model of all trusted documents, and whether it stays."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that lie in 10-word windows of benchmark items."""
    return decontam.digest(decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a model of the rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


#: The key of the registered query; a real run takes its own from a secret store.
PII_KEY = b"ledgerleaf-demonstration-key"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced by linked pseudonyms."""
    return pii.redact(_table(spark, sf_dir, "documents"), PII_KEY)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash fingerprint and near-duplicate component."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, as read back from bit-plane files."""
    return tokens.token_table(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and conversation -7, whose texts hold control strings."""
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.digest(chat.format_turns(own.unionByName(extra)))


#: Target weights of the mixing query. The tables name no domains, so the length of a source's name stands in for one.
MIX_DOMAIN = {"small": 3.0, "large": 1.0}
MIX_LANG = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 2, 1


def mix_path() -> dict[str, F.Column]:
    """Domain, language and source of a document: sources whose names have up to four letters are "small", others "large"."""
    domain = F.when(F.coalesce(F.length("source"), F.lit(0)) <= 4, "small").otherwise("large")
    return {"domain": domain, "language": F.col("lang"), "origin": F.col("source")}


def mix_weights(spark: SparkSession) -> dict[str, DataFrame]:
    domains = spark.createDataFrame(list(MIX_DOMAIN.items()), "domain string, weight double")
    langs = spark.createDataFrame([(d, x, w) for d in MIX_DOMAIN for x, w in MIX_LANG.items()], "domain string, language string, weight double")
    return {"domain": domains, "language": langs}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that half the corpus's tokens take under the target weights, a row for each time taken."""
    taken = mixing.mix(_table(spark, sf_dir, "documents"), mix_path(), mix_weights(spark), MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return taken.select("doc_id", "mix_path.*", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics, base rules, and the verdict of trees trained on all labels' classes."""
    return rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives of each of five positives of every vector whose vec_id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of each language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ann, op2_quality, op3_html_text, op4_decontamination, op5_language_id, op6_pii, op7_simhash, op8_token_output, op9_chat_format, op10_mixing, op11_quality_rules, op12_hard_negatives, op13_collocations)
}
