"""Registered queries of this package, each over the whole of its table, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ans, backoff_lm, bucket_digest, deobfuscate, factor_dedup, language_bloom, mixing, simhash, spelling, templates, tree_bpe, url_reputation
from .common import table
from .oracles import ORACLES  # noqa: F401

# Rules of the URL contract: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict per page url; outcomes are the labels of the documents of the same number."""
    outcomes = url_reputation.outcomes_from_labels(table(spark, sf_dir, "labels"))
    judged = url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_labelled")


def op2_factor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of earlier ones."""
    return factor_dedup.factor_digest(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return deobfuscate.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_language_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language_bloom.identify(table(spark, sf_dir, "documents"))


def op6_bucket_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document and of its edited text."""
    return bucket_digest.fingerprint(table(spark, sf_dir, "documents"))


def op7_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items."""
    return templates.template_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return backoff_lm.lm_scores(table(spark, sf_dir, "documents"))


def op10_ans_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as coded files and read back."""
    import public_tokenizers

    return ans.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers in every document."""
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path
    return alignment.token_links(docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the frequent words they are variants of."""
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op13_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by tree concatenation, and the decoded texts."""
    import public_tokenizers

    return tree_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_url_reputation": op1_url_reputation,
    "op2_factor_dedup": op2_factor_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_source_mix": op4_source_mix,
    "op5_language_bloom": op5_language_bloom,
    "op6_bucket_digest": op6_bucket_digest,
    "op7_benchmark_templates": op7_benchmark_templates,
    "op8_simhash_trees": op8_simhash_trees,
    "op9_backoff_lm": op9_backoff_lm,
    "op10_ans_output": op10_ans_output,
    "op11_token_alignment": op11_token_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_tree_bpe": op13_tree_bpe,
}
