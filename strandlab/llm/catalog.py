"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from strandlab.llm import sql
from strandlab.llm.registry import ORACLES, QUERIES, register
from strandlab.llm.shared import documents
from strandlab.session import fresh_path

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.llm.language_id import predict_languages

    return predict_languages(documents(spark, folder))


@register("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.llm.toxicity import score_toxicity

    return score_toxicity(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@register("op3_mixing")
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.llm.mixing import mixture

    return mixture(documents(spark, folder))


@register("op4_merkle", sql.MERKLE)
def op4_merkle(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.llm.merkle import fingerprints

    return fingerprints(documents(spark, folder))


@register("op5_exact_dedup", sql.EXACT)
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.llm.exact_dedup import exact_groups

    return exact_groups(documents(spark, folder)).drop("key", "size")


#: The rules of the URL filter, as the contract gives them.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@register("op6_url_filter", sql.url_filter(URL_RULES))
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.llm.host_reputation import Rule, judge_urls

    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, [Rule(*r) for r in URL_RULES])


@register("op7_token_files")
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.llm.token_files import read_token_files, token_digests, write_token_files

    path = fresh_path(spark, "token-files")
    write_token_files(documents(spark, folder), path, tokenizer_path("word_bpe_49k.json"))
    return token_digests(read_token_files(spark, path))


@register("op8_packing")
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.llm.packing import pack_documents

    return pack_documents(documents(spark, folder), tokenizer_path("word_bpe_49k.json"))


@register("op9_token_counts")
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.llm.token_counts import count_tokens

    return count_tokens(documents(spark, folder), tokenizer_path("byte_bpe_50k.json"), fresh_path(spark, "count-cache"))


@register("op10_ngram_join", sql.near_join(4, 85, 100))
def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.llm.near_join import near_components

    return near_components(documents(spark, folder), width=4, num=85, den=100)


@register("op11_prefix_trie", sql.PREFIX_TRIE)
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.llm.prefix_trie import prefix_trie

    return prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.llm.alignment import align_corpus

    return align_corpus(documents(spark, folder), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@register("op13_byte_cnn")
def op13_byte_cnn(spark: SparkSession, folder: str) -> DataFrame:
    from strandlab.llm.byte_cnn import score_quality

    return score_quality(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@register("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
