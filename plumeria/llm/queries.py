"""The subpackage's queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VOCABULARY_FOLDER = None  #: where the public tokenizers lie; None asks the installed package


def vocabulary(name: str) -> str:
    if VOCABULARY_FOLDER:
        return f"{VOCABULARY_FOLDER}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_pack

    return best_fit_pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_automaton import digests, encode_decode

    return digests(encode_decode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_round_trip

    return token_file_round_trip(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_grammar, score_toxicity

    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_grammar(docs, labels(spark, sf_dir)))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge_urls, mine_rules, weak_labels

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, mine_rules(weak_labels(pages)))


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprint_edits

    return fingerprint_edits(documents(spark, sf_dir))


def op10_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mil_quality import fit_quality, score_quality

    docs = documents(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, labels(spark, sf_dir))).select("doc_id", "held_out", "score", "predicted")


def op11_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .external_shuffle import shard_digests, sharded

    return shard_digests(sharded(documents(spark, sf_dir)))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_repair import damaged, edits, repair_digests

    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_digests(edits(damaged(conversations)), conversations)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked_search

    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_bpe_automaton, op4_token_files, op5_simhash, op6_toxicity, op7_main_text, op8_url_rules, op9_merkle, op10_mil_quality, op11_external_shuffle, op12_turn_repair, op13_ranked_search)}


def _oracles() -> dict[str, str]:
    from . import quality_rules, ranked_search

    return {"op2_quality_rules": quality_rules.oracle_sql(), "op13_ranked_search": ranked_search.oracle_sql()}


ORACLE_SQL = _oracles()
