"""The registered queries of this package, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import hard_negatives, html_text, lexical, licenses, lm_scoring, mixing, near_dedup, nn_descent, packing, pii, quality, token_rollup, topk
from lintlake.llm.shared import Workspace, read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "token-rollup")
    ledger = token_rollup.TokenLedger(spark, work.path("ledger"))
    documents, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return token_rollup.corpus_history(ledger, work, documents, labels, {"word_bpe_49k": tokenizer_path()})


def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(read_table(spark, sf_dir, "documents"))


def language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents"))


def approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(read_table(spark, sf_dir, "embeddings"))


def exact_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(read_table(spark, sf_dir, "embeddings"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.entity_digest(read_table(spark, sf_dir, "documents"))


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(read_table(spark, sf_dir, "documents"), tokenizer_path())


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(read_table(spark, sf_dir, "documents"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


def lexical_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_token_rollup": token_rollup_totals,
    "op2_minhash_near_dedup": near_duplicate_documents,
    "op3_kneser_ney_quality": document_quality,
    "op4_license_rules": license_scan,
    "op5_cost_balanced_packing": packed_pieces,
    "op6_elias_fano_lm": language_model_scores,
    "op7_contextual_pii": personal_data,
    "op8_nn_descent": approximate_neighbours,
    "op9_entropy_balanced_mix": mixed_sources,
    "op10_norm_sorted_topk": exact_products,
    "op11_block_text": page_texts,
    "op12_zone_map_negatives": mined_negatives,
    "op13_stratified_search": lexical_ranking,
}
ORACLES: dict[str, str] = {
    "op4_license_rules": licenses.digest_sql(),
    "op11_block_text": html_text.extraction_sql(),
    "op12_zone_map_negatives": hard_negatives.negatives_sql(),
    "op13_stratified_search": lexical.ranking_sql(),
}
