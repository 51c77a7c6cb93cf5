"""The queries of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm import avi, blockmax, crf, debruijn, interactions, langid, mixing, packing, secrets, simhash, suffix, vectors, warc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    """The vocabulary that the contract of op3 names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(documents(spark, sf_dir))


def op5_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.dedup(documents(spark, sf_dir))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op7_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_columns(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_crf, op2_simhash_dedup, op3_best_fit_packing, op4_suffix_array_dedup, op5_debruijn_dedup, op6_warc_derivatives, op7_avi_media, op8_language_id, op9_source_mix, op10_embedding_dedup,
        op11_secret_scan, op12_block_max_search, op13_filter_interactions,
    )
}
ORACLE_SQL: dict[str, str] = {op12_block_max_search.__name__: blockmax.SEARCH_SQL, op13_filter_interactions.__name__: interactions.AUDIT_SQL}
