"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import backoff, bpe, minhash, nbsvm, nnpu, packing, phrases, pii, progressive, quality_rules, sharding, spelling, substrings
from millrace.session import spread, table

SMALL_SHARD = 64 << 10


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(_docs(spark, sf_dir), percent=85)


def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(table(spark, sf_dir, "documents"))


def op3_media_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive.digests(progressive.store(_docs(spark, sf_dir)))


def op4_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_docs(spark, sf_dir), bpe.read_vocabulary(name="word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_docs(spark, sf_dir))


def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return nbsvm.classify(docs, nbsvm.train(docs, table(spark, sf_dir, "labels")))


def op8_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return nnpu.classify(docs, nnpu.train(docs, table(spark, sf_dir, "labels")))


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def sharding_by_64_kib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 with a limit at which small tables split too."""
    return sharding.assign(table(spark, sf_dir, "documents"), SMALL_SHARD)


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), bpe.read_vocabulary(name="byte_bpe_50k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_docs(spark, sf_dir))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_docs(spark, sf_dir)).drop("text")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_stupid_backoff,
        op3_media_progressive_jpeg,
        op4_bpe_segment_tree,
        op5_quality_rules,
        op6_pii_pseudonyms,
        op7_quality_nbsvm,
        op8_toxicity_nnpu,
        op9_extendible_sharding,
        op10_bm25_packing,
        op11_spelling_variants,
        op12_suffix_dedup,
        op13_phrase_collocations,
        sharding_by_64_kib,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_stupid_backoff": backoff.ORACLE_SQL,
    "op9_extendible_sharding": sharding.oracle_sql(sharding.LIMIT_BYTES),
    "op11_spelling_variants": spelling.ORACLE_SQL,
    "op12_suffix_dedup": substrings.ORACLE_SQL,
    "op13_phrase_collocations": phrases.ORACLE_SQL,
    "sharding_by_64_kib": sharding.oracle_sql(SMALL_SHARD),
}
