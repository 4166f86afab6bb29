"""The registered queries of the corpus operators: each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import ann, decontaminate, fixity, minhash, mixing, quality, repeats, secrets, sharding, toxicity
from gleaner.llm.common import table


def op1_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op2_resharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.reshard(table(spark, d, "documents"))


def op3_fixity_audit(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return fixity.audit(pages, fixity.decayed(pages))


def op4_secret_grammars(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(table(spark, d, "documents"))


def op5_pivotal_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.copies(table(spark, d, "documents"))


def op6_run_length_repeats(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeats(table(spark, d, "documents"))


def op7_additive_quantisation(spark: SparkSession, d: str) -> DataFrame:
    return ann.neighbours(table(spark, d, "embeddings"))


def op8_compression_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxic(table(spark, d, "documents"), table(spark, d, "labels"))


def op9_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    return quality.selected(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_bbit_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_groups(table(spark, d, "documents"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_resharding,
        op3_fixity_audit,
        op4_secret_grammars,
        op5_pivotal_mixing,
        op6_run_length_repeats,
        op7_additive_quantisation,
        op8_compression_toxicity,
        op9_importance_resampling,
        op10_bbit_minhash,
        pipeline,
    )
}

ORACLES: dict[str, str] = {"op2_resharding": sharding.ORACLE, "op3_fixity_audit": fixity.ORACLE}
