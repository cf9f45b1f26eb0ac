"""From raw documents to a training mix: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import decontaminate, mixing, near_copies, quality_rules, suffix_dedup
from ledgerlark.llm.shared import only, settled

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; repeated rows are judged alike; an empty table stays one."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id. Fingerprint links and passages propose, shingle sets decide.

    Null and empty texts are one group; of rows that repeat an id, all or none stay; rows without id stay.
    """
    return near_copies.keep_one(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur again; n_chars, where there is such a column, follows.

    Null texts stay null; rows equal in id and text repeat each other, so both lose what they share.
    """
    cut = suffix_dedup.cleaned(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark. Null and empty texts have no words and stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a rate above 0, with domain posteriors and the rate at which to draw them, which replace columns of these names.

    Null and empty texts get the rate of the priors; without labels all rates are alike.
    """
    made = {**{f"p_{d}": F.col(f"__p_{d}") for d in mixing.DOMAINS}, "rate": F.col("__rate")}
    rated = mixing.mixed_rates(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return only(rated, F.col("__rate") > 0).select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], *[x.alias(c) for c, x in made.items()])


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_dedup", near_dedup),
    ("suffix_dedup", exact_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
]

#: Hashing, components, suffix orders and fitted rates aren't SQL; the stages are held against brute force in tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next, and what a stage made on its way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
