"""The operators' queries with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, licenses, lines, mixing, neighbours, packing, quality, secrets, simhash, warc
from .shared import load


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file; the package that has them is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(load(spark, sf_dir, "documents"), tag="op1")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_file(), tag="op2")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"), tag="op3")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(load(spark, sf_dir, "embeddings"), lambda id: id % 100 == 0, tag="op4")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"), tag="op5")


def op6_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(load(spark, sf_dir, "documents"), tag="op6")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(load(spark, sf_dir, "documents"), tag="op7")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: posteriors over the domains, tokens, rate and copies."""
    labels = mixing.label_domains(load(spark, sf_dir, "labels"))
    mixed, domains = mixing.mix(load(spark, sf_dir, "documents"), labels, mixing.WEIGHTS, most=mixing.MOST, tag="op8")
    posteriors = [F.get("mix_posteriors", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(domains)]
    return mixed.select("doc_id", *posteriors, F.col("mix_tokens").alias("n_tokens"), F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan(load(spark, sf_dir, "documents"), path_col="doc_id", tag="op9")
    return secrets.digest(found)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(load(spark, sf_dir, "documents"), tag="op10"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_line_dedup, op2_packing, op3_simhash_near_dedup, op4_nearest_neighbours, op5_warc, op6_context_tree_score, op7_quality_rules, op8_mixing, op9_secret_scan, op10_license_scan]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
