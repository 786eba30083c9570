"""The corpus operators as registered queries, with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, kneser_ney, license_scan, line_dedup, near_dup, neighbours, packing, secret_scan, token_output, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the list entries in force when it was fetched."""
    return url_filter.judge_captures(url_filter.captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet")), url_filter.history(spark))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines."""
    return line_dedup.line_dedup(_documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark."""
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids in Arrow files; the documents' places in them."""
    return token_output.write_tokens(_documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with license notices or tags."""
    return license_scan.license_scan(_documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups of near-duplicate documents."""
    return near_dup.near_duplicates(_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    return packing.pack(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass the language model's quality threshold."""
    return kneser_ney.quality_kept(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of secrets that the trained forest confirms."""
    return secret_scan.secret_scan(_documents(spark, sf_dir), secret_scan.train(secret_scan.labelled_findings(spark)))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every embedding."""
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_token_output": op4_token_output,
    "op5_license_scan": op5_license_scan,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_secret_scan": op9_secret_scan,
    "op10_neighbours": op10_neighbours,
}

SQL: dict[str, str] = {"op1_url_filter": url_filter.URL_FILTER_SQL, "op2_line_dedup": line_dedup.LINE_DEDUP_SQL}
