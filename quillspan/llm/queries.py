"""The registered queries of the operators: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language_id, license_scan, media, near_dedup, packing, periodic, prefix_trie, pseudo_lm, quality_model, quality_rules, url_filter, warc


def vocabulary() -> str:
    """Where the public vocabulary file of the token queries lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sites that are listed whole, by their canonical URL.
SITES = tuple(f"{name}.example.{top}/" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: First hexadecimal digits of the MD5 of those canonical URLs that stand for reported pages.
REPORTED = ("0", "1")
#: Fixed value: a host label that no page has.
AWAY = "archive."


def url_list(pages: DataFrame) -> DataFrame:
    """The list behind op8, in column ``entry``: whole sites, an eighth of the pages' canonical URLs, and as many entries as there are pages that cover none of them.

    It stands for a list that others keep, and grows with the pages.
    """
    url = F.col("url")
    path = url_filter.path_of(url)
    canonical = pages.where(url_filter.host_of(url) != "").select(F.concat(url_filter.host_of(url), F.when(path == "", F.lit("/")).otherwise(path)).alias("entry")).distinct()
    reported = canonical.where(F.substring(F.md5(F.encode("entry", "UTF-8")), 1, 1).isin(*REPORTED))
    sites = pages.sparkSession.createDataFrame([(u,) for u in SITES], "entry string")
    return sites.union(reported).union(canonical.select(F.concat(F.lit(AWAY), "entry")))


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.score(table(spark, sf_dir, "documents"))


def op2_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocabulary())


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_list(pages))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.document_runs(table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pseudo_likelihood, op2_bagminhash_dedup, op3_warc_bundles, op4_host_quality, op5_bpe, op6_license_scan, op7_best_fit_packing, op8_url_filter, op9_language_id, op10_png_media, op11_prefix_trie, op12_periodic_runs, op13_quality_classifier)}
