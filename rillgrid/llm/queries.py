"""The operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed_dedup, langid, packing, quality_knn, quality_rules, simhash, token_counts, url_filter, warc

#: The suffixes under which the crawl's sites are registered, and the declared lists of sites, by their first label.
SUFFIXES = ("example.com", "example.org", "example.net")
TRUSTED = "split_part(host, '.', 1) in ('tionsh', 'tionble', 'tiontion', 'ththth', 'thther', 'ththon', 'ththan', 'ththre')"
BLOCKED = "split_part(host, '.', 1) in ('casino-win', 'spam-farm', 'cheap-pills', 'free-bets', 'ads-track', 'adult-x')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    trusted, blocked = (url_filter.seed_sites(pages, listed, SUFFIXES) for listed in (TRUSTED, BLOCKED))
    return url_filter.filter_urls(pages, trusted, blocked, suffixes=SUFFIXES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, over its whole table."""
    return {
        "op1_quality_knn": lambda s, d: quality_knn.classify(_table(s, d, "documents"), _table(s, d, "labels")),
        "op2_warc": lambda s, d: warc.archive_and_read(_table(s, d, "pages")),
        "op3_packing": lambda s, d: packing.pack_documents(_table(s, d, "documents")),
        "op4_bpe": lambda s, d: bpe.encode(_table(s, d, "documents")),
        "op5_simhash_dedup": lambda s, d: simhash.near_duplicates(_table(s, d, "documents")),
        "op6_token_counts": lambda s, d: token_counts.prefix_table(_table(s, d, "documents")),
        "op7_language_id": lambda s, d: langid.identify(_table(s, d, "documents")),
        "language_id_pages": lambda s, d: langid.identify(langid.pages_as_documents(_table(s, d, "pages")), id_column="page_id"),
        "op8_url_filter": _urls,
        "op9_embedding_dedup": lambda s, d: embed_dedup.near_duplicates(_table(s, d, "embeddings")),
        "op10_quality_rules": lambda s, d: quality_rules.judge(_table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """SQL that DuckDB runs, where SQL expresses the operator."""
    return {
        "op2_warc": warc.duckdb_sql(),
        "op8_url_filter": url_filter.duckdb_sql(TRUSTED, BLOCKED, suffixes=SUFFIXES),
        "op10_quality_rules": quality_rules.duckdb_sql(),
    }
