"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import blocks, encoding, leaks, markup, neardup, packing, reading, repeats, residue, stuffing
from webloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.find_bands(table(spark, d, "crawled_data"))


def p1_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "crawled_data"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "crawled_data")).distinct()


def p2_templates(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_templates(table(spark, d, "crawled_data"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.find_repeated_lines(table(spark, d, "crawled_data"))


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawled_data").select("page_id", "url", "markdown")
    return repeats.remove_repeated_lines(pages).selectExpr("page_id", "removed_lines", "sha2(markdown, 256) AS text_hash")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.find_pairs(neardup.classes(table(spark, d, "crawled_data"), table(spark, d, "crawl_cache")), whole=True)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(neardup.classes(table(spark, d, "crawled_data"), table(spark, d, "crawl_cache")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return blocks.find_boilerplate(table(spark, d, "crawled_data")).distinct()


def p5_main_text(spark: SparkSession, d: str) -> DataFrame:
    return blocks.main_text(table(spark, d, "crawled_data"))


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return markup.find_in_plain_text(table(spark, d, "scraping_result")).unionByName(markup.find_in_markdown(table(spark, d, "crawled_data")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).select("page_id", "field_name", "markup").distinct()


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.find_stuffed(table(spark, d, "crawled_data")).select("page_id").distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(table(spark, d, "documents"), table(spark, d, "context_windows"))
    return packed.where("pieces > 1").select("window_name", "doc_id").distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    windows = table(spark, d, "context_windows")
    return packing.fill(packing.pack(table(spark, d, "documents"), windows), windows)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_levels, p2_found, p2_templates, p3_found, p3_cleaned, p4_found, p4_groups, p5_found, p5_main_text, p6_found, p6_clean, p7_found, p8_found, p8_containers, p8_fill, p9_found, p10_found, p10_restored)
}

_P3_LINES = r"""
lines AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS site,
                 unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS line_no
          FROM crawled_data WHERE markdown IS NOT NULL AND url IS NOT NULL),
keyed AS (SELECT *, regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{N}]', '', 'g'), '[0-9]+', '0', 'g') AS k FROM lines WHERE site <> ''),
n AS (SELECT site, k, count(DISTINCT url) AS n FROM keyed WHERE k <> '' GROUP BY ALL),
sites AS (SELECT site, count(DISTINCT url) AS sn FROM keyed GROUP BY ALL)
"""

SQL: dict[str, str] = {
    "p3_found": f"WITH {_P3_LINES} SELECT DISTINCT page_id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN n USING (site, k) JOIN sites USING (site) WHERE n >= 8 AND n * 5 >= sn",
    "p8_found": r"SELECT DISTINCT window_name, doc_id FROM documents, context_windows WHERE text IS NOT NULL AND ceil(len(regexp_extract_all(text, '[^ \t\r\n]+')) / 0.75) > capacity_tokens",
}
