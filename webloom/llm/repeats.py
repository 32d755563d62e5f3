"""Lines repeated across one site's documents (problem 3).

Every distinct url of a site gets a dense number; the documents of a line are kept as bitmaps over those
numbers, cut into chunks of 32,768 (so a site that holds a third of all rows spreads over many chunks and no
group is larger than one chunk). Bitmaps of variants of one line are united, counted exactly and held against
the thresholds; removal looks a line's key up among the repeated ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.session import materialize

MIN_URLS = 8
MIN_SHARE = 0.2


def site_of(url: Column) -> Column:
    """Host in lower case without a leading `www.`; null where the url has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def line_key(line: Column) -> Column:
    """Lower case, letters and digits only, each run of 0-9 as one 0."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", ""), "[0-9]+", "0")


def page_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "markdown") -> DataFrame:
    """(id, url, site, line_no, h1, h2, variant) of each line that holds a letter or digit.

    h1 and h2 are two independent 64-bit hashes of the line's key, variant one of the line as written.
    """
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(text_col).alias("_text"))
    src = src.where(F.col("_text").isNotNull() & F.col("_url").isNotNull())
    src = src.select("_id", "_url", site_of(F.col("_url")).alias("_site"), F.posexplode(F.split("_text", "\n")).alias("line_no", "_line"))
    src = src.where(F.col("_site").isNotNull()).select("_id", "_url", "_site", "line_no", "_line", line_key(F.col("_line")).alias("_key"))
    return src.where(F.col("_key") != "").select(
        "_id", "_url", "_site", "line_no",
        F.xxhash64("_site", "_key").alias("h1"), F.xxhash64(F.lit(7), "_key", "_site").alias("h2"), F.xxhash64("_line").alias("variant"),
    )


def repeated_keys(pages: DataFrame, min_urls: int = MIN_URLS, min_share: float = MIN_SHARE, **cols: str) -> tuple[DataFrame, DataFrame]:
    """The lines (as page_lines) and the keys (h1, h2, n_urls, n_site) of those repeated in their site."""
    lines = page_lines(pages, **cols)
    url_col, text_col = cols.get("url_col", "url"), cols.get("text_col", "markdown")
    urls = pages.where(F.col(text_col).isNotNull() & F.col(url_col).isNotNull()).select(F.col(url_col).alias("_url")).distinct()
    urls = urls.select("_url", site_of(F.col("_url")).alias("_site")).where(F.col("_site").isNotNull())
    # sorted by site, so that one site's numbers lie together; the written table fixes them
    numbered = urls.repartitionByRange("_site", "_url").sortWithinPartitions("_site", "_url").select("_url", "_site", F.monotonically_increasing_id().alias("no"))
    numbered = materialize(numbered, "urls")
    sites = numbered.groupBy("_site").agg(F.count(F.lit(1)).alias("n_site"))

    # a line of fewer occurrences than min_urls can't reach min_urls urls
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_urls).select("h1", "h2")
    hits = lines.select("_url", "h1", "h2", "variant").join(often, ["h1", "h2"], "left_semi").distinct()
    hits = hits.join(numbered, "_url").select("_site", "h1", "h2", "variant", F.bitmap_bucket_number("no").alias("chunk"), F.bitmap_bit_position("no").alias("bit"))
    hits = hits.repartition("_site", "h1", "h2", "chunk")
    variants = hits.groupBy("_site", "h1", "h2", "chunk", "variant").agg(F.bitmap_construct_agg("bit").alias("bits"))
    united = variants.groupBy("_site", "h1", "h2", "chunk").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    counted = united.groupBy("_site", "h1", "h2").agg(F.sum("n").alias("n_urls"))
    keys = counted.join(sites, "_site").where((F.col("n_urls") >= min_urls) & (F.col("n_urls") >= F.col("n_site") * F.lit(min_share) - F.lit(1e-9)))
    return lines, keys.select("h1", "h2", "n_urls", "n_site")


def find_repeated_lines(pages: DataFrame, min_urls: int = MIN_URLS, min_share: float = MIN_SHARE, **cols: str) -> DataFrame:
    """(page_id, line_no) of each line that stands under at least min_urls distinct urls of its site and min_share of them.

    Rows with a null url or text have no lines; an empty table gives an empty result; repeated rows count once
    (urls are distinct) and each of them gets its own result rows. Other columns of the input are ignored.
    """
    lines, keys = repeated_keys(pages, min_urls, min_share, **cols)
    keys = materialize(keys, "repeated")
    found = lines.join(keys.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return found.select(F.col("_id").alias(cols.get("id_col", "page_id")), "line_no").distinct()


def remove_repeated_lines(pages: DataFrame, min_urls: int = MIN_URLS, min_share: float = MIN_SHARE, **cols: str) -> DataFrame:
    """pages with the text column cut down to the lines that are not repeated, and removed_lines, their number.

    Rows without text or url stay as they are, with removed_lines 0. Line numbers are looked up per page id.
    """
    id_col, text_col = cols.get("id_col", "page_id"), cols.get("text_col", "markdown")
    gone = find_repeated_lines(pages, min_urls, min_share, **cols).groupBy(F.col(id_col).alias("_gid")).agg(F.collect_set("line_no").alias("_gone"))
    split = F.split(F.col(text_col), "\n")
    kept = F.filter(F.transform(split, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(F.col("_gone"), s["i"]))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    joined = pages.join(gone, pages[id_col] == gone["_gid"], "left")
    return joined.withColumn(text_col, text).withColumn("removed_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("int")).drop("_gid", "_gone")
