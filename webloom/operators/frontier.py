"""Queues, retries, link filters and statistics of crawls, as tables: one row an attempt, a task, a link or a check."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.filters import fair_priority, glob_match


def filter_links(links: DataFrame, url: str, external: str, internal: bool = True, outer: bool = False, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(url) of the links to look at: internal and external ones if told, under one of the globs, under none of the others; once each.

    A null is_external counts as internal. A cap on the number is a limit after this, ordered as the caller wants.
    """
    u, out_of_site = F.col(url), F.coalesce(F.col(external), F.lit(False))
    ok = (~out_of_site & F.lit(internal)) | (out_of_site & F.lit(outer))
    for pattern in exclude or []:
        ok = ok & ~glob_match(u, pattern)
    if include:
        ok = ok & _any(glob_match(u, p) for p in include)
    return links.where(u.isNotNull() & (u != "") & ok).select(url).distinct()


def _any(columns) -> Column:  # noqa: ANN001
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def first_success(attempts: DataFrame, key: str, attempt: str, ok: str, max_retries: int = 3) -> DataFrame:
    """(key, attempts, succeeded): tries used until the first success among 1 + max_retries, or all that were made.

    Combined before the shuffle: the least successful try and the number of tries are all that is needed.
    """
    used = attempts.where(F.col(attempt) <= max_retries)
    per = used.groupBy(key).agg(F.min(F.when(F.col(ok), F.col(attempt))).alias("hit"), F.max(attempt).alias("last"))
    return per.select(key, (F.coalesce("hit", "last") + 1).cast("int").alias("attempts"), F.col("hit").isNotNull().alias("succeeded"))


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, source): the primary's value, else the fallback's; null values count as missing."""
    a, b = primary.select(key, F.col(value).alias("_a")), fallback.select(key, F.col(value).alias("_b"))
    both = a.join(b, key, "full")
    return both.select(key, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "primary").when(F.col("_b").isNotNull(), "fallback").alias("source"))


def check_stats(checked: DataFrame, verdicts: dict[str, Column]) -> DataFrame:
    """(filter, total, passed, rejected) of each named predicate over all rows, in one pass; null verdicts reject."""
    parts = [F.count(F.lit(1)).alias("total")] + [F.count_if(F.coalesce(c, F.lit(False))).alias(f"p{k}") for k, c in enumerate(verdicts.values())]
    one = checked.agg(*parts)
    rows = F.array(*[F.struct(F.lit(n).alias("filter"), F.col("total"), F.col(f"p{k}").alias("passed"), (F.col("total") - F.col(f"p{k}")).alias("rejected")) for k, n in enumerate(verdicts)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def score_stats(df: DataFrame, score: Column) -> DataFrame:
    """(count, total, average, lowest, highest) of a score."""
    one = df.select(score.alias("s")).where("s is not null")
    return one.agg(F.count("s").alias("count"), F.round(F.coalesce(F.sum("s"), F.lit(0.0)), 4).alias("total"), F.round(F.avg("s"), 6).alias("average"), F.round(F.min("s"), 6).alias("lowest"), F.round(F.max("s"), 6).alias("highest"))


def cache_stats(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """(requests, hits, misses, entries) of requests against a cache's keys; null keys miss."""
    known = cache.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    hit = requests.select(key).join(known.withColumn("_hit", F.lit(True)), key, "left")
    counts = hit.agg(F.count(F.lit(1)).alias("requests"), F.count("_hit").alias("hits"))
    return counts.select("requests", "hits", (F.col("requests") - F.col("hits")).alias("misses"), F.lit(known.count()).alias("entries"))


def head_by_url(links: DataFrame, heads: DataFrame, url: str) -> DataFrame:
    """links with the head facts of their target, null where none is known; of several heads of a url the first by title."""
    cols = [c for c in heads.columns if c != url]
    one = heads.where(F.col(url).isNotNull()).groupBy(url).agg(F.min(F.struct(*cols)).alias("_h"))
    return links.join(one.select(url, *[f"_h.{c}" for c in cols]), url, "left")


def queue(tasks: DataFrame, order: Column, wait: Column, retries: Column, fairness: float) -> DataFrame:
    """tasks with `priority` by fair_priority and `urgent`, true for those that waited too long; pop them by priority, then order."""
    return tasks.withColumn("priority", fair_priority(wait, retries, fairness)).withColumn("urgent", wait > fairness).withColumn("turn_key", order)


def within_capacity(links: DataFrame, group: str, score: Column, tie: str, capacity: int) -> DataFrame:
    """The best links of each group up to its capacity, ties by name.

    The bound on the rank is pushed below the shuffle: only the best `capacity` rows of a partition leave it.
    """
    ranked = links.withColumn("_s", score).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_s"), F.col(tie))))
    return ranked.where(F.col("rank") <= capacity).drop("_s")


def maybe_member(df: DataFrame, key: str, members: DataFrame, member_key: str, items: int, error: float = 0.01) -> DataFrame:
    """df with `maybe`, false only where the key is surely no member: a Bloom filter sized for `items` members.

    The filter is cut into bitmaps of 32,768 places; their number is set by `items` and the error, and each key looks
    up its places by a join on the bitmap's number, so nothing is sent to the driver. Null keys are no members.
    """
    bits = max(1 << 15, math.ceil(-items * math.log(error) / math.log(2) ** 2))
    hashes = max(1, round(bits / items * math.log(2)))
    hashes = min(hashes, 16)

    def places(c: str) -> Column:
        return F.explode(F.array(*[F.pmod(F.xxhash64(F.col(c), F.lit(k)), F.lit(bits)) for k in range(hashes)])).alias("at")

    put = members.where(F.col(member_key).isNotNull()).select(places(member_key))
    maps = put.groupBy(F.bitmap_bucket_number("at").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    asked = keys.select(key, places(key)).select(key, F.bitmap_bucket_number("at").alias("chunk"), F.bitmap_bit_position("at").alias("bit"))
    found = asked.join(maps, "chunk", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    set_bit = F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) > 0, F.lit(False))
    hit = found.groupBy(key).agg(F.min(set_bit).alias("maybe"))
    return df.join(hit, key, "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))
