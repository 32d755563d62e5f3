"""Whole pipelines out of single operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import filters, patterns, scoring, text, urls
from webloom.operators import rank
from webloom.session import materialize
from webloom.sources import crawl


def analyse_pages(pages: DataFrame, status: DataFrame) -> DataFrame:
    """(page_id, url, text, blocked, words, language, hash) of each page; status: (url, status), one row a url."""
    one = pages.select("page_id", "url", "html").join(status, "url", "left")
    one = one.select("page_id", "url", text.html_to_text(F.col("html")).alias("text"), patterns.blocked_reason(F.col("status"), F.col("html")).alias("blocked"))
    return one.select("page_id", "url", "text", "blocked", F.size(text.words(F.col("text"))).alias("words"), text.language(F.col("text"))["language"].alias("language"), text.content_hash(F.col("text")).alias("hash"))


def search_sources(documents: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(source, matches, score) of the k best sources: documents well above the mean score, counted and summed."""
    scored = materialize(rank.bm25(documents, "doc_id", "text", query), "scores")
    bound = scored.agg((F.avg("score") + 0.25 * F.stddev_pop("score")).alias("bound")).first().bound
    good = scored.where(F.col("score") > F.lit(bound)).join(documents.select("doc_id", "source"), "doc_id")
    per = good.groupBy("source").agg(F.count(F.lit(1)).alias("matches"), F.round(F.sum("score"), 4).alias("score"))
    # the k best are the feature: a report
    return per.orderBy(F.desc(F.col("matches") * 1.5 + F.col("score")), F.asc_nulls_last("source")).limit(k)


def first_config(candidates: DataFrame, configs: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """candidates with `config`: the name of the first (pattern, name) that fits, else null.

    A pattern is a prefix, a bare domain, or a glob in which * stops at a slash.
    """
    import re

    chosen = F.lit(None).cast("string")
    for pattern, name in reversed(configs):
        ok = F.col(url).startswith(pattern) if pattern else F.lit(False)
        if "/" not in pattern and "*" not in pattern and pattern:
            ok = ok | (urls.host(F.col(url)) == pattern.lower()) | urls.host(F.col(url)).endswith("." + pattern.lower())
        elif pattern:
            rx = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern.lower())
            ok = ok | F.lower(url).rlike(f"^{rx}$")
        chosen = F.when(ok, name).otherwise(chosen)
    return candidates.withColumn("config", chosen)


def survivors(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows whose key a filter kept."""
    return rows.join(kept.select(key).where(F.col(key).isNotNull()), key, "left_semi")


def batch_crawl(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, page_id, error) of each wanted url once: its newest page, or why there is none.

    wanted: (url); pages: (page_id, url, success). Null urls are left out.
    """
    newest = pages.where("url is not null").groupBy("url").agg(F.max(F.struct("page_id", "success")).alias("m")).select("url", "m.page_id", "m.success")
    asked = wanted.select("url").where("url is not null").distinct()
    return asked.join(newest, "url", "left").select("url", "page_id", F.when(F.col("page_id").isNull(), "not found").when(~F.col("success"), "failed").alias("error"))


@dataclass(frozen=True)
class Seeding:
    """How urls are gathered: a shell pattern, whether useless ones go, a query to score them, the least score, and how many."""

    pattern: str = "*"
    sound_only: bool = True
    query: str | None = None
    least: float | None = None
    most: int | None = None


def seed(sources: list[DataFrame], how: Seeding | None = None) -> DataFrame:
    """(url, score) of all sources (url) together, once each, by the settings; score is null without a query.

    `most` is a feature of the settings: the best by score, then name.
    """
    how, every = how or Seeding(), sources[0].select("url")
    for s in sources[1:]:
        every = every.unionByName(s.select("url"))
    u = F.col("url")
    kept = every.where(u.isNotNull() & (u != "")).distinct().where(filters.seed_match(u, how.pattern))
    if how.sound_only:
        kept = kept.where(~urls.is_nonsense(u))
    scored = kept.withColumn("score", F.round(scoring.url_relevance(u, how.query), 6) if how.query else F.lit(None).cast("double"))
    if how.query and how.least is not None:
        scored = scored.where(F.col("score") >= how.least)
    return scored.orderBy(F.desc_nulls_last("score"), "url").limit(how.most) if how.most else scored


def extraction(name: str) -> Callable[..., DataFrame]:
    """The extraction strategy of that name, a function of (pages, schema): css, xpath, engine, classic, regex or none."""
    from webloom.operators import pages

    known = {
        "css": lambda df, schema: pages.extract_records(df, schema, "css"), "xpath": lambda df, schema: pages.extract_records(df, schema, "xpath"), "engine": pages.engine_records, "classic": pages.classic_records,
        "regex": lambda df, wanted: patterns.extract_groups(df, "html", wanted), "none": lambda df, schema=None: df,
    }
    if name not in known:
        raise KeyError(f"no strategy {name!r}; there are {sorted(known)}")
    return known[name]


class Registry:
    """Crawls, filters and scorers under names; a later one of a name takes the earlier one's place."""

    def __init__(self) -> None:
        self._by_name: dict[str, Callable[..., DataFrame]] = {}

    def add(self, name: str, make: Callable[..., DataFrame]) -> None:
        self._by_name[name] = make

    def get(self, name: str) -> Callable[..., DataFrame] | None:
        return self._by_name.get(name)

    def names(self) -> list[str]:
        return sorted(self._by_name)


def discover_sitemaps(files: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(source, url, …) of the url entries of the sitemaps `roots` (url) names, and of those that index files name, down to `depth`.

    files: (source, body), bodies of gzip files already unpacked. A sitemap is read once.
    """
    level = roots.select(F.col("url").alias("source")).distinct()
    seen, found = None, None
    for _ in range(depth):
        bodies = materialize(files.join(level, "source", "left_semi"), "sitemaps")
        if bodies.isEmpty():
            break
        entries = crawl.sitemap_urls(bodies)
        found = entries if found is None else found.unionByName(entries)
        seen = level if seen is None else seen.unionByName(level)
        level = crawl.sitemap_children(bodies).select(F.col("url").alias("source")).distinct().join(seen, "source", "left_anti")
    empty = crawl.sitemap_urls(files.where("false"))
    return (found if found is not None else empty).dropDuplicates(["url"])


def search_entries(entries: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """The entries one of whose columns holds the query, in either case; null columns hold nothing."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return entries.where(hit)
