"""Traversal of a link table, a level a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.session import materialize


def discover(links: DataFrame, visited: DataFrame, keep: Column | None = None) -> DataFrame:
    """(url) linked to but not visited; links: (src_url, dst_url), visited: (url). Null targets are left out."""
    found = links.where(F.col("dst_url").isNotNull())
    if keep is not None:
        found = found.where(keep)
    return found.select(F.col("dst_url").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")


def breadth_first(links: DataFrame, seeds: DataFrame, max_depth: int = 3, keep: Column | None = None) -> DataFrame:
    """(url, depth) of all urls reached from seeds (url) over links (src_url, dst_url), by the least number of steps.

    A level is one join of its front with the links and one anti-join with what is visited; each level is written.
    `keep` is a condition on links. A target that a tenth of all links share is one row after the first distinct.
    """
    edges = links.select("src_url", "dst_url") if keep is None else links.where(keep).select("src_url", "dst_url")
    edges = materialize(edges.where("src_url is not null and dst_url is not null").distinct(), "links")
    front = materialize(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)), "front")
    visited = front
    for depth in range(1, max_depth + 1):
        reached = edges.join(front.select(F.col("url").alias("src_url")), "src_url", "left_semi").select(F.col("dst_url").alias("url")).distinct()
        front = materialize(reached.join(visited, "url", "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        visited = visited.unionByName(front)
    return visited


def best_first(links: DataFrame, seeds: DataFrame, score: Column, max_pages: int = 100, batch: int = 10, keep: Column | None = None, classic: bool = False) -> DataFrame:
    """(url, step, score): the best-scored waiting urls first, `batch` at a time, up to max_pages; ties by url (if classic by depth, then url).

    score is a condition-free expression on a column url. The batches are a feature of the crawl, not a cap on data.
    """
    edges = links.select("src_url", "dst_url") if keep is None else links.where(keep).select("src_url", "dst_url")
    edges = materialize(edges.where("src_url is not null and dst_url is not null").distinct(), "links")
    waiting = materialize(seeds.select("url").where("url is not null").distinct().withColumn("score", score.cast("double")).withColumn("depth", F.lit(0)), "waiting")
    order = [F.desc("score"), *(["depth"] if classic else []), "url"]
    done, left, step = None, max_pages, -1
    while left > 0:
        step += 1
        chosen = materialize(waiting.orderBy(*order).limit(min(batch, left)).withColumn("step", F.lit(step)), "chosen")
        n = chosen.count()
        if not n:
            break
        left -= n
        done = chosen if done is None else done.unionByName(chosen)
        new = edges.join(chosen.select(F.col("url").alias("src_url"), "depth"), "src_url").groupBy(F.col("dst_url").alias("url")).agg((F.min("depth") + 1).alias("depth")).withColumn("score", score.cast("double"))
        # a url keeps the depth at which it was met first
        waiting = materialize(waiting.unionByName(new.select("url", "score", "depth")).groupBy("url").agg(F.first("score").alias("score"), F.min("depth").alias("depth")).join(done.select("url"), "url", "left_anti"), "waiting")
    if done is None:
        return links.sparkSession.createDataFrame([], "url string, step int, score double")
    return done.select("url", "step", F.round("score", 6).alias("score"))


def depth_first(links: DataFrame, seeds: DataFrame, max_pages: int = 50, max_depth: int = 3, fetched: DataFrame | None = None) -> DataFrame:
    """(url, step, depth) in depth-first order: a page's links wait in their order (pos), the first is followed first.

    With `fetched` (url), only urls it holds count as pages, are given back and lead on, as in the classic crawl.

    The order is sequential by nature, so each step is one small look-up in the written link table, at most max_pages
    of them; what is held on the driver is the stack of those pages' links. Urls are met once, at discovery.
    """
    spark = links.sparkSession
    edges = materialize(links.where("src_url is not null and dst_url is not null").groupBy("src_url", "dst_url").agg(F.min("pos").alias("pos")), "links")
    start = [r.url for r in seeds.select("url").where("url is not null").distinct().orderBy("url").limit(max_pages).collect()]
    stack, seen, out = [(u, 0) for u in reversed(start)], set(start), []
    while stack and len(out) < max_pages:
        url, depth = stack.pop()
        if fetched is not None and fetched.where(F.col("url") == url).isEmpty():
            continue
        out.append((url, len(out), depth))
        if depth < max_depth:
            new = [r.dst_url for r in edges.where(F.col("src_url") == url).orderBy("pos", "dst_url").select("dst_url").collect() if r.dst_url not in seen]
            seen.update(new)
            stack += [(u, depth + 1) for u in reversed(new)]
    return spark.createDataFrame(out, "url string, step int, depth int")


def adaptive(links: DataFrame, texts: DataFrame, seeds: DataFrame, query: str, max_pages: int = 100, batch: int = 10, bound: float = 0.85) -> DataFrame:
    """(url, step, coverage, consistency, saturation): the best waiting urls for a query, until what is read suffices.

    texts: (url, text). A waiting url scores by the query words in it. After each batch the terms of all texts read
    so far are counted anew from the written pages; the crawl stops when they have converged.
    """
    from webloom.functions.urls import keyword_score
    from webloom.operators import stats
    from webloom.operators.rank import query_words

    words = sorted(set(query_words(query)))
    edges = materialize(links.where("src_url is not null and dst_url is not null").select("src_url", "dst_url").distinct(), "links")
    score = keyword_score(F.col("url"), words)
    waiting = materialize(seeds.select("url").where("url is not null").distinct().withColumn("score", score), "waiting")
    read, rows, spark = [], [], links.sparkSession
    step = -1
    while len(read) < max_pages:
        step += 1
        chosen = materialize(waiting.orderBy(F.desc("score"), "url").limit(min(batch, max_pages - len(read))), "chosen")
        urls = [r.url for r in chosen.orderBy(F.desc("score"), "url").select("url").collect()]  # at most a batch
        if not urls:
            break
        read += urls
        done = spark.createDataFrame(list(zip(read, range(len(read)), strict=True)), "url string, seq int")  # at most max_pages
        known = materialize(texts.join(done, "url").groupBy("url", "seq").agg(F.max("text").alias("text")), "known")
        terms, n = materialize(stats.term_statistics(known, "url", "text"), "terms"), known.count()
        facts = [stats.coverage(terms, words).first()[0], stats.consistency(terms, n).first()[0], stats.saturation(known, "text", "seq").first()[0]]
        rows += [(u, step, *facts) for u in urls]
        if stats.converged(*facts, n, bound):
            break
        new = edges.join(chosen.select(F.col("url").alias("src_url")), "src_url", "left_semi").select(F.col("dst_url").alias("url")).distinct().withColumn("score", score)
        waiting = materialize(waiting.unionByName(new).dropDuplicates(["url"]).join(done, "url", "left_anti"), "waiting")
    return spark.createDataFrame(rows, "url string, step int, coverage double, consistency double, saturation double")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node each node of (a, b) edges is connected to, by alternating large and small stars.

    A root has no row of its own. Rounds grow with the logarithm of the longest path; each is written, so lineage
    stays short.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(e, "stars")
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def crawl_levels(links: DataFrame, seeds: DataFrame, fetched: DataFrame | None = None, score: Column | None = None, max_depth: int = 3, max_pages: int | None = None, visited: DataFrame | None = None, stop=None):  # noqa: ANN001, ANN201
    """Levels of a crawl as they are done: yields (url, parent_url, depth, ok) tables, each written.

    Only urls that `fetched` (url) holds count as pages and lead on (all do without it); what is found on a level is
    cut to the pages that are left, the best by `score` (a column on url) first, else by url. A crawl is resumed by
    giving its front as seeds and what it met as `visited`; `stop`, asked before each level, ends it early.
    """
    edges = materialize(links.where("src_url is not null and dst_url is not null").select("src_url", "dst_url").distinct(), "links")
    front = materialize(seeds.where("url is not null").groupBy("url").agg(F.lit(None).cast("string").alias("parent_url")).withColumn("depth", F.lit(0)), "front")
    met = front.select("url") if visited is None else front.select("url").unionByName(visited.select("url"))
    pages = 0
    for depth in range(max_depth + 1):
        if (stop is not None and stop()) or (max_pages is not None and pages >= max_pages) or front.isEmpty():
            return
        ok = fetched.select("url").distinct().withColumn("ok", F.lit(True)) if fetched is not None else None
        level = front.withColumn("ok", F.lit(True)) if ok is None else front.join(ok, "url", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        level = materialize(level, "level")
        yield level
        pages += level.where("ok").count()
        if depth == max_depth:
            return
        found = edges.join(level.where("ok").select(F.col("url").alias("src_url")), "src_url", "left_semi")
        new = found.groupBy(F.col("dst_url").alias("url")).agg(F.min("src_url").alias("parent_url")).join(met, "url", "left_anti").withColumn("depth", F.lit(depth + 1))
        front = materialize(new, "front")
        if max_pages is not None and front.count() > max_pages - pages:  # the crawl's capacity, a feature
            front = materialize(front.orderBy(*([score.desc()] if score is not None else []), "url").limit(max(0, max_pages - pages)), "front")
        met = materialize(met.unionByName(front.select("url")), "met")


def classic_breadth_first(links: DataFrame, seeds: DataFrame, fetched: DataFrame, score: Column | None = None, max_depth: int = 3, max_pages: int = 100) -> DataFrame:
    """(url, parent_url, depth, ok) of a whole crawl by levels (see crawl_levels)."""
    out = None
    for level in crawl_levels(links, seeds, fetched, score, max_depth, max_pages):
        out = level if out is None else out.unionByName(level)
    return out if out is not None else links.sparkSession.createDataFrame([], "url string, parent_url string, depth int, ok boolean")
