"""What a crawl knows so far: overlap of texts, confidence, coverage gaps, links worth following, and entries worth keeping.

Terms are lower-case words of at least three letters, digits or underscores (filters.letter_words).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.filters import RANK_WEIGHTS, letter_words
from webloom.operators import vectors as V
from webloom.session import materialize


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(key, F.array_distinct(letter_words(F.col(text))).alias("t"))


def overlapping(df: DataFrame, key: str, text: str, least: float = 0.3) -> DataFrame:
    """(a, b, overlap), a < b: pairs of texts whose sets of terms have at least `least` (above 0) of their union in common, exactly.

    Terms are put in one order, rare ones first; a pair of that overlap shares a term among the first
    n - ceil(least * n) + 1 of each text, so only those are join keys. Texts without terms have no pair.
    """
    sets = materialize(_terms(df, key, text).where(F.size("t") > 0), "terms")
    each = sets.select(key, F.size("t").alias("n"), F.explode("t").alias("term"))
    known = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy(key).orderBy("df", "term")
    placed = each.join(known, "term").withColumn("place", F.row_number().over(order))
    prefix = materialize(placed.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1) & (F.col("df") > 1)).select("term", key, "n"), "prefix")
    a, b = prefix.select("term", F.col(key).alias("a"), F.col("n").alias("na")), prefix.select("term", F.col(key).alias("b"), F.col("n").alias("nb"))
    near = (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9) & (F.col("a") < F.col("b"))
    pairs = a.join(b, "term").where(near).select("a", "b").distinct()
    full = pairs.join(sets.select(F.col(key).alias("a"), F.col("t").alias("x")), "a").join(sets.select(F.col(key).alias("b"), F.col("t").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return full.select("a", "b", F.round(both / (F.size("x") + F.size("y") - both), 6).alias("overlap")).where(F.col("overlap") >= least - 1e-9)


def mean_overlap(df: DataFrame, key: str, text: str, block: int = 2000) -> DataFrame:
    """(consistency): mean overlap of all pairs of a knowledge base's texts; 1 for fewer than two.

    A knowledge base holds what one crawl has read and fits a driver; every pair of its blocks is one row of work.
    """
    sets = _terms(df, key, text).where(F.size("t") > 0)
    spark, rows = df.sparkSession, sets.select(key, "t").orderBy(key).toLocalIterator()
    ids: dict[str, int] = {}
    held = [np.array(sorted(ids.setdefault(w, len(ids)) for w in r.t), np.int64) for r in rows]
    n = len(held)
    if n < 2:
        return spark.createDataFrame([(1.0,)], "consistency double")
    shared = spark.sparkContext.broadcast(held)
    spans = [(i, j) for i in range(0, n, block) for j in range(i, n, block)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_sets = shared.value
        for b in batches:
            total = 0.0
            for i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                left, right = all_sets[i : i + block], all_sets[j : j + block]
                width = max(int(s[-1]) for s in (*left, *right)) + 1
                x, y = (np.zeros((len(part), width), np.float32) for part in (left, right))
                for m, part in ((x, left), (y, right)):
                    for k, s in enumerate(part):
                        m[k, s] = 1
                both = x @ y.T
                ratio = both / (x.sum(1)[:, None] + y.sum(1)[None, :] - both)
                total += float(np.triu(ratio, 1).sum() if i == j else ratio.sum())
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["s"])

    work = spark.createDataFrame(spans, "i int, j int").repartition(min(64, len(spans)))
    return work.mapInArrow(add, "s double").agg(F.round(F.sum("s") / (n * (n - 1) / 2), 6).alias("consistency"))


def classic_coverage(terms: DataFrame, query: list[str], docs: int) -> DataFrame:
    """(coverage): root of the query terms' mean share of the documents, each raised by up to half for frequency, at most 1.

    terms: (term, tf, df). 0 without terms, documents or a query.
    """
    wanted = sorted(set(query))
    top = terms.agg(F.max("tf").alias("m")).first().m or 1
    boosted = F.col("df") / docs * (1 + 0.5 * F.log1p("tf") / math.log1p(top))
    if not wanted or not docs:
        return terms.sparkSession.createDataFrame([(0.0,)], "coverage double")
    hit = terms.where(F.col("term").isin(wanted) & (F.col("df") > 0))
    return hit.agg(F.round(F.least(F.lit(1.0), F.sqrt(F.coalesce(F.sum(boosted), F.lit(0.0)) / len(wanted))), 6).alias("coverage"))


def classic_saturation(history: DataFrame, order: str, new: str) -> DataFrame:
    """(saturation): 1 less the newest text's number of new terms over the first's, between 0 and 1; 0 for fewer than two texts."""
    ends = history.agg(F.max_by(new, order).alias("last"), F.min_by(new, order).alias("first"), F.count(F.lit(1)).alias("n"))
    rate = F.greatest(F.col("last"), F.lit(1)) / F.greatest(F.col("first"), F.lit(1))
    return ends.select(F.when(F.col("n") < 2, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - rate)), 6)).alias("saturation"))


def rank_links(links: DataFrame, terms: DataFrame, query: str, url: str = "dst_url", text: str = "text") -> DataFrame:
    """(url, relevance, novelty, score) of each link: query terms in its text, terms not met so far, and full authority.

    terms: (term) of what is known. A link's terms meet the known ones in one join; a url's best text counts.
    """
    wanted = sorted({w for w in query.lower().split() if len(w) > 2})
    rows = links.where(F.col(url).isNotNull()).select(url, F.array_distinct(letter_words(F.coalesce(F.col(text), F.lit("")))).alias("t")).distinct().withColumn("k", F.xxhash64(url, "t"))
    met = rows.select("k", F.explode("t").alias("term")).join(terms.select("term").distinct().withColumn("known", F.lit(1)), "term", "left")
    fresh = met.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("old"))
    a, b, c = RANK_WEIGHTS
    relevance = F.when(F.size("t") == 0, 0.0).otherwise(F.size(F.array_intersect("t", F.array(*[F.lit(w) for w in wanted]).cast("array<string>"))) / max(1, len(wanted)))
    novelty = F.coalesce((F.col("n") - F.col("old")) / F.col("n"), F.lit(0.5))
    scored = rows.join(fresh, "k", "left").select(url, relevance.alias("relevance"), novelty.alias("novelty"))
    best = scored.withColumn("score", a * F.col("relevance") + b * F.col("novelty") + c).groupBy(url).agg(F.max(F.struct("score", "relevance", "novelty")).alias("m"))
    return best.select(url, F.round("m.relevance", 6).alias("relevance"), F.round("m.novelty", 6).alias("novelty"), F.round("m.score", 6).alias("score"))


def gaps(known: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, gap): distance of each query to the nearest known vector, 1 where none is known."""
    near = V.nearest(known, queries, 1, key, vector).select("query_id", (1 - F.col("similarity")).alias("gap"))
    return queries.select(F.col(key).alias("query_id")).join(near, "query_id", "left").select("query_id", F.round(F.coalesce("gap", F.lit(1.0)), 6).alias("gap"))


def validation(found: DataFrame) -> DataFrame:
    """(confidence, widest): mean of 1 - gap over held-out queries, and the widest gap."""
    return found.agg(F.round(F.avg(1 - F.col("gap")), 6).alias("confidence"), F.round(F.max("gap"), 6).alias("widest"))


def expansion(candidates: DataFrame, found: DataFrame, queries: DataFrame, known: DataFrame, radius: float = 0.2, overlap: float = 0.85, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(key, score) of candidate links: how much of the gaps beyond the radius they would close, less for what is known already.

    found: (query_id, gap). Queries and known vectors are taken in blocks against all candidates; a candidate's parts
    are summed afterwards, so neither side has to fit one task. Null vectors are left out.
    """
    spark = candidates.sparkSession
    wide = queries.where(F.col(vector).isNotNull()).join(found.where(F.col("gap") > radius), F.col(key) == F.col("query_id")).select(vector, "gap")
    need = wide.count()
    parts = None
    for kind, rows in (("gap", wide.toLocalIterator()), ("known", known.where(F.col(vector).isNotNull()).select(vector, F.lit(0.0)).toLocalIterator())):
        done = False
        while not done:
            held = [r for _, r in zip(range(block), rows)]  # noqa: B905
            done = len(held) < block
            if not held and parts is not None:
                break
            q = np.array([r[0] for r in held], np.float64) if held else np.zeros((0, 1))
            shared = spark.sparkContext.broadcast((kind, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), np.array([r[1] for r in held], np.float64)))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                kind, q, gap = shared.value
                for b in batches:
                    if not b.num_rows:
                        continue
                    v = np.array(b.column(1).to_pylist(), np.float64)
                    s = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)) @ q.T if len(q) else np.zeros((len(v), 0))
                    gain = np.maximum(0, gap[None, :] - (1 - s)).sum(1) if kind == "gap" else np.zeros(len(v))
                    near = s.max(1) if kind == "known" and len(q) else np.full(len(v), -1.0)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gain), pa.array(near)], names=["id", "gain", "near"])

            one = candidates.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(run, "id long, gain double, near double")
            parts = one if parts is None else parts.unionByName(one)
    per = parts.groupBy("id").agg(F.sum("gain").alias("gain"), F.max("near").alias("near"))
    penalty = F.when(F.col("near") > overlap, (F.col("near") - overlap) * 2).otherwise(0.0)
    return per.select(F.col("id").alias(key), F.round(F.col("gain") * 2 / max(1, need) * (1 - penalty), 6).alias("score"))


def novel(new: DataFrame, known: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key) of new vectors that are less similar than the threshold to every known one; all if nothing is known."""
    near = V.nearest(known, new, 1, key, vector).where(F.col("similarity") >= threshold).select(F.col("query_id").alias(key))
    return new.where(F.col(vector).isNotNull()).select(key).join(near, key, "left_anti")


def until_covered(vectors: DataFrame, group: str, order: str, vector: str = "embedding", threshold: float = 0.8) -> DataFrame:
    """(group, order, coverage) of each group's vectors up to the first at which their mean pairwise distance reaches the threshold.

    Pairs aren't made: the cosines of a prefix of unit vectors sum to (|sum|² - k) / 2, so running sums by dimension do.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.withColumn("_n", norm).where("_n > 0").select(group, order, "_n", F.posexplode(vector).alias("dim", "v"))
    run = Window.partitionBy(group, "dim").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = unit.select(group, order, F.sum(F.col("v").cast("double") / F.col("_n")).over(run).alias("s"), F.count(F.lit(1)).over(run).alias("k"))
    at = sums.groupBy(group, order).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("k").alias("k"))
    at = at.select(group, order, F.when(F.col("k") > 1, F.round(1 - (F.col("q") - F.col("k")) / (F.col("k") * (F.col("k") - 1)), 6)).otherwise(0.0).alias("coverage"))
    stop = at.where(F.col("coverage") >= threshold).groupBy(group).agg(F.min(order).alias("_stop"))
    return at.join(stop, group, "left").where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")
