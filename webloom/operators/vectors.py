"""Embedding vectors: similarity, search, shape."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.graph import components
from webloom.session import materialize


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where lengths differ or a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(query_id, neighbour_id, similarity, rank): the k most similar rows of vectors for each query, exactly.

    Queries are taken in blocks, each a matrix product against every batch of vectors; a batch sends on only its own
    k best a query, so the shuffle holds k rows a query and task. Rows with null vectors are left out, a query isn't
    its own neighbour, ties go to the smaller id.
    """
    rows = queries.where(F.col(vector).isNotNull()).select(key, vector).toLocalIterator()
    out, done = None, False
    while not done:
        held = [r for _, r in zip(range(block), rows)]  # noqa: B905
        done = len(held) < block
        if not held and out is not None:
            break
        ids = np.array([r[0] for r in held], np.int64)
        q = np.array([r[1] for r in held], np.float64) if held else np.zeros((0, 1))
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qi, qv = shared.value
            for b in batches:
                if not len(qi) or not b.num_rows:
                    continue
                vi = np.array(b.column(0).to_pylist(), np.int64)
                v = np.array(b.column(1).to_pylist(), np.float64)
                s = np.round(qv @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T, 9)
                s[qi[:, None] == vi[None, :]] = -np.inf
                top = np.lexsort((np.broadcast_to(vi, s.shape), -s), axis=1)[:, : k + 1]
                a, c = np.repeat(qi, top.shape[1]), vi[top].ravel()
                d = np.take_along_axis(s, top, 1).ravel()
                ok = np.isfinite(d)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(c[ok]), pa.array(d[ok])], names=["query_id", "neighbour_id", "similarity"])

        part = vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(best, "query_id long, neighbour_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "neighbour_id", F.round("similarity", 6).alias("similarity"), "rank")


def shape(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, dim, mean, std): centroid and spread of each group, dimension by dimension."""
    dims = vectors.select(group, F.posexplode(vector).alias("dim", "v"))
    return dims.groupBy(group, "dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("v").cast("double")), 6).alias("std"))


def spread(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, vectors, spread): mean of 1 - cosine over all pairs of a group, without making the pairs.

    The sum of all pairwise cosines of unit vectors is (|sum|² - n) / 2.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    dims = vectors.withColumn("_n", norm).where("_n > 0").select(group, "_n", F.posexplode(vector).alias("dim", "v"))
    sums = dims.groupBy(group, "dim").agg(F.sum(F.col("v") / F.col("_n")).alias("s"), F.count(F.lit(1)).alias("n"))
    per = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1)
    return per.select(group, F.col("n").alias("vectors"), F.when(F.col("n") > 1, F.round(1 - (F.col("q") - F.col("n")) / pairs, 6)).otherwise(0.0).alias("spread"))


def projection(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(signs a band, bands) for n vectors: between 8 and 20 signs, and as many bands as the recall at the threshold needs."""
    bits = min(20, max(8, math.ceil(math.log2(max(2, n))) - 2))
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(meet, 1 - 1e-12))))


def similar(vectors: DataFrame, threshold: float = 0.6, key: str = "vec_id", vector: str = "embedding", recall: float = 0.999, seed: int = 17) -> DataFrame:
    """(a, b, similarity), a < b: pairs of at least the threshold, found by signs of random projections and then checked.

    Vectors meet if all signs of one band agree. The signs of a band grow with the logarithm of the number of vectors,
    so that its buckets stay small, and the bands with them, so that at the threshold the share `recall` of the pairs
    is found, and more above. A band's bucket is a join key; skewed ones are split at run time. Vectors of different
    lengths don't meet.
    """
    bits, bands = projection(vectors.where(F.col(vector).isNotNull()).count(), threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            ids, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            for size in sorted({len(r) for r in rows}):
                of = [k for k, r in enumerate(rows) if len(r) == size]
                if size not in planes:
                    planes[size] = np.random.default_rng(seed + size).standard_normal((size, bands * bits))
                v = np.array([rows[k] for k in of], np.float64)
                on = (v @ planes[size] > 0).reshape(len(of), bands, bits)
                code = (on << np.arange(bits)).sum(2) + (np.arange(bands) << bits) + (np.int64(size) << 32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([ids[k] for k in of], np.int64), bands)), pa.array(code.ravel().astype(np.int64))], names=[key, "bucket"])

    given = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long"), vector)
    keys = given.mapInArrow(sign, f"`{key}` long, bucket long")
    a, b = keys.select(F.col(key).alias("a"), "bucket"), keys.select(F.col(key).alias("b"), "bucket")
    pairs = a.join(b, "bucket").where("a < b").select("a", "b").distinct()
    full = pairs.join(given.select(F.col(key).alias("a"), F.col(vector).alias("x")), "a").join(given.select(F.col(key).alias("b"), F.col(vector).alias("y")), "b")
    return full.select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("similarity")).where(F.col("similarity") >= threshold)


def clusters(vectors: DataFrame, threshold: float = 0.6, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, links): each vector's single-linkage cluster at the threshold, named by its least member, and its links."""
    edges = materialize(similar(vectors, threshold, key, vector).select("a", "b"), "similar")
    ends = edges.select(F.col("a").alias(key)).unionByName(edges.select(F.col("b").alias(key)))
    links, roots = ends.groupBy(key).agg(F.count(F.lit(1)).alias("links")), components(edges)
    out = vectors.select(F.col(key).cast("long")).join(links, key, "left").join(roots.withColumnRenamed("node", key), key, "left")
    return out.select(key, F.coalesce("root", key).alias("cluster"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
