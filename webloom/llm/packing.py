"""Filling fixed-capacity containers with documents (problem 8).

The sizes of all documents make one histogram; dynamic programming over it chooses the bucket boundaries that
minimise padding, and containers are planned on the bucket counts alone: the largest bucket first, smaller ones
fill what is left (a plan of at most a few hundred patterns, whatever the number of documents). Each document
then only needs its rank in its bucket, which is computed by hash part and offset, never in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import materialize

#: Buckets of a window, histogram bins of a window, and documents a hash part holds while they are numbered.
BUCKETS, BINS, PART = 128, 8192, 200_000


def token_estimate(text: Column) -> Column:
    """Words / 0.75 rounded up; words are runs without space, tab, carriage return and newline."""
    return F.floor((F.regexp_count(text, F.lit(r"[^ \t\r\n]+")).cast("long") * 4 + 2) / 3).cast("long")


def boundaries(sizes: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets over ascending sizes with the least padding in total.

    cost(i, j) = sizes[j] * (N[j] - N[i]) - (S[j] - S[i]) is linear in sizes[j], so each layer of the dynamic
    program is a lower envelope of lines, walked once.
    """
    m = len(sizes)
    if m <= buckets:
        return [int(s) for s in sizes]
    total_n, total_s = np.concatenate([[0], np.cumsum(counts)]).astype(float), np.concatenate([[0], np.cumsum(counts * sizes)]).astype(float)
    best = sizes * total_n[1:] - total_s[1:]
    came = [np.zeros(m, int)]
    for _ in range(1, buckets):
        hull: list[tuple[float, float, int]] = []
        new, arg, at = np.empty(m), np.zeros(m, int), 0
        for j in range(m):
            if j:
                a, c = -total_n[j], best[j - 1] + total_s[j]
                while len(hull) >= 2 and (c - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - a):
                    hull.pop()
                hull.append((a, c, j))
            x, stay = float(sizes[j]), sizes[j] * total_n[j + 1] - total_s[j + 1]
            at = min(at, max(0, len(hull) - 1))
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            new[j], arg[j] = stay, 0
            if hull and hull[at][0] * x + hull[at][1] < 0:
                new[j], arg[j] = stay + hull[at][0] * x + hull[at][1], hull[at][2]
        best, came = new, [*came, arg]
    out, j = [], m
    for layer in reversed(came):
        if j <= 0:
            break
        out.append(int(sizes[j - 1]))
        j = int(layer[j - 1])
    return sorted(out)


@dataclass
class Slot:
    """Documents of ranks start..end of a bucket go to containers first, first+1, …, `per` to each, from place `place` on."""

    bucket: int
    start: int
    end: int
    per: int
    first: int
    place: int


def plan(bounds: list[int], counts: list[int], capacity: int) -> tuple[list[Slot], int]:
    """Containers for counts[b] documents of at most bounds[b] each: largest first, gaps filled by smaller ones."""
    left, used, slots, containers = list(counts), [0] * len(counts), [], 0
    while any(left):
        room, pattern = capacity, []
        for b in reversed(range(len(bounds))):
            per = min(left[b], room // max(1, bounds[b]))
            if per:
                pattern.append((b, per))
                room -= per * max(1, bounds[b])
        times, place = min(left[b] // per for b, per in pattern), 0
        for b, per in pattern:
            slots.append(Slot(b, used[b], used[b] + per * times, per, containers, place))
            used[b] += per * times
            left[b] -= per * times
            place += per
        containers += times
    return slots, containers


def pack(documents: DataFrame, windows: DataFrame, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(window_name, doc_id, size, piece, pieces, piece_size, container_id, place): a place for every document.

    A document larger than the capacity is cut into full containers and a rest that is packed like any other; no
    other document is cut. Null texts have no place, empty ones take none of the room; repeated rows are packed
    each. Windows are few (the table doesn't grow): rows with a null name or a capacity below 1 are left out.
    """
    spark = documents.sparkSession
    caps = {r[0]: int(r[1]) for r in windows.select("window_name", "capacity_tokens").where("window_name is not null and capacity_tokens > 0").collect()}
    schema = f"window_name string, `{doc_id}` {documents.schema[doc_id].dataType.simpleString()}, size long, piece long, pieces long, piece_size long, container_id long, place long"
    if not caps:
        return spark.createDataFrame([], schema)
    # texts are cut once; histogram, offsets and places are of the written sizes
    sized = materialize(documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), token_estimate(F.col(text)).alias("size")), "sizes")
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(c).cast("long").alias("cap")) for w, c in sorted(caps.items())]))

    def pieces(df: DataFrame) -> DataFrame:
        """Adds window, capacity and number of pieces; `rest` is the size of what doesn't fill a container."""
        df = df.select("*", each.alias("_w")).select("*", "_w.w", "_w.cap").drop("_w")
        return df.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("cap"))).cast("long")).withColumn("rest", F.col("size") - (F.col("pieces") - 1) * F.col("cap"))

    # the histogram of all documents: at most BINS sizes a window, plus the pieces that fill a container
    unit = F.greatest(F.lit(1), F.ceil(F.col("cap") / BINS)).cast("long")
    bin_of = (F.ceil(F.col("rest") / F.col("unit")) * F.col("unit")).cast("long")
    by_size = sized.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    hist = pieces(by_size).withColumn("unit", unit).groupBy("w", "cap", F.least(F.col("cap"), bin_of).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("pieces") - 1)).alias("full"))
    seen: dict[str, dict[int, int]] = {w: {} for w in caps}
    for r in hist.collect():
        seen[r.w][r.bin] = seen[r.w].get(r.bin, 0) + r.n
        if r.full:
            seen[r.w][r.cap] = seen[r.w].get(r.cap, 0) + r.full
    total, all_slots, bounds_of = 0, [], {}
    for w, bins in seen.items():
        sizes = np.array(sorted(bins), dtype=np.int64)
        counts = np.array([bins[int(s)] for s in sizes], dtype=np.int64)
        bounds_of[w] = bounds = boundaries(sizes, counts, buckets)
        at = np.searchsorted(bounds, sizes)
        per_bucket = [int(counts[at == b].sum()) for b in range(len(bounds))]
        slots, _ = plan(bounds, per_bucket, caps[w])
        all_slots += [(w, s.bucket, s.start, s.end, s.per, s.first, s.place) for s in slots]
        total = max(total, int(counts.sum()))
    if not all_slots:
        return spark.createDataFrame([], schema)

    parts = max(1, -(-total // PART))
    items = pieces(sized).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    items = items.withColumn("piece_size", F.when(F.col("piece") < F.col("pieces") - 1, F.col("cap")).otherwise(F.col("rest")))
    bucket = F.coalesce(*[F.when(F.col("w") == w, _bucket(F.col("piece_size"), b)) for w, b in bounds_of.items()])
    items = items.select("w", "_id", "size", "piece", "pieces", "piece_size", bucket.alias("bucket"), F.pmod(F.xxhash64("_id", "piece"), F.lit(parts)).alias("part"))
    offset = items.groupBy("w", "bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    offset = offset.withColumn("before", F.sum("n").over(Window.partitionBy("w", "bucket").orderBy("part")) - F.col("n")).drop("n")
    inside = Window.partitionBy("w", "bucket", "part").orderBy(F.col("piece_size").desc(), "_id", "piece")
    ranked = items.withColumn("local", F.row_number().over(inside) - 1).join(offset, ["w", "bucket", "part"])
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("local")).cast("long"))
    # the plan has at most BUCKETS rows for each pattern, and a pattern uses up a bucket: it is small whatever the input
    slots = spark.createDataFrame(all_slots, "w string, bucket int, start long, end long, per long, first long, slot_place long")
    placed = ranked.join(F.broadcast(slots), ["w", "bucket"]).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end")))
    inner = F.col("rank") - F.col("start")
    return placed.select(
        F.col("w").alias("window_name"), F.col("_id").alias(doc_id), "size", "piece", "pieces", "piece_size",
        (F.col("first") + F.floor(inner / F.col("per"))).cast("long").alias("container_id"), (F.col("slot_place") + inner % F.col("per")).cast("long").alias("place"),
    )


def _bucket(size: Column, bounds: list[int]) -> Column:
    """Index of the first bound that is at least size."""
    arr = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.size(F.filter(arr, lambda b: b < size))


def fill(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, containers, tokens, fill) of a packing."""
    caps = windows.select("window_name", F.col("capacity_tokens").alias("cap"))
    per = packed.groupBy("window_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("piece_size").alias("tokens"))
    return per.join(caps, "window_name").select("window_name", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("cap")), 4).alias("fill"))
