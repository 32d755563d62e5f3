"""Relevance: BM25 over a corpus and within single texts."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.stem import stem, stems
from webloom.functions.text import EDGE, STOP_WORDS, content_words, let, words
from webloom.session import materialize

#: Weight of the element a chunk stands in.
TAG_WEIGHTS = {"h1": 5.0, "h2": 4.0, "h3": 3.0, "h4": 2.5, "h5": 2.0, "h6": 2.0, "title": 4.0, "strong": 2.0, "b": 1.5, "em": 1.5, "code": 2.0, "pre": 1.5, "th": 1.5, "blockquote": 2.0}


def tokens(text: Column) -> Column:
    """Stems of the lower-case words of at least two bytes that are no stop words."""
    return stems(content_words(words(text, EDGE), 2))


def query_words(query: str) -> list[str]:
    out = [w.strip(".,;:!?\"'()[]{}") for w in query.lower().split()]
    return [w for w in out if len(w.encode()) >= 2 and w not in STOP_WORDS]


def query_tokens(query: str) -> list[str]:
    """Stems of a query's words, with repeats."""
    return [stem(w) for w in query_words(query)]


def bm25(df: DataFrame, key: str, text: str, query: str, k1: float = 2.0, b: float = 0.75, threshold: float = 0.0) -> DataFrame:
    """(key, score) of the texts that hold a query word, by BM25 over all of df.

    A query word counts as often as it is repeated. Token counts are made per row before anything is shuffled; only the rows of
    the few query words and two totals cross the network.
    """
    weight = Counter(query_tokens(query))
    terms = sorted(weight)
    if not terms:
        return df.select(F.col(key), F.lit(0.0).alias("score"))
    wanted = F.array(*[F.lit(t) for t in terms])

    def count(t: Column) -> Column:
        hits = F.transform(wanted, lambda q: F.struct(q.alias("term"), F.size(F.filter(t, lambda x: x == q)).alias("tf")))
        return F.struct(F.size(t).alias("len"), F.filter(hits, lambda h: h["tf"] > 0).alias("hits"))

    per = df.where(F.col(text).isNotNull()).select(F.col(key), let(tokens(F.col(text)), count).alias("c")).select(key, "c.len", "c.hits")
    per = materialize(per, "hits")  # texts are read and cut once; three small passes follow
    totals = per.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean")).first()
    rows = per.select(key, "len", F.explode("hits").alias("h")).select(key, "len", "h.term", "h.tf")
    df_of = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = rows.join(F.broadcast(df_of), "term")  # one row a query word
    times = F.map_from_arrays(wanted, F.array(*[F.lit(weight[t]) for t in terms]))
    idf = F.element_at(times, F.col("term")) * F.log((F.lit(totals.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(totals.mean or 1.0)))
    return scored.groupBy(key).agg(F.round(F.sum(idf * norm), 6).alias("score")).where(F.col("score") >= threshold)


def relevance(text: Column, query: str, k1: float = 1.5, b: float = 0.75, mean: float = 100.0) -> Column:
    """BM25 of one text by itself: every query word counts as standing in half of all texts."""
    wanted = F.array(*[F.lit(q) for q in query_tokens(query)]).cast("array<string>")

    def score(t: Column) -> Column:
        def part(q: Column) -> Column:
            tf = F.size(F.filter(t, lambda x: x == q))
            return math.log(2.0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size(t) / mean))

        total = F.aggregate(F.transform(wanted, part), F.lit(0.0), lambda s, v: s + v)
        return F.when(F.size(t) == 0, 0.0).otherwise(F.round(total, 6))

    return let(tokens(text), score)


def relevant_texts(df: DataFrame, text: str, query: str, least: float = 0.5) -> DataFrame:
    """df with `score` and `kept`: whether a text's relevance to the query reaches the least score; without a query all are kept, at 1."""
    if not query_tokens(query):
        return df.withColumn("score", F.lit(1.0)).withColumn("kept", F.lit(True))
    return df.withColumn("score", relevance(F.col(text), query)).withColumn("kept", F.coalesce(F.col("score") >= least, F.lit(False)))


def relevant_paragraphs(df: DataFrame, key: str, text: str, query: str, least: float = 0.5) -> DataFrame:
    """(key, text) with only the paragraphs (parted by empty lines) that reach the least score, in their order; '' if none does."""
    parts = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n\n")).alias("pos", "part")).withColumn("part", F.btrim("part", F.lit(" \t\r\n")))
    scored = relevant_texts(parts.where("part <> ''"), "part", query, least).where("kept").groupBy(key)
    joined = scored.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n\n").alias("kept_text"))
    return df.where(F.col(text).isNotNull()).select(key).join(joined, key, "left").select(key, F.coalesce("kept_text", F.lit("")).alias(text))


def scaled(scored: DataFrame, score: str) -> DataFrame:
    """scored with the score brought to 0..1 over all rows; a half everywhere if all are equal."""
    one = scored.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    if one.lo is None:
        return scored
    return scored.withColumn(score, F.lit(0.5) if one.hi == one.lo else F.round((F.col(score) - one.lo) / (one.hi - one.lo), 6))


def run_filters(blocks: DataFrame, stages: list) -> DataFrame:
    """Each stage takes the survivors of the one before and adds `score` and `kept`; the last stage's verdicts come back.

    A stage is a function of a table that returns it with these two columns; the plan is one chain of projections and
    filters, whatever the number of stages.
    """
    out = blocks
    for k, stage in enumerate(stages):
        out = stage(out if k == 0 else out.where("kept").drop("kept", "score"))
    return out


def bm25_blocks(blocks: DataFrame, group: str, key: str, text: str, query: str, threshold: float = 1.0, k1: float = 2.0, b: float = 0.75) -> DataFrame:
    """blocks with `score` (1 if kept, else 0) and `kept`: BM25 of each block among those of its group; all are kept without a query.

    Counts of the query's words in each block are made per row; only they, not texts, are summed by group and joined back.
    """
    weight = Counter(query_tokens(query))
    terms = sorted(weight)
    if not terms:
        return blocks.withColumn("score", F.lit(1.0)).withColumn("kept", F.lit(True))
    wanted = F.array(*[F.lit(t) for t in terms])

    def count(t: Column) -> Column:
        return F.struct(F.size(t).alias("len"), F.transform(wanted, lambda q: F.size(F.filter(t, lambda x: x == q))).alias("tf"))

    per = blocks.withColumn("_c", let(tokens(F.coalesce(F.col(text), F.lit(""))), count)).withColumn("_len", F.col("_c.len")).withColumn("_tf", F.col("_c.tf")).drop("_c")
    total = per.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_mean"), *[F.count_if(F.col("_tf")[k] > 0).alias(f"_df{k}") for k in range(len(terms))])
    joined = per.join(total, per[group].eqNullSafe(total["_g"]))
    score = F.lit(0.0)
    for k, t in enumerate(terms):
        tf = F.col("_tf")[k]
        idf = F.log((F.col("_n") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5) + 1)
        score = score + weight[t] * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(1.0)))
    return joined.withColumn("kept", score >= threshold).withColumn("score", F.when(F.col("kept"), 1.0).otherwise(0.0)).drop("_g", "_n", "_mean", "_len", "_tf", *[f"_df{k}" for k in range(len(terms))])
