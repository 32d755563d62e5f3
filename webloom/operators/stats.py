"""Statistics over crawls, terms and domains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from webloom.functions.text import STOP_WORDS, content_words, let, paragraphs, sentence_marks, words
from webloom.session import materialize


def word_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word_count, unique_words, char_count in bytes, sentence_count, paragraph_count) of each text that is not null."""
    t = F.col(text)
    counts = let(words(t), lambda w: F.struct(F.size(w).alias("word_count"), F.size(F.array_distinct(content_words(w))).alias("unique_words")))
    one = df.where(t.isNotNull()).select(F.col(key), counts.alias("c"), F.octet_length(t).alias("char_count"), sentence_marks(t).alias("sentence_count"), paragraphs(t).alias("paragraph_count"))
    return one.select(key, "c.word_count", "c.unique_words", "char_count", "sentence_count", "paragraph_count")


def top_terms(df: DataFrame, key: str, text: str, n: int = 10, bigrams: bool = False) -> DataFrame:
    """(key, term, count, rank) of the n commonest content words, or pairs of them, of each text; ties by name.

    A text's words never leave its row: they are cut in generated code and counted, a batch of texts at a time, by
    numbers in place of words. Null texts have no rows; repeated rows give repeated rows.
    """
    w = words(F.col(text))
    if bigrams:
        # a pair has no stop word and no word of one byte
        good = lambda x: (F.octet_length(x) >= 2) & ~x.isin(STOP_WORDS)
        pairs = let(w, lambda t: F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull() & good(a) & good(b), F.concat_ws(" ", a, b))))
        terms = F.filter(pairs, lambda p: p.isNotNull())
    else:
        terms = F.filter(w, lambda x: (F.octet_length(x) >= 3) & ~x.isin(STOP_WORDS))
    id_type = to_arrow_type(df.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().dictionary_encode()
            if not len(flat):
                continue
            order = np.empty(len(flat.dictionary), np.int64)
            order[pc.sort_indices(flat.dictionary).to_numpy()] = np.arange(len(flat.dictionary))
            row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            seen, count = np.unique(row * len(order) + order[flat.indices.to_numpy()], return_counts=True)
            row, term = seen // len(order), seen % len(order)
            best = np.lexsort((term, -count, row))
            row, term, count = row[best], term[best], count[best]
            first = np.searchsorted(row, row)
            rank = np.arange(len(row)) - first + 1
            keep = rank <= n
            names = flat.dictionary.take(pc.sort_indices(flat.dictionary))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[keep])), names.take(pa.array(term[keep])), pa.array(count[keep].astype(np.int64)), pa.array(rank[keep].astype(np.int32))], names=[key, "term", "count", "rank"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, term string, count long, rank int"
    return df.where(F.col(text).isNotNull()).select(key, terms.alias("_t")).mapInArrow(run, schema)


def term_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, tf, df) over all texts."""
    w = df.where(F.col(text).isNotNull()).select(F.col(key), F.explode(content_words(words(F.col(text)), 2)).alias("term"))
    return w.groupBy("term", key).agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def domain_authority(df: DataFrame, domain: str, quality: str) -> DataFrame:
    """(domain, pages, mean, score): the mean quality, raised with the logarithm of the number of pages."""
    per = df.groupBy(domain).agg(F.count(quality).alias("pages"), F.avg(quality).alias("mean")).where("pages > 0")
    return per.select(domain, "pages", F.round("mean", 6).alias("mean"), F.round(F.col("mean") * (1 + 0.1 * F.log2(F.col("pages") + 1)), 6).alias("score"))


def coverage(terms: DataFrame, query: list[str]) -> DataFrame:
    """(coverage): share of the query's terms that the term table (term, tf) holds; 1 without terms."""
    wanted = sorted(set(query))
    if not wanted:
        return terms.sparkSession.createDataFrame([(1.0,)], "coverage double")
    return terms.where(F.col("term").isin(wanted) & (F.col("tf") > 0)).agg(F.round(F.countDistinct("term") / len(wanted), 6).alias("coverage"))


def consistency(terms: DataFrame, docs: int) -> DataFrame:
    """(consistency): 1 / (1 + coefficient of variation of the terms' frequency a document)."""
    rate = F.col("tf") / float(max(1, docs))
    return terms.agg(F.round(F.coalesce(1 / (1 + F.stddev_pop(rate) / F.avg(rate)), F.lit(0.0)), 6).alias("consistency"))


def new_terms(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(order, terms): how many terms are met for the first time in each text, texts taken in their order."""
    w = df.where(F.col(text).isNotNull()).select(F.col(order), F.explode(F.array_distinct(content_words(words(F.col(text)), 2))).alias("term"))
    return w.groupBy("term").agg(F.min(order).alias(order)).groupBy(order).agg(F.count(F.lit(1)).alias("terms"))


def _folded(df: DataFrame, domain: str, order: str, columns: list[str], start, step, finish, fields: str) -> DataFrame:  # noqa: ANN001
    """One row of `fields` for each run of a domain's rows in a range partition, rows taken in order; memory is that of one state.

    Partitions are ranges of (domain, order), so a domain with a large share of the rows spreads over many of them.
    """
    ranged = df.select(domain, F.col(order).alias("_o"), *columns).repartitionByRange(F.col(domain), F.col("_o")).sortWithinPartitions(domain, "_o")
    placed = ranged.select(F.spark_partition_id().alias("_p"), domain, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, state = None, 0, None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * len(target.names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, target.types, strict=True)], names=target.names)

        for b in batches:
            for p, key, *values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or key != now:
                    if state is not None:
                        out.append((now, part, *finish(state)))
                    now, part, state = key, p, start()
                state = step(state, *values)
            if len(out) > 10_000:
                yield batch()
        if state is not None:
            out.append((now, part, *finish(state)))
        yield batch()

    schema = f"`{domain}` {df.schema[domain].dataType.simpleString()}, part int, {fields}"
    target = to_arrow_schema(_parse_datatype_string(schema))
    return placed.mapInArrow(run, schema)


def delay_after(seq: DataFrame, domain: str, order: str, status: str, base: float = 1000.0, low: float = 100.0, high: float = 30000.0) -> DataFrame:
    """(domain, delay_ms, fails) after all responses of a domain in order: doubled by 429 and 503, cut by a quarter by 2xx.

    Without jitter. Any run of responses turns a delay d into min(max(a·d, lo), hi), and such functions compose, so
    runs are folded where they lie, in ranges of (domain, order), and then one function a range is put together: a
    domain with a large share of the responses is never in one task. Null domains are one domain.
    """

    def step(s: tuple, code: int | None) -> tuple:
        a, lo, hi, fails, reset = s
        if code in (429, 503):
            return a * 2, min(lo * 2, high), min(hi * 2, high), fails + 1, reset
        if code is not None and 200 <= code < 300:
            return a * 0.75, max(lo * 0.75, low), max(hi * 0.75, low), 0, True
        return s

    per = _folded(seq, domain, order, [status], lambda: (1.0, 0.0, float("inf"), 0, False), step, lambda s: s, "a double, lo double, hi double, fails int, reset boolean")
    runs = per.groupBy(domain).agg(F.array_sort(F.collect_list(F.struct("part", "a", "lo", "hi", "fails", "reset"))).alias("r"))  # at most one a range
    start = F.struct(F.lit(base).alias("d"), F.lit(0).alias("f"))
    done = F.aggregate("r", start, lambda s, x: F.struct(F.least(F.greatest(s["d"] * x["a"], x["lo"]), x["hi"]).alias("d"), F.when(x["reset"], x["fails"]).otherwise(s["f"] + x["fails"]).alias("f")))
    return runs.select(domain, F.round(done["d"], 6).alias("delay_ms"), done["f"].alias("fails"))


def dispatch_stats(log: DataFrame, domain: str, order: str, ok: str, latency: str) -> DataFrame:
    """(domain, crawled, failed, failing, latency_ms): counts, failures since the last success, and a running mean.

    The mean takes a quarter of each new latency above 0, in whole milliseconds, starting with the first. Rounding
    makes it depend on the whole order, but it grows with what it starts from: a run of responses that gives the same
    mean from 0 and from the greatest start gives it from any. Runs are folded so in ranges of (domain, order); one
    that doesn't forget its start keeps the two, and is folded again only if they matter.
    """
    top = 1 << 50

    def step(s: tuple, good: bool | None, ms: int | None) -> tuple:
        n, bad, failing, reset, lo, hi, first = s
        if not good:
            return n, bad + 1, failing + 1, reset, lo, hi, first
        if ms is None or ms <= 0:
            return n + 1, bad, 0, True, lo, hi, first
        # from nothing (first), from the least and from the greatest mean
        return n + 1, bad, 0, True, (lo * 3 + ms) // 4, (hi * 3 + ms) // 4, ms if first == 0 else (first * 3 + ms) // 4

    rows = log.withColumn("_l", F.col(latency).cast("long"))
    per = materialize(_folded(rows, domain, order, [ok, "_l"], lambda: (0, 0, 0, False, 1, top, 0), step, lambda s: s, "crawled long, failed long, failing long, reset boolean, lo long, hi long, first long"), "runs")
    runs = per.groupBy(domain).agg(F.sum("crawled").alias("crawled"), F.sum("failed").alias("failed"), F.array_sort(F.collect_list(F.struct("part", "failing", "reset", "lo", "hi", "first"))).alias("r"))

    def put(s: Column, x: Column) -> Column:
        mean = F.when(x["first"] == 0, s["m"]).when(s["m"] == 0, x["first"]).when(x["lo"] == x["hi"], x["lo"]).otherwise(F.lit(None).cast("long"))
        return F.struct(mean.alias("m"), F.when(x["reset"], x["failing"]).otherwise(s["f"] + x["failing"]).alias("f"))

    done = F.aggregate("r", F.struct(F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("f")), put)
    out = materialize(runs.select(domain, "crawled", "failed", done["f"].cast("int").alias("failing"), done["m"].alias("latency_ms")), "dispatch")
    unsure = out.where("latency_ms is null").select(domain)
    if unsure.isEmpty():
        return out
    # some run of these domains was too short to forget its start: one state walks through their responses in order
    again = rows.join(unsure, domain, "left_semi").select(domain, F.col(order).alias("_o"), ok, "_l").repartition(domain).sortWithinPartitions(domain, "_o").select(domain, ok, "_l")
    schema = f"`{domain}` {log.schema[domain].dataType.simpleString()}, exact long"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mean, out = None, None, []
        for b in batches:
            for key, good, ms in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if mean is None or key != now:
                    if mean is not None:
                        out.append((now, mean))
                    now, mean = key, 0
                if good and ms and ms > 0:
                    mean = ms if mean == 0 else (mean * 3 + ms) // 4
        if mean is not None:
            out.append((now, mean))
        cols = list(zip(*out, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, target.types, strict=True)], names=target.names)

    exact = again.mapInArrow(walk, schema)
    return out.join(exact, domain, "left").select(domain, "crawled", "failed", "failing", F.coalesce("latency_ms", "exact").alias("latency_ms"))


def middle_of(rows: DataFrame, order: str, small: int = 100_000):  # noqa: ANN201
    """The lower middle value of a column, exactly: bounds around it are estimated and counted until few rows lie between them."""
    values = rows.where(F.col(order).isNotNull()).select(F.col(order).alias("o"))
    n = values.count()
    if not n:
        return None
    rank, inside, width = (n + 1) // 2, values, 0.05
    while True:
        held = inside.count()
        if held <= small:
            return inside.orderBy("o").select("o").limit(rank).agg(F.max("o")).first()[0] if held else None
        at = rank / held
        lo, hi = inside.agg(F.percentile_approx("o", [max(0.0, at - width), min(1.0, at + width)], 10000).alias("q")).first().q
        below = inside.where(F.col("o") < F.lit(lo)).count()
        upto = inside.where(F.col("o") <= F.lit(hi)).count()
        if lo == hi:
            return lo if below < rank <= upto else inside.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY o)")).first()[0]
        if not below < rank <= upto:
            width = min(1.0, width * 4)
            continue
        narrower = inside.where((F.col("o") >= F.lit(lo)) & (F.col("o") <= F.lit(hi)))
        if upto - below == held:
            return inside.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY o)")).first()[0]
        inside, rank = narrower, rank - below


def saturation(df: DataFrame, text: str, order: str) -> DataFrame:
    """(saturation): 1 less the mean number of different terms of the later half of the texts over that of all, at least 0.

    The halves are told apart by the middle value of the order, found exactly by narrowing estimated bounds.
    """
    per = df.where(F.col(text).isNotNull()).select(F.col(order).alias("o"), let(words(F.col(text)), lambda w: F.size(F.array_distinct(content_words(w, 2)))).alias("n"))
    per = materialize(per, "counts")
    middle = middle_of(per, "o")
    both = per.agg(F.avg(F.when(F.col("o") > F.lit(middle), F.col("n"))).alias("late"), F.avg("n").alias("all"))
    return both.select(F.coalesce(F.round(F.greatest(F.lit(0.0), 1 - F.col("late") / F.col("all")), 6), F.lit(0.0)).alias("saturation"))


def converged(covered: float, steady: float, saturated: float, docs: int, bound: float = 0.85, least: int = 5) -> bool:
    """Whether a crawl knows enough: weighted coverage, consistency and saturation beyond the bound after enough texts."""
    return docs >= least and 0.4 * covered + 0.3 * steady + 0.3 * saturated > bound


def token_usage(calls: DataFrame, key: str, prompt: str, completion: str) -> DataFrame:
    """(key, calls, prompt_tokens, completion_tokens, total_tokens); null counts are 0."""
    p, c = F.coalesce(F.col(prompt), F.lit(0)), F.coalesce(F.col(completion), F.lit(0))
    return calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.sum(p).cast("long").alias("prompt_tokens"), F.sum(c).cast("long").alias("completion_tokens"), F.sum(p + c).cast("long").alias("total_tokens"))


def coverage_stats(df: DataFrame, text: str) -> DataFrame:
    """(pages, characters, distinct_terms, total_terms) over all texts; terms are combined before they are shuffled."""
    rows = df.where(F.col(text).isNotNull()).select(F.length(text).alias("n"), F.filter(words(F.col(text)), lambda w: F.octet_length(w) >= 2).alias("w"))
    pages = rows.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("characters"), F.coalesce(F.sum(F.size("w")), F.lit(0)).cast("long").alias("total_terms"))
    terms = rows.select(F.explode("w").alias("t")).distinct().count()
    return pages.select("pages", "characters", F.lit(terms).alias("distinct_terms"), "total_terms")


def queue_summary(tasks: DataFrame, status: str, queued_at: str, memory: str, now) -> DataFrame:  # noqa: ANN001
    """(status, tasks, longest_wait, mean_wait, peak_memory) of queued tasks at the time `now`, waits in whole seconds."""
    wait = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp(queued_at)).cast("double")
    return tasks.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("tasks"), F.round(F.max(wait), 3).alias("longest_wait"), F.round(F.avg(wait), 3).alias("mean_wait"), F.round(F.max(memory), 3).alias("peak_memory"))


def width_stats(rows: DataFrame, keys: list[str], width: str) -> DataFrame:
    """(keys, rows, mean, variance) of the rows' numbers of columns, by table."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(width), 6).alias("mean"), F.round(F.var_pop(width), 6).alias("variance"))


def monitor(log: DataFrame, domain: str, event: str, ts: str, failed: Column, value: str, last: int = 5) -> DataFrame:
    """(domain, events, errors, total, last, last_errors): counts, a sum, the latest time, and the newest `last` failed events.

    The newest errors are picked by a bound on their rank, which is pushed below the shuffle; only they are gathered.
    """
    counts = log.groupBy(domain).agg(F.count(F.lit(1)).alias("events"), F.count_if(failed).alias("errors"), F.round(F.sum(value), 4).alias("total"), F.max(ts).alias("last"))
    rank = F.row_number().over(Window.partitionBy(domain).orderBy(F.desc(ts), F.desc(event)))
    newest = log.where(failed).select(domain, event, ts).withColumn("k", rank).where(F.col("k") <= last)
    joined = newest.groupBy(domain).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", event))), lambda x: x[event].cast("string")), ",").alias("last_errors"))
    return counts.join(joined, domain, "left").withColumn("last_errors", F.coalesce("last_errors", F.lit("")))


def live_entries(cache: DataFrame, key: str, ts: str, now, ttl_seconds: int, most: int | None = None) -> DataFrame:  # noqa: ANN001
    """(key, ts) of the entries, the newest of each key, that aren't older than the time to live; above `most` the oldest are evicted.

    The capacity is a feature of the cache; ties go by key. Null keys and times are no entries.
    """
    newest = cache.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key).agg(F.max(ts).alias(ts))
    live = newest.where(F.unix_timestamp(F.lit(now)) - F.unix_timestamp(ts) <= ttl_seconds)
    return live.orderBy(F.desc(ts), key).limit(most) if most else live
