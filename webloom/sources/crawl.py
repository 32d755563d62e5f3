"""Sources and sinks of crawls: capture indexes, sitemaps, robots files, caches, knowledge bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.session import materialize

CDX_SCHEMA = "url string, timestamp string, mime string, status string, digest string, length string"


def source_kind(url: Column) -> Column:
    """http, file, raw or other, by the prefix of what is to be read."""
    return F.when(url.rlike("^https?://"), "http").when(url.startswith("file://"), "file").when(url.startswith("raw:"), "raw").otherwise("other")


def capture_index(lines: DataFrame, max_urls: int | None = None) -> DataFrame:
    """HTML captures of an index in JSON lines (value): status empty or 200, the first of each normal url.

    Malformed lines and empty urls are left out. max_urls is the feature of the seeder: the first urls by name.
    """
    rec = lines.select(F.from_json("value", CDX_SCHEMA).alias("r")).select("r.*").where("url is not null and url <> ''")
    html = F.lower("mime").rlike(r"^(text/html|application/xhtml\+xml)")
    kept = rec.where(html & (F.coalesce("status", F.lit("")).isin("", "200"))).withColumn("url", urls.normalize(F.col("url")))
    first = kept.groupBy("url").agg(F.min(F.struct("timestamp", "mime", "status", "digest", "length")).alias("m")).select("url", "m.*")
    return first.orderBy("url").limit(max_urls) if max_urls else first


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(source, url, lastmod, changefreq, priority) of the <url> entries of sitemap files (source, body)."""
    entry = F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1)))
    one = files.select("source", entry.alias("e"))

    def tag(name: str) -> Column:
        return F.btrim(F.regexp_replace(F.regexp_extract("e", rf"(?is)<{name}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1), "&amp;", "&"))

    when = tag("lastmod")
    stamp = F.coalesce(F.try_to_timestamp(when), F.try_to_timestamp(when, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(when, F.lit("yyyy-MM-dd")))
    rows = one.select("source", tag("loc").alias("loc"), stamp.alias("lastmod"), tag("changefreq").alias("changefreq"), tag("priority").try_cast("double").alias("priority"))
    return rows.where("loc <> ''").select("source", urls.normalize(F.col("loc")).alias("url"), "lastmod", "changefreq", "priority")


def sitemap_children(files: DataFrame) -> DataFrame:
    """(source, url) of the sitemaps that index files name."""
    loc = F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<sitemap\b[^>]*>.*?<loc>\s*(.*?)\s*</loc>.*?</sitemap>"), F.lit(1)))
    return files.select("source", loc.alias("url")).where("url <> ''")


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """(host, url) of the Sitemap lines of robots files (host, body)."""
    line = files.select("host", F.explode(F.split("body", r"\r?\n")).alias("l"))
    return line.where(F.lower(F.btrim("l")).startswith("sitemap:")).select("host", F.btrim(F.regexp_replace("l", r"(?i)^\s*sitemap:", "")).alias("url")).where("url <> ''")


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, group, agent, kind, pattern, pos) of robots files: each user-agent line opens a group of its own.

    A group without rules has one row with kind ''.
    """
    lines = files.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "l"))
    clean = lines.select("host", "pos", F.btrim(F.regexp_replace("l", "#.*$", "")).alias("l")).where("l like '%:%'")
    parts = clean.select("host", "pos", F.lower(F.btrim(F.substring_index("l", ":", 1))).alias("k"), F.btrim(F.regexp_replace("l", "^[^:]*:", "")).alias("v")).where("k in ('user-agent', 'allow', 'disallow')")
    # one host's file is one row, so its lines are folded in that row's array
    seq = parts.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "v"))).alias("s"))
    start = F.struct(F.lit(-1).alias("g"), F.lit("").alias("a"), F.array().cast("array<struct<g:int,a:string,k:string,v:string,p:int>>").alias("o"))

    def step(acc: Column, x: Column) -> Column:
        opens = x["k"] == "user-agent"
        g = F.when(opens, acc["g"] + 1).otherwise(acc["g"])
        a = F.when(opens, F.lower(x["v"])).otherwise(acc["a"])
        row = F.struct(g.alias("g"), a.alias("a"), F.when(opens, "").otherwise(x["k"]).alias("k"), F.when(opens, "").otherwise(x["v"]).alias("v"), x["pos"].alias("p"))
        return F.struct(g.alias("g"), a.alias("a"), F.when(opens | ((x["v"] != "") & (g >= 0)), F.concat(acc["o"], F.array(row))).otherwise(acc["o"]).alias("o"))

    rows = seq.select("host", F.explode(F.aggregate("s", start, step)["o"]).alias("r"))
    return rows.select("host", F.col("r.g").alias("group"), F.col("r.a").alias("agent"), F.col("r.k").alias("kind"), F.col("r.v").alias("pattern"), F.col("r.p").alias("pos"))


def allowed_by_robots(candidates: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """candidates with `allowed`: by the first group named for the agent, else the last for all; allow before disallow.

    Patterns end in * (prefix) or $ (whole path) or are prefixes. Hosts without rules allow everything.
    """
    agent = agent.lower()
    mine = rules.where(F.lit(agent).contains(F.col("agent")) | (F.col("agent") == "*"))
    named = F.col("agent") != "*"
    chosen = mine.groupBy("host").agg(F.min(F.when(named, F.col("group"))).alias("own"), F.max(F.when(~named, F.col("group"))).alias("any"))
    group = mine.join(chosen, "host").where(F.col("group") == F.coalesce("own", "any")).where("kind <> ''")
    per_host = group.groupBy("host").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("pattern"))).alias(k) for k in ("allow", "disallow")])
    path = urls.part(F.col(url), 3)
    place = candidates.withColumn("_host", urls.host(F.col(url))).withColumn("_path", F.when(path == "", "/").otherwise(path))

    def any_of(patterns: Column) -> Column:
        def hit(p: Column) -> Column:
            cut = F.substring(p, F.lit(1), F.char_length(p) - 1)
            return F.when(p.endswith("*"), F.col("_path").startswith(cut)).when(p.endswith("$"), F.col("_path") == cut).otherwise(F.col("_path").startswith(p))

        return F.coalesce(F.exists(patterns, hit), F.lit(False))

    joined = place.join(per_host.withColumnRenamed("host", "_rules_host"), F.col("_host") == F.col("_rules_host"), "left")
    return joined.withColumn("_ok", any_of(F.col("allow")) | ~any_of(F.col("disallow"))).select(*candidates.columns, F.col("_ok").alias("allowed"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key new lacks."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def save_state(frontier: DataFrame, name: str = "state") -> DataFrame:
    """A checkpoint of a crawl's tables: written to the shared folder and read back."""
    return materialize(frontier, name)


def export_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def import_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_items(rows: DataFrame, column: str, path: str) -> DataFrame:
    """rows with `pos` and `item` (JSON) for each item of an array inside a JSON column; rows without one are left out."""
    items = F.from_json(F.get_json_object(column, path), "array<string>")
    return rows.select("*", F.posexplode(items).alias("pos", "item"))


def classic_robots(candidates: DataFrame, files: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """candidates with `allowed`, as the standard library reads robots files (host, body): the first rule that fits decides.

    Hosts without a file allow everything. A file comes to its host's urls by a join and is read once a batch.
    """
    from collections.abc import Iterator
    from urllib.robotparser import RobotFileParser

    import pyarrow as pa
    from pyspark.sql import types as T

    one = files.groupBy(F.lower("host").alias("_host")).agg(F.min("body").alias("_body"))
    joined = candidates.withColumn("_host", urls.host(F.col(url))).join(one, "_host", "left").drop("_host")
    at = candidates.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, RobotFileParser] = {}
        for b in batches:
            ok = []
            for u, body in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if body is None or u is None:
                    ok.append(True)
                    continue
                if body not in read:
                    if len(read) > 1000:
                        read.clear()
                    read[body] = RobotFileParser()
                    read[body].parse(body.splitlines())
                ok.append(read[body].can_fetch(agent, u))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ok)], names=[*b.schema.names[:-1], "allowed"])

    return joined.select(*candidates.columns, "_body").mapInArrow(run, T.StructType([*candidates.schema.fields, T.StructField("allowed", T.BooleanType())]))
