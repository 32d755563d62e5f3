"""Operators that SQL can't state, on hand-made pages and against brute force: stems, page parts, schemas, crawls, folds, medians."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.dom import extract, relevance, schema, scrape
from webloom.dom.tree import parse
from webloom.functions import filters, patterns, stem, text
from webloom.operators import chunks, frontier, graph, knowledge, pages, rank, stats, vectors
from webloom.plans import pipelines
from webloom.sources import crawl

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PAGE = (
    '<html lang="en"><head><title>T &amp; x</title><meta name="description" content="D"><meta charset="UTF-8"><link rel="icon me" href="/i"><meta property="og:title" content="OG"></head>'
    '<body><nav>n</nav><div class="a"><p>Hello <a href="/x?utm_source=1&b=2#f">link</a> 12.50</p><span>s</span></div><div class="b">next</div><img src="/a.jpg" alt="z" width="300"></body></html>'
)
ODD = [(1, "https://e.example/", PAGE), (2, None, None), (3, "https://e.example/", ""), (4, "::", "<<p><a href='http://[x'>" + "word " * 20000), (4, "::", "<p>")]


@pytest.mark.parametrize(("word", "want"), [("consigned", "consign"), ("knackeries", "knackeri"), ("foxes", "fox"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("dying", "die"), ("exceedingly", "exceed"), ("cried", "cri"), ("ties", "tie"), ("gas", "gas"), ("this", "this"), ("agreed", "agre"), ("by", "by"), ("youth", "youth"), ("adoption", "adopt"), ("", "")])
def test_stems(word, want) -> None:  # noqa: ANN001
    assert stem.stem(word) == want
    assert stem.stem_lists(pa.array([[word, word], None, []])).to_pylist() == [[want, want], None, []]


@pytest.mark.parametrize("part", [p for p in pages.PARTS])
def test_page_parts_take_odd_rows(spark, part) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(*r, "x") for r in ODD], f"page_id long, url string, html string, {part} string")
    assert pages.crawl_pages(df, [part]).count() == len(ODD)
    assert pages.crawl_pages(df.limit(0), [part]).count() == 0


def test_parts_that_change_the_tree_leave_the_others_alone(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame(ODD[:1], "page_id long, url string, html string")
    every = pages.crawl_pages(df, list(pages.PARTS)).first()
    for part in pages.PARTS:
        assert every[part] == pages.crawl_pages(df, [part]).first()[part], part


def test_scraped_page() -> None:
    s = scrape.scrape(parse(PAGE), "https://e.example/")
    assert s["links"] == [{"url": "https://e.example/x?b=2", "text": "link", "is_external": False}]
    assert s["plain_text"] == "n Hello link 12.50 s next" and s["images"][0]["score"] == 1.0 and s["metadata"]["title"] == "T & x"
    assert scrape.preview(parse(PAGE))["title"] == "OG" and scrape.classic_metadata(parse(PAGE)) == {"title": "T & x", "description": "D", "og:title": "OG"}
    assert scrape.head_facts(parse(PAGE))["link"] == {"icon": ["/i"], "me": ["/i"]}
    assert scrape.quick_links(parse(PAGE), "https://e.example/") == [{"href": "https://e.example/x?b=2", "text": "link", "is_external": False}]


def test_citations_both_ways() -> None:
    assert scrape.cited('a [b](/c "t") ![i](x.png) [d](/c)', "https://e.example/") == ("a b⟨1⟩ ![i⟨2⟩] d⟨1⟩", "\n\n## References\n\n⟨1⟩ https://e.example/c: t - b\n⟨2⟩ https://e.example/x.png: i\n")
    assert scrape.numbered("see [a](u) and [b](#x) [u](v)") == "see a [1] and [b](#x) u [2]\n\n---\n\n## References\n\n[1] u - a\n[2] v - u\n"


def test_schemas() -> None:
    d = parse(PAGE)
    assert schema.records(d, {"base": "div.a", "fields": [{"name": "p", "type": "css", "selector": "p"}, {"name": "n", "type": "regex", "selector": r"\d+\.\d+"}, {"name": "l", "type": "xpath", "selector": "//a", "attribute": "href", "is_list": True}, {"name": "no", "type": "css", "selector": "table"}]}) == [{"p": "Hello link 12.50", "n": "12.50", "l": ["/x?utm_source=1&b=2#f"], "no": ""}]
    got = schema.classic_records(d, {"baseSelector": "div.a", "baseFields": [{"name": "c", "type": "attribute", "attribute": "class"}], "fields": [{"name": "price", "selector": "p", "type": ["text", "regex"], "pattern": r"(\d+\.\d+)"}, {"name": "twice", "type": "computed", "expression": "float(price) * 2"}, {"name": "sib", "source": "+ div.b", "type": "text", "transform": "uppercase"}, {"name": "gone", "selector": "table", "type": "text"}, {"name": "bad", "type": "computed", "expression": "__import__('os')", "default": "no"}]})
    assert got == [{"c": "a", "price": "12.50", "twice": 25.0, "sib": "NEXT", "bad": "no"}]


def test_table_density_counts_markup() -> None:
    plain = "<table><tr><th>a</th><th>b</th></tr><tr><td>one</td><td>two</td></tr><tr><td>three</td><td>four</td></tr></table>"
    marked = plain.replace("<td>", '<td><b class="x">').replace("</td>", "</b></td>")
    assert [extract.tables(parse(h))[0]["score"] for h in (plain, marked)] == [0.9, 0.8]
    assert scrape.table_markdown(extract.tables(parse(plain.replace("four", "f|r")))) == "| a | b |\n| --- | --- |\n| one | two |\n| three | f\\|r |"


def test_folds_equal_walking_through(spark) -> None:  # noqa: ANN001
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), k, rng.choice([200, 200, 429, 503, 404, None]), rng.random() < 0.8, rng.randint(-5, 400)) for k in range(4000)]
    df = spark.createDataFrame(rows, "d string, o long, s int, ok boolean, l long").repartition(8)
    want: dict = {}
    for d, _, s, ok, ms in rows:
        w = want.setdefault(d, [1000.0, 0, 0, 0, 0, 0])
        if s in (429, 503):
            w[0], w[1] = min(w[0] * 2, 30000), w[1] + 1
        elif s == 200:
            w[0], w[1] = max(w[0] * 0.75, 100), 0
        w[2], w[3], w[4] = w[2] + ok, w[3] + (not ok), 0 if ok else w[4] + 1
        if ok and ms > 0:
            w[5] = ms if w[5] == 0 else (w[5] * 3 + ms) // 4
    assert {r.d: [r.delay_ms, r.fails] for r in stats.delay_after(df, "d", "o", "s").collect()} == {d: [round(w[0], 6), w[1]] for d, w in want.items()}
    got = {r.d: [r.crawled, r.failed, r.failing, r.latency_ms] for r in stats.dispatch_stats(df.where("d is not null"), "d", "o", "ok", "l").collect()}
    assert got == {d: w[2:] for d, w in want.items() if d is not None}
    assert stats.delay_after(df.limit(0), "d", "o", "s").count() == 0 and stats.dispatch_stats(df.limit(0), "d", "o", "ok", "l").count() == 0


def test_median_by_narrowing(spark) -> None:  # noqa: ANN001
    rng = random.Random(3)
    for values in ([rng.randint(0, 10**6) for _ in range(3001)], [5] * 2000, [1] * 1500 + [2] * 1500, [*range(2000), *[7] * 900], [3]):
        df = spark.createDataFrame([(v,) for v in values], "o long")
        assert stats.middle_of(df, "o", small=50) == sorted(values)[(len(values) + 1) // 2 - 1], values[:5]
    assert stats.middle_of(df.limit(0), "o") is None


def test_top_terms_take_odd_rows(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, "River river bank. Bank bank tree"), (2, None), (3, ""), (3, "river"), (3, "river")], "k long, t string")
    assert [tuple(r) for r in stats.top_terms(df, "k", "t", 2).orderBy("k", "rank").collect()] == [(1, "bank", 3, 1), (1, "river", 2, 2), (3, "river", 1, 1), (3, "river", 1, 1)]
    assert [tuple(r) for r in stats.top_terms(df, "k", "t", 1, bigrams=True).collect()] == [(1, "bank bank", 2, 1)]


def test_projection_keeps_recall() -> None:
    for n in (10, 500, 10**6, 10**9):
        bits, bands = vectors.projection(n, 0.6, 0.98)
        assert 8 <= bits <= 20 and 1 - (1 - (1 - 0.29516723530086653) ** bits) ** bands >= 0.9799


def test_overlap_equals_brute_force(spark) -> None:  # noqa: ANN001
    rng = random.Random(7)
    words = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join(rng.sample(words, rng.randint(1, 12)))) for k in range(80)] + [(100, ""), (101, None), (102, "of")]
    sets = {k: set(t.split()) for k, t in rows if t and t != "of"}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.25 * len(sets[a] | sets[b]) - 1e-9}
    df = spark.createDataFrame(rows, "k long, t string")
    assert {(r.a, r.b) for r in knowledge.overlapping(df, "k", "t", 0.25).collect()} == want and want
    ids = sorted(sets)
    mean = sum(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :]) / (len(ids) * (len(ids) - 1) / 2)
    assert abs(knowledge.mean_overlap(df, "k", "t", block=17).first()[0] - mean) < 1e-5
    assert knowledge.overlapping(df.limit(0), "k", "t").count() == 0 and knowledge.mean_overlap(df.limit(0), "k", "t").first()[0] == 1.0


def test_crawls_count_only_what_was_fetched(spark) -> None:  # noqa: ANN001
    links = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("r", "x", 2), ("a", "c", 0), ("b", "d", 0), ("x", "y", 0), ("c", "r", 0), (None, "z", 0)], "src_url string, dst_url string, pos int")
    seeds = spark.createDataFrame([("r",), (None,)], "url string")
    fetched = spark.createDataFrame([(u,) for u in "rabcd"], "url string")
    got = {(r.url, r.depth, r.ok) for r in graph.classic_breadth_first(links, seeds, fetched).collect()}
    assert got == {("r", 0, True), ("a", 1, True), ("b", 1, True), ("x", 1, False), ("c", 2, True), ("d", 2, True)}
    best = F.when(F.col("url") == "b", 1.0).otherwise(0.0)
    few = [(r.url, r.depth) for r in graph.classic_breadth_first(links, seeds, fetched, best, max_pages=2).orderBy("depth").collect()]
    assert few == [("r", 0), ("b", 1)]
    assert [r.url for r in graph.depth_first(links, seeds, 10, 3, fetched).orderBy("step").collect()] == ["r", "a", "c", "b", "d"]
    levels = []
    for level in graph.crawl_levels(links, seeds, stop=lambda: len(levels) >= 2):
        levels.append(level.count())
    assert levels == [1, 3]
    done = spark.createDataFrame([("a",), ("b",)], "url string")
    assert {r.url for lv in graph.crawl_levels(links, spark.createDataFrame([("c",)], "url string"), visited=done) for r in lv.collect()} == {"c", "r", "x", "y"}


def test_bloom_membership_never_denies_members(spark) -> None:  # noqa: ANN001
    members = spark.createDataFrame([(f"m{k}",) for k in range(500)], "u string")
    asked = spark.createDataFrame([(f"m{k}",) for k in range(0, 500, 5)] + [(f"n{k}",) for k in range(1000)] + [(None,)], "u string")
    got = frontier.maybe_member(asked, "u", members, "u", 500).collect()
    assert all(r.maybe for r in got if r.u and r.u[0] == "m") and sum(r.maybe for r in got if r.u and r.u[0] == "n") < 50
    assert not any(r.maybe for r in got if r.u is None) and len(got) == 1101


def test_filter_stages_see_survivors(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, "rivers and more rivers"), (2, "a tiny river"), (3, "mountains"), (4, None)], "k long, t string")
    long_enough = lambda x: x.withColumn("score", F.lit(1.0)).withColumn("kept", F.coalesce(F.length("t") > 10, F.lit(False)))
    got = rank.run_filters(df, [long_enough, lambda x: rank.relevant_texts(x, "t", "river")]).collect()
    assert {(r.k, r.kept) for r in got} == {(1, True), (2, True)}
    assert rank.relevant_paragraphs(spark.createDataFrame([(1, "the river\n\nthe hill\n\nrivers"), (2, None), (3, "")], "k long, t string"), "k", "t", "river").collect()[0].t == "the river\n\nrivers"
    blocks = spark.createDataFrame([(1, "g", "<p>A long enough paragraph of text that stays.</p>"), (2, "g", "<nav>x</nav>"), (3, "g", None)], "k long, g string, t string")
    assert {(r.k, r.kept) for r in pages.prune_blocks(blocks, "t").collect()} == {(1, True), (2, False), (3, False)}
    assert rank.bm25_blocks(df, "k", "k", "t", "").where("kept").count() == 4


def test_small_functions(spark) -> None:  # noqa: ANN001
    one = spark.createDataFrame([('say "x"\n' + "y" * 200, "a.jpg 1x, b.jpg 300.5w", "12em", 'x {"a": 1} {bad} {"b": 2}', "<script>a</script><p onclick='x' class=k>t  t</p><nav>n</nav>")], "t string, s string, d string, j string, h string")
    r = one.select(text.shortened(F.col("t"), 10).alias("short"), text.escaped_json(F.col("t")).alias("escaped"), filters.srcset(F.col("s")).alias("set"), filters.dimension(F.col("d")).alias("dim"), text.json_objects(F.col("j")).alias("objects"), text.preprocess(F.col("h")).alias("pre"), text.preprocess(F.col("h"), strict=True, most=5).alias("strict")).first()
    assert r.short == 'say "x"...'[:7] + "..." and r.escaped.startswith('say \\"x\\"\\n') and [tuple(x) for x in r.set] == [("a.jpg", None), ("b.jpg", "300")]
    assert tuple(r.dim) == (12, "em") and r.objects == ['{"a": 1}', '{"b": 2}'] and r.pre == "<p class=k>t t</p>" and r.strict == "<p cl"
    assert [x.c for x in one.select(F.explode(chunks.merged_below(F.array(F.lit("a b"), F.lit("c d"), F.lit("e " * 50)), 6)).alias("c")).collect()] == ["a b\n\nc d", "e " * 50]


def test_groups_and_spans(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, "on 2024-05-06 and $19.99 or $5.50"), (2, None), (3, "")], "k long, t string")
    got = patterns.extract_groups(df, "t", [("price", r"\$(\d+\.\d{2})", 1), ("date", r"(?P<y>\d{4})-(?P<m>\d{2})", 9)]).collect()
    assert [(r.pattern, r.value, r.named) for r in got] == [("price", "19.99", {}), ("price", "5.50", {}), ("date", "2024-05", {"y": "2024", "m": "05"})]
    assert [(r.value, r.start, r.stop) for r in patterns.classic_spans(df, "k", "t", ["date_iso"]).collect()] == [("2024-05-06", 3, 13)]


def test_seeding_and_sitemaps(spark) -> None:  # noqa: ANN001
    urls = spark.createDataFrame([("https://e.example/news/garden.html",), ("https://e.example/robots.txt",), ("https://e.example/x",), (None,)], "url string")
    got = pipelines.seed([urls, urls], pipelines.Seeding(pattern="*e.example/*", query="garden", most=1)).collect()
    assert [r.url for r in got] == ["https://e.example/news/garden.html"]
    files = spark.createDataFrame([("https://e.example/s.xml", "<sitemapindex><sitemap><loc>https://e.example/t.xml</loc></sitemap></sitemapindex>"), ("https://e.example/t.xml", "<urlset><url><loc>https://e.example/a</loc></url></urlset>"), ("https://e.example/u.xml", "<urlset><url><loc>https://e.example/b</loc></url></urlset>")], "source string, body string")
    roots = spark.createDataFrame([("https://e.example/s.xml",)], "url string")
    assert [r.url for r in pipelines.discover_sitemaps(files, roots).collect()] == ["https://e.example/a"]
    assert pipelines.extraction("none")(urls) is urls
    with pytest.raises(KeyError):
        pipelines.extraction("other")


def test_okapi_and_classic_relevance() -> None:
    scores = relevance.okapi([["river", "mill"], ["river", "river", "road"], ["hill"], ["hill", "tree"], ["sea"]], ["river"])
    assert scores[1] > scores[0] > 0 == scores[2]
    page = parse("<html><head><title>river</title></head><body>" + "".join(f"<p>{t}</p>" for t in ["the rivers run", "the hill", "a road", "the sea", "one tree", "the rivers run"]) + "</body></html>")
    assert [t for _, t, _ in relevance.classic_relevant(page, threshold=0.1)] == ["the rivers run"]


def test_classic_robots(spark) -> None:  # noqa: ANN001
    files = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /private\nUser-agent: goodbot\nAllow: /\n")], "host string, body string")
    asked = spark.createDataFrame([("https://a.example/private/x",), ("https://A.example/open",), ("https://b.example/private",), (None,)], "url string")
    got = {r.url: r.allowed for r in crawl.classic_robots(asked, files, "otherbot").collect()}
    assert got == {"https://a.example/private/x": False, "https://A.example/open": True, "https://b.example/private": True, None: True}
    assert all(r.allowed for r in crawl.classic_robots(asked, files, "goodbot").collect())
    assert crawl.classic_robots(asked.limit(0), files, "x").count() == 0


def test_classic_values_equal_the_spans(spark) -> None:  # noqa: ANN001
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("text is not null")
    odd = spark.createDataFrame([(10**9, "日本671 a@b.co #тег @имя 12:30 GB33BUKB20201555555555 AA:bb:CC:dd:EE:ff 4111111111111 €5 ½")], "doc_id long, text string")
    both = docs.unionByName(odd)
    values = sorted((r.doc_id, r.label, r.value) for r in patterns.classic_values(both, "text").collect())
    assert values == sorted((r.doc_id, r.label, r.value) for r in patterns.classic_spans(both, "doc_id", "text").collect()) and values
