from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from webloom.functions import patterns, scoring, text, urls
from webloom.operators import chunks, diff, graph, stats, vectors
from webloom.sources import crawl
from webloom.streaming import crawl as streaming


def one(spark, column, value, kind="string"):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("html", "want"), [("<p>Hello <b>world</b></p>", "Hello world"), ("<style>x{}</style>a<script>b</script>c", "a c"), ("Line one<br/>Line two<hr/>End", "Line one Line two End"), ("", "")])
def test_html_to_text(spark, html, want) -> None:  # noqa: ANN001
    assert one(spark, text.html_to_text, html) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("HTTPS://Ex.example:443/a/?utm_source=x&b=2&a=1#f", "https://ex.example/a?a=1&b=2"), ("http://ex.example:80", "http://ex.example/"), ("http://ex.example:8080/x//", "http://ex.example:8080/x"), ("no url", "no url")],
)
def test_crawl_normal_form(spark, raw, want) -> None:  # noqa: ANN001
    assert one(spark, lambda c: urls.normalize(c, "crawl"), raw) == want


def test_content_normal_form_keeps_clean_queries(spark) -> None:  # noqa: ANN001
    assert one(spark, urls.normalize, "https://Ex.example/a/?b=2&a=1") == "https://ex.example/a?b=2&a=1"
    assert one(spark, urls.normalize, "https://ex.example/a?b=2&a=1&fbclid=3") == "https://ex.example/a?a=1&b=2"


@pytest.mark.parametrize(("url", "want"), [("https://x.example/2025/01/", 1.0), ("https://x.example/2024-03/a", 0.8), ("https://x.example/2021/1/a", 0.4), ("https://x.example/2010/1/a", 0.2), ("https://x.example/", 0.5), ("https://x.example/2099/1/", 0.5)])
def test_freshness(spark, url, want) -> None:  # noqa: ANN001
    assert one(spark, lambda c: urls.freshness_score(c, 2025), url) == want


def test_syllables_and_language(spark) -> None:  # noqa: ANN001
    for word, n in (("the", 1), ("table", 2), ("wanted", 2), ("baked", 1), ("area", 2)):
        assert one(spark, text.syllables, word) == n, word
    for sample, lang in (("the cat and the dog of it", "en"), ("der Hund und die Katze nicht", "de"), ("これは本です", "ja"), ("это книга", "ru"), ("", "unknown"), ("한국어 문장", "ko")):
        assert one(spark, text.language, sample)["language"] == lang, sample


@pytest.mark.parametrize(
    ("status", "html", "want"),
    [
        (200, "<html><body><p>" + "word " * 60 + "</p></body></html>", None), (429, "", "rate limited (429)"), (403, "<html>no</html>", "blocked (403)"),
        (200, "<html><body><p>" + "x " * 80 + "Access Denied</p></body>", "access denied"), (200, "short", "near-empty response"), (403, '{"a": 1}', "structural integrity failure"), (None, None, "structural integrity failure"),
    ],
)
def test_block_pages(spark, status, html, want) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(status, html)], "s int, h string")
    assert df.select(patterns.blocked_reason(F.col("s"), F.col("h")).alias("r")).first().r == want


def test_chunkers(spark) -> None:  # noqa: ANN001
    assert one(spark, lambda c: chunks.windows(c, 4, 2), "abcdefgh") == ["abcd", "cdef", "efgh"]
    assert one(spark, lambda c: chunks.word_windows(c, 2), "a b c") == ["a b", "c"]
    assert one(spark, lambda c: chunks.aligned_word_windows(c, 3, 2), "a b c d e f") == ["a b c", "c d e", "d e f"]
    assert one(spark, lambda c: chunks.sentences(c), "One. Two! Three\nFour") == ["One.", "Two!", "Three", "Four"]
    assert one(spark, lambda c: chunks.topics(c, 0.5), "a b c\n\nb c d\n\nx y z") == ["a b c\n\nb c d", "x y z"]
    assert one(spark, lambda c: chunks.windows(c, 4, 2), "") == []
    assert "".join(chunks.fixed_size("word " * 100, 60)).replace(" ", "") == "word" * 100
    assert chunks.token_aware("a b c\n\nd e f\n\ng h i", 8) == ["a b c\n\nd e f", "g h i"]
    assert chunks.markdown_sections("# A\n" + "x" * 50 + "\n# B\n```\n# no\n```", 40) == ["# A\n" + "x" * 50, "# B\n```\n# no\n```"]


def test_long_sections_are_split_but_fences_are_not() -> None:
    fence = "```\n" + "code. " * 15 + "\n```"
    text = "# A\n\n" + "One two three. " * 9 + "\n\n" + "y" * 130 + "\n" + fence + "\nAfter.\n# B\nshort"
    got = chunks.markdown_sections(text, 60, split=True)
    assert all(len(c) <= 60 or c == fence for c in got) and fence in got and got[-1] == "# B\nshort"
    assert "".join("".join(got).split()) == "".join(text.split())
    assert chunks.hard_split("One two. Three four five", 12) == ["One two.", "Three four", "five"]
    assert chunks.hard_split("abcdefgh", 3) == ["abc", "def", "gh"]


@pytest.mark.parametrize(("old", "new", "want"), [("a\nb", "a\nb", (0, 0, 2, 1.0)), ("alpha\nbeta", "gamma\ndelta", (2, 2, 0, 0.0)), ("a\nb\nc", "a\nb\nd", (1, 1, 2, 0.666667)), ("", "", (0, 0, 0, 0.0)), ("a\na", "a", (0, 1, 1, 1.0))])
def test_line_diff(spark, old, new, want) -> None:  # noqa: ANN001
    a, b = (spark.createDataFrame([(1, t)], "k int, t string") for t in (old, new))
    r = diff.line_diff(a, b, "k", "t").first()
    assert (r.added, r.removed, r.unchanged, r.similarity) == want


def test_breadth_first_on_cycle_diamond_and_island(spark) -> None:  # noqa: ANN001
    edges = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "r"), ("c", "d"), ("x", "y"), ("r", None)]
    links = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src_url string, dst_url string, front int")
    seeds = spark.createDataFrame([("r",)], "url string")
    assert {tuple(r) for r in graph.breadth_first(links, seeds, 5).collect()} == {("r", 0), ("a", 1), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.url for r in graph.breadth_first(links, seeds, 1).collect()} == {"r", "a", "b"}
    best = graph.best_first(links, seeds, F.when(F.col("url") == "b", 1.0).otherwise(0.5), 3, 1).orderBy("step").collect()
    assert [r.url for r in best] == ["r", "b", "a"]


def test_vectors(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 0), (4, None, 0)], "vec_id long, embedding array<float>, label int")
    got = [(r.query_id, r.neighbour_id, r["rank"]) for r in vectors.nearest(df, df.where("vec_id = 1"), 2).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2)]
    assert vectors.nearest(df, df.where("vec_id < 0"), 2).count() == 0
    pair = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert pair.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).first().c == 0.0


def test_robots_groups(spark) -> None:  # noqa: ANN001
    body = "User-agent: Googlebot\nDisallow: /private/\nAllow: /private/public\n\nUser-agent: *\nDisallow: /secret\n# note\n"
    rules = crawl.robots_rules(spark.createDataFrame([("h.example", body)], "host string, body string"))
    paths = spark.createDataFrame([(f"https://h.example{p}",) for p in ("/private/page", "/private/public/page", "/secret/data", "/x")] + [("https://other.example/secret",)], "url string")
    for agent, want in (("Googlebot", {"/private/page"}), ("RandomBot", {"/secret/data"})):
        no = {urls_path for (urls_path,) in crawl.allowed_by_robots(paths, rules, agent).where("not allowed").select(F.regexp_replace("url", "^https://[^/]*", "")).collect()}
        assert no == want
    assert crawl.robots_sitemaps(spark.createDataFrame([("h", "SITEMAP: https://h/s.xml\nx")], "host string, body string").select("host", "body")).first().url == "https://h/s.xml"


def test_sitemaps_and_captures(spark) -> None:  # noqa: ANN001
    xml = "<urlset><url><loc> https://A.example/x/ </loc><lastmod>2024-01-02</lastmod><priority>0.5</priority></url><url><loc></loc></url></urlset>"
    r = crawl.sitemap_urls(spark.createDataFrame([("s", xml)], "source string, body string")).collect()
    assert [(x.url, str(x.lastmod)[:10], x.priority) for x in r] == [("https://a.example/x", "2024-01-02", 0.5)]
    lines = ['{"url":"https://a.example/","timestamp":"1","mime":"text/html","status":"200"}', '{"url":"https://a.example","timestamp":"2","mime":"text/html"}', '{"url":"https://a.example/i","mime":"image/png"}', '{"url":"https://a.example/e","mime":"text/html","status":"404"}', "junk"]
    got = crawl.capture_index(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(x.url, x.timestamp) for x in got] == [("https://a.example/", "1")]


def test_upsert_and_delay(spark) -> None:  # noqa: ANN001
    old = spark.createDataFrame([("a", 1), ("b", 1)], "url string, v int")
    assert {tuple(r) for r in crawl.upsert(old, spark.createDataFrame([("b", 2), ("c", 2)], "url string, v int"), "url").collect()} == {("a", 1), ("b", 2), ("c", 2)}
    log = spark.createDataFrame([("d", 1, 429), ("d", 2, 503), ("d", 3, 200), ("d", 4, 404)], "domain string, seq int, status int")
    assert tuple(stats.delay_after(log, "domain", "seq", "status").first()) == ("d", 3000.0, 0)


def test_streams(spark, tmp_path) -> None:  # noqa: ANN001
    rows = pd.DataFrame({"domain": ["a", "a", "b", "a"], "seq": [1, 2, 3, 4], "status": [429, 200, 200, 500], "ts": pd.to_datetime(["2024-01-01"] * 4), "url": ["u", "u", "v", "w"]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = streaming.run_once(streaming.rate_limit(stream), "limits", "update", str(tmp_path / "c1")).collect()
    assert {(r.domain, r.delay_ms, r.fails) for r in got} == {("a", 1500.0, 0), ("b", 750.0, 0)}
    assert streaming.run_once(streaming.first_seen(stream.select("url", "ts")), "seen", "append", str(tmp_path / "c2")).count() == 3
    assert streaming.run_once(streaming.monitor(stream), "mon", "update", str(tmp_path / "c3")).where("domain = 'a'").first().errors == 2


def test_state_survives_a_round_trip(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([("a", 1)], "url string, depth int")
    assert crawl.save_state(df).collect() == df.collect()


@pytest.mark.parametrize(
    ("w", "h", "alt", "url", "want"),
    [("800", "600", "a b c", "https://x.example/p.jpg", 1.0), ("40", "40", "", "https://x.example/p.jpg", 0.45), ("", None, "one", "https://x.example/logo.png", 0.3), ("900", "100", None, "https://x.example/p.jpg", 0.6), ("800", "600", "a", "https://track.example/p.jpg", 0.0)],
)
def test_image_scores(spark, w, h, alt, url, want) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(url, alt, w, h)], "u string, a string, w string, h string")
    assert round(df.select(scoring.image_score(F.col("u"), F.col("a"), F.col("w"), F.col("h"), ["track."]).alias("s")).first().s, 6) == want


def test_url_relevance_and_domains(spark) -> None:  # noqa: ANN001
    best, some, none = (one(spark, lambda c: scoring.url_relevance(c, "python guide"), u) for u in ("https://x.example/python guide", "https://x.example/python-tips/a", "https://q.zz/"))
    assert best > some > none and none < 0.2
    for url, want in (("https://www.a.b.co.uk:8080/x", "b.co.uk"), ("https://m.site.example", "site.example"), ("https://localhost/", "localhost")):
        assert one(spark, scoring.registrable_domain, url) == want


def test_classic_patterns(spark) -> None:  # noqa: ANN001
    for pattern, url, want in (("*.pdf", "https://x.example/a/b.pdf", True), ("*.pdf", "https://x.example/a.pdf.html", False), ("/blog/*", "https://x.example/blog/1", True), ("/blog/*", "https://x.example/blogs/1", False), ("https://x.example/{a,b}/**", "https://x.example/b/c/d", True), (r"^https://x\.", "https://x.example", True)):
        assert one(spark, lambda c, p=pattern: scoring.matches_patterns(c, [p]), url) is want, pattern


def test_backoff_and_retry(spark) -> None:  # noqa: ANN001
    assert [one(spark, scoring.backoff, k, "int") for k in (0, 1, 3, 9)] == [1000, 2000, 8000, 30000]
    assert [one(spark, scoring.is_retryable, s, "int") for s in (200, 404, 429, 503)] == [False, False, True, True]


def test_pdf_text(spark) -> None:  # noqa: ANN001
    import zlib

    from webloom.sources import pdf

    body = b"BT (Hello \\(big\\)) Tj T* [(wor) -20 (ld of PDF files, long enough to count as text)] TJ ET"
    raw = b"%PDF-1.4\n1 0 obj\nstream\n" + zlib.compress(body) + b"\nendstream\n"
    df = spark.createDataFrame([("a", raw), ("b", b"no pdf"), ("c", None)], "path string, content binary")
    assert {r.path: r.text for r in pdf.read_pdfs(df).collect()} == {"a": "Hello (big)\nworld of PDF files, long enough to count as text", "b": None, "c": None}


def test_model_output_helpers(spark) -> None:  # noqa: ANN001
    assert one(spark, text.strip_fences, '```json\n{"a": 1}\n```') == '{"a": 1}' and one(spark, text.strip_fences, "x") == "x"
    assert one(spark, lambda c: text.tag_contents(c, "q"), "<q> a </q> and <q>b</q>") == ["a", "b"]


def test_dispatch_and_convergence(spark) -> None:  # noqa: ANN001
    log = spark.createDataFrame([("d", 1, True, 100), ("d", 2, True, 200), ("d", 3, False, 900), ("d", 4, False, 900)], "domain string, o int, ok boolean, l int")
    assert tuple(stats.dispatch_stats(log, "domain", "o", "ok", "l").first()) == ("d", 2, 2, 2, 125)
    assert stats.converged(1.0, 0.9, 0.9, 5) and not stats.converged(1.0, 0.9, 0.9, 4) and not stats.converged(0.5, 0.9, 0.9, 9)
    texts = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, "alpha beta"), (4, "alpha")], "o int, t string")
    assert stats.saturation(texts, "t", "o").first().saturation == round(1 - 1.5 / 2.75, 6)


def test_depth_first_and_adaptive(spark) -> None:  # noqa: ANN001
    links = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("a", "c", 0), ("c", "r", 0), ("b", "d", 0)], "src_url string, dst_url string, pos int")
    seeds = spark.createDataFrame([("r",)], "url string")
    got = graph.depth_first(links, seeds, 10, 5).orderBy("step").collect()
    assert [(r.url, r.depth) for r in got] == [("r", 0), ("a", 1), ("c", 2), ("b", 1), ("d", 2)]
    assert [r.url for r in graph.depth_first(links, seeds, 2, 5).orderBy("step").collect()] == ["r", "a"]
    texts = spark.createDataFrame([(u, "garden museum words " + u) for u in "rabcd"], "url string, text string")
    got = graph.adaptive(links, texts, seeds, "garden", 5, 2).orderBy("step").collect()
    assert [r.url for r in got] == ["r", "a", "b", "c", "d"] and got[-1].coverage == 1.0


def test_components_and_clusters(spark) -> None:  # noqa: ANN001
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100 + i: 100 for i in range(1, 9)}


def test_similar_vectors_recall_against_brute_force(spark) -> None:  # noqa: ANN001
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 32))
    x = (centres[rng.integers(0, 12, 240)] + 0.8 * rng.standard_normal((240, 32))).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    want = {(i, j) for i in range(240) for j in range(i + 1, 240) if s[i, j] >= 0.6}
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "vec_id long, embedding array<float>")
    got = {(r.a, r.b) for r in vectors.similar(df).collect()}
    assert want and len(got & want) / len(want) >= 0.95 and got <= {(i, j) for i in range(240) for j in range(i + 1, 240) if s[i, j] >= 0.6 - 1e-5}
    c = {r.vec_id: (r.cluster, r.links) for r in vectors.clusters(df).collect()}
    assert len(c) == 241 and c[999] == (999, 0)


def test_semantic_chunks(spark) -> None:  # noqa: ANN001
    sample = "# One\n\nFirst paragraph here.\n\nSecond paragraph here.\n\nTwo\n\nA longer paragraph that follows the short line above it."
    assert chunks.semantic(sample, 60) == [("One", "# One\n\nFirst paragraph here.\n\nSecond paragraph here."), ("Two", "Two"), ("Two", "A longer paragraph that follows the short line above it.")]
    df = spark.createDataFrame([(1, sample), (2, None)], "k int, t string")
    assert chunks.greedy_chunks(df.where("k = 2"), "t", "fixed_size", size=9).count() == 0
    got = chunks.semantic_chunks(df, "t", 200).collect()
    assert {r.k for r in got} == {1} and [r.heading for r in got] == ["One", "Two"]
