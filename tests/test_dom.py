from __future__ import annotations

from webloom.dom import extract
from webloom.dom.select import css, xpath
from webloom.dom.tree import parse

PAGE = """<html lang="en"><head><title> My Page </title><meta name="description" content="About it"><meta property="og:title" content="OG">
<link rel="canonical" href="/here"><script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">{bad</script></head>
<body><nav><a href="/home">Home</a></nav><article class="post main"><h1>Head</h1><p>One <b>bold</b> <a href="/x?utm_source=t&k=1#f">link</a>
<p>Two<ul id="l"><li class="item">A<li class="item">B</ul><table><caption>Sales</caption><tr><th>K</th><th>V</th></tr><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>
<img src="/a.png" alt="pic" width="800"><a href="https://other.example/y">out</a><a href="#top">no</a><a href="mailto:x@y.z">no</a></article></body></html>"""


def test_tree_closes_what_html_leaves_open() -> None:
    doc = parse("<p>a<p>b<ul><li>1<li>2</ul><table><tr><td>x<td>y<tr><td>z</table>")
    assert [p.text() for p in doc.elements("p")] == ["a", "b"]
    assert [x.text() for x in doc.elements("li")] == ["1", "2"]
    assert [[c.text() for c in r.children] for r in doc.elements("tr")] == [["x", "y"], ["z"]]
    assert parse("").first("body") is not None


def test_links_are_normal_distinct_and_split() -> None:
    got = extract.links(parse(PAGE), "https://site.example/dir/")
    assert [(x["href"], x["is_external"]) for x in got] == [("https://site.example/home", False), ("https://site.example/x?k=1", False), ("https://other.example/y", True)]


def test_metadata() -> None:
    m = extract.metadata(parse(PAGE))
    assert (m["title"], m["description"], m["language"], m["canonical"], m["open_graph"], m["json_ld"]) == ("My Page", "About it", "en", "/here", {"title": "OG"}, ['{"a": 1}'])


def test_tables_are_scored() -> None:
    (t,) = extract.tables(parse(PAGE))
    assert (t["headers"], t["rows"], t["caption"], t["is_data_table"]) == (["K", "V"], [["a", "1"], ["b", "2"]], "Sales", True)
    (t,) = extract.tables(parse("<table><tr><td>h1</td><td>h2</td></tr><tr><td>1</td><td>2</td></tr></table>"))
    assert t["headers"] == ["h1", "h2"] and t["rows"] == [["1", "2"]]


def test_images_and_structure() -> None:
    (i,) = extract.images(parse(PAGE), "https://site.example/")
    assert i["url"] == "https://site.example/a.png" and i["score"] == 1.0
    s = extract.structure(parse(PAGE))
    assert (s["h1"], s["links"], s["navs"], s["has_article"], s["has_main"]) == (["Head"], 5, 1, True, False)


def test_css_subset() -> None:
    doc = parse(PAGE)
    assert [n.text() for n in css(doc, "li.item")] == ["A", "B"]
    assert len(css(doc, "#l > li, ul li")) == 2
    assert [n.attrs["href"] for n in css(doc, "nav a[href]")] == ["/home"]
    assert css(doc, 'img[alt="pic"]') and not css(doc, 'img[alt="other"]') and not css(doc, "nav > p")


def test_xpath_subset() -> None:
    doc = parse(PAGE)
    assert [n.text() for n in xpath(doc, '//li[@class="item"]')] == ["A", "B"]
    assert [n.text() for n in xpath(doc, "//li[last()]")] == ["B"]
    assert [n.text() for n in xpath(doc, "//tr/td[2]")] == ["1", "2"]
    assert [n.data for n in xpath(doc, "//nav/a/@href")] == ["/home"]


def test_records_by_schema() -> None:
    schema = {"base": "article", "fields": [{"name": "t", "selector": "h1"}, {"name": "all", "selector": "li", "type": "list"}, {"name": "no", "selector": "h6"}, {"name": "row", "selector": "table", "type": "nested", "fields": [{"name": "c", "selector": "caption"}]}]}
    assert extract.records(parse(PAGE), schema) == [{"t": "Head", "all": ["A", "B"], "no": "", "row": {"c": "Sales"}}]


def test_markdown_and_pruning() -> None:
    md = extract.markdown(parse(PAGE), "https://site.example/")
    assert "# Head" in md and "- A" in md and "| K | V |" in md and "## References" in md and "**bold**" in md
    long = "Real text of the page that goes on for a while and says something. " * 5
    html = extract.prune(parse(f"<nav><a href=/>Home</a></nav><div><p>{long}</p></div><footer>legal</footer>"))
    assert "Real text" in html and "legal" not in html and "Home" not in html


def test_page_relevance() -> None:
    from webloom.dom import relevance

    doc = parse("<title>River museum</title><body><nav>skip all this</nav><h1>The museum</h1><p>The river museum is open again.</p><p>Nothing of the kind here.</p><script>var a b c</script></body>")
    chunks = relevance.text_chunks(doc)
    assert chunks == [("title", "River museum"), ("h1", "The museum"), ("p", "The river museum is open again."), ("p", "Nothing of the kind here.")]
    assert relevance.page_query(doc) == "River museum"
    assert [i for i, *_ in relevance.relevant(chunks, "museum", 0.01)] == [0, 1, 2]
    assert len(relevance.relevant(chunks, "the of")) == 4


def test_classic_variants() -> None:
    from webloom.dom import classic

    rows = "".join(f"<tr><td>name number {k} of the list</td><td colspan=2>{k}</td></tr>" for k in range(3))
    (t,) = classic.data_tables(f"<table><caption>C</caption><thead><tr><th>A</th><th>B</th><th>C</th></tr></thead><tbody>{rows}</tbody></table>")
    assert t["headers"] == ["A", "B", "C"] and t["rows"][0] == ["name number 0 of the list", "0", "0"] and t["caption"] == "C"
    assert classic.data_tables("<table role=presentation><tr><td><table><tr><td>x</td></tr></table></td></tr></table>") == []
    kept = classic.prune("<nav><a href=/>Home</a></nav><p>" + "A real sentence of the page. " * 9 + "</p><footer>legal</footer>")
    assert len(kept) == 1 and "real sentence" in kept[0]
