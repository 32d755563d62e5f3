"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import pytest

from webloom.llm import blocks, encoding, leaks, markup, neardup, notices, packing, reading, repeats, residue, stuffing

LONG = "The river was calm and the old bridge stood near the mill. " * 4000
CLASH = "row long, _id string, _text string, line_no int, key string, rep long, n int, words string, kind string, part int, size int, w string"
NO = ", ".join(f"NULL AS {c.split()[0]}" for c in CLASH.split(", "))


def pages_of(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame(rows, "page_id long, url string, html string, markdown string")


ROWS = [
    (1, "https://a.example/1", None, "Only text, no html.\n\nMore text."), (2, None, "<p>x</p>", "x"), (3, "https://a.example/3", "", ""), (4, "https://a.example/4", "<p>y</p>", None),
    (None, None, None, None), (5, "https://a.example/5", "<html><body><p>" + LONG + "</p></body></html>", LONG), (5, "https://a.example/5", "<html><body><p>" + LONG + "</p></body></html>", LONG), (6, "no url", "<<<>>>", "\n\n \n"), (None, "https://a.example/n", "<p>z</p>", "z"),
]
PAGE_OPERATORS = {
    "bands": reading.find_bands, "levels": reading.reading_levels, "residue": residue.find_residue, "repeats": repeats.find_repeated_lines, "removal": repeats.remove_repeated_lines,
    "boilerplate": blocks.find_boilerplate, "main text": blocks.main_text, "markup": markup.find_in_markdown, "stuffing": stuffing.find_stuffed,
}


@pytest.mark.parametrize("name", sorted(PAGE_OPERATORS))
def test_page_operators_take_odd_rows(spark, name) -> None:  # noqa: ANN001
    run = PAGE_OPERATORS[name]
    df = pages_of(spark, ROWS)
    rows = [tuple(r) for r in run(df).collect()]
    assert len(rows) >= 0
    assert run(df.limit(0)).count() == 0
    if name != "removal":  # which keeps the columns it is given
        clash = df.selectExpr("*", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in CLASH.split(", ")])
        assert sorted(map(str, map(tuple, run(clash).collect()))) == sorted(map(str, rows))


def test_reading_level_of_repeated_and_long_rows(spark) -> None:  # noqa: ANN001
    got = reading.reading_levels(pages_of(spark, ROWS)).collect()
    assert [(r.page_id, r.words, r.band) for r in got] == [(5, 48000, "easy")] * 2


def test_neardup_odd_rows(spark) -> None:  # noqa: ANN001
    text = " ".join(f"word{i}" for i in range(120))
    rows = [(1, "u1", text), (2, "u2", text), (3, "u2", text), (4, None, text), (5, "u5", None), (6, "u6", ""), (7, "u7", "short"), (1, "u1", text), (8, "u8", LONG), (9, "u9", LONG + "end")]
    pages = spark.createDataFrame([(i, u, t, 1) for i, u, t in rows[:5]], "page_id long, url string, markdown string, rep int")
    cache = spark.createDataFrame([(i, u, t, 1) for i, u, t in rows[5:]], "cache_id long, url string, markdown string, id int")
    found = neardup.classes(pages, cache)
    assert {tuple(r) for r in neardup.find_pairs(found).collect()} == {(1, 2), (1, 3), (8, 9)}
    empty = neardup.classes(pages.limit(0), cache.limit(0))
    assert neardup.find_pairs(empty).count() == 0 and neardup.groups(empty).count() == 0


def test_large_classes_are_linked_to_their_representative(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(neardup, "EXPAND", 3)
    text = " ".join(f"word{i}" for i in range(100))
    pages = spark.createDataFrame([(i, f"u{i}", text) for i in range(6)], "page_id long, url string, markdown string")
    cache = spark.createDataFrame([(10, "v", text + " tail")], "cache_id long, url string, markdown string")
    found = neardup.classes(pages, cache)
    assert {tuple(r) for r in neardup.find_pairs(found).collect()} == {(0, i) for i in range(1, 6)} | {(0, 10)}
    assert {(r.group_id, r.links) for r in neardup.groups(found).collect()} == {(0, 1)}


def test_large_classes_keep_links_of_shared_urls(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(neardup, "EXPAND", 3)
    text, other = (" ".join(f"{w}{i}" for i in range(100)) for w in ("word", "term"))
    rows = [(0, "u0", text), (1, "u0", text), (2, "u2", text), (3, "u3", text), (4, "u4", text)]
    rows += [(20 + i, u, other) for i, u in enumerate(("v", "w", "v", "w"))] + [(30 + i, u, other + " tail") for i, u in enumerate(("v", "x", "y", "z"))]
    rows += [(40 + i, "same", other + " end of it") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, markdown string")
    cache = spark.createDataFrame([(10, "u0", text + " tail"), (11, "u9", text + " tail")], "cache_id long, url string, markdown string")
    found = neardup.classes(pages, cache)
    whole = {tuple(r) for r in neardup.find_pairs(found, whole=True).collect()}
    near = lambda t: text if t.startswith(text) else other
    all_rows = [*rows, (10, "u0", text + " tail"), (11, "u9", text + " tail")]
    assert whole == {(a, b) for a, u, t in all_rows for b, v, s in all_rows if a < b and u != v and near(t) == near(s)}
    got = {tuple(r) for r in neardup.find_pairs(found).collect()}
    assert got <= whole and {(0, 2), (0, 3), (0, 4), (1, 2), (2, 10), (0, 11)} <= got
    # large classes whose ends share urls stay linked, and no record with a pair is without one
    assert any(20 <= a < 30 <= b < 40 for a, b in got) and any(a < 30 and 40 <= b for a, b in got)
    assert {i for p in got for i in p} == {i for p in whole for i in p}


def test_residue_verdicts_do_not_hang_on_other_pages(spark) -> None:  # noqa: ANN001
    pad = "x" * 400
    bodies = [
        "at pkg.Main.call(Main.java:12)\n\nat pkg.Main.run(Main.java:30)\n\nat pkg.Main.main(Main.java:7)", "At 10:30\n\nAt 11:45\n\nAt 12:15",
        "java.lang.NullPointerException", "[291](http://a.example/35)", f"{pad} page not found", f"{pad} garden of roses",
    ]
    rows = [r for i, b in enumerate(bodies) for r in residue.page_rows(i, blocks.parse_markdown(b), notices.notices())]
    assert {r.row for r in residue.decide(spark.createDataFrame(rows, residue.SCHEMA)).collect()} == {0, 2, 4}


def test_long_tokens_are_masked_at_once() -> None:
    for text in ("a." * 50_000 + "b", "x" * 50_000 + "y", "-" * 50_000 + "y"):
        assert notices.tokens(text) == ["<long>"]
    assert notices.tokens("At Main.run(Main.java:30) a.b.KeyError: 404 12:30 /var/x 7 ID-7f3a xxx www.a.example") == ["at", "<trace>", "<exception>", "<code>", "<time>", "<path>", "<num>", "<id>", "<mash>", "<url>"]


def test_packing_odd_rows(spark) -> None:  # noqa: ANN001
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b c", 0), (3, "a b c", 0), (4, "w " * 40000, 0), (None, "x", 0)], "doc_id long, text string, bucket int")
    windows = spark.createDataFrame([("w", 512), ("none", None), (None, 5), ("zero", 0)], "window_name string, capacity_tokens long")
    got = packing.pack(docs, windows).collect()
    assert {r.window_name for r in got} == {"w"} and {r.doc_id for r in got} == {2, 3, 4, None}
    room: dict[int, int] = {}
    for r in got:
        room[r.container_id] = room.get(r.container_id, 0) + r.piece_size
    assert max(room.values()) <= 512 and sum(r.piece_size for r in got if r.doc_id == 4) == 53334
    assert len({(r.container_id, r.place) for r in got}) == len(got)
    assert packing.pack(docs.limit(0), windows).count() == 0 and packing.pack(docs, windows.limit(0)).count() == 0


def test_leaks_odd_rows(spark) -> None:  # noqa: ANN001
    item = "Clerk Tamdavon wrote 124 where the scale of Vellaster had plainly shown 344 on Monday."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, item.upper(), 0), (3, item.upper(), 0), (4, LONG + item + LONG, 0)], "doc_id long, text string, item int")
    got = sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items).collect())
    assert got == [(3, 1), (3, 1), (4, 1)]
    assert leaks.find_leaks(docs.limit(0), items).count() == 0 and leaks.find_leaks(docs, items.limit(0)).count() == 0


def test_encoding_odd_rows(spark) -> None:  # noqa: ANN001
    rows = [(1, None), (2, ""), (3, "plain"), (4, "caf\u00c3\u00a9 " * 3000), (4, "caf\u00c3\u00a9 " * 3000), (5, "the caf\u00e9 was na\u00efve"), (6, "lost \ufffd sign")] + [(100 + i, "un caf\u00e9 et une for\u00eat \u2013 d\u00e9j\u00e0") for i in range(40)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, restored string")
    got = sorted((r.doc_id, r.restorable, (r.restored or "")[:4]) for r in encoding.find_garbled(docs).collect())
    assert got == [(4, True, "caf\u00e9"), (4, True, "caf\u00e9"), (6, False, "")]
    assert encoding.find_garbled(docs.limit(0)).count() == 0


def test_plain_text_markup_odd_rows(spark) -> None:  # noqa: ANN001
    rows = [(1, None), (2, ""), (3, "a " * 90000 + "<br> b"), (4, "from $5 to $12, x < 3, C:\\temp, {{ name }}, [[NAME]]"), (5, "**b** and [[link|x]] \\emph{y}")]
    got = sorted((r.page_id, r.markup) for r in markup.find_in_plain_text(spark.createDataFrame([(i, t, 1) for i, t in rows], "page_id long, plain_text string, markup int")).collect())
    assert got == [(3, "html"), (5, "latex"), (5, "markdown"), (5, "wiki")]
