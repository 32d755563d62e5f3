"""Results of the operators against brute force, round trips and hand-made cases."""

from __future__ import annotations

import os
import pickle
import random
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.oracle import connect, differences
from webloom.llm import blocks, encoding, leaks, markup, neardup, notices, packing, reading, repeats, residue, shingles, stuffing
from webloom.llm.queries import QUERIES, SQL
from webloom.session import materialize, shared_dir

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name) -> None:  # noqa: ANN001
    assert differences(QUERIES[name](spark, DATA), connect(DATA), SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name) -> None:  # noqa: ANN001
    # the smallest documents hold no test item
    df = QUERIES[name](spark, DATA.replace("sf0.001", "sf0.01") if name == "p9_found" else DATA)
    assert df.count() > 0


def jaccard_pairs(texts: dict[int, tuple[str, str]], size: int, threshold: float) -> set[tuple[int, int]]:
    sets = {}
    for i, (u, t) in texts.items():
        w = re.findall(r"[^\W_]+", t.lower())
        if len(w) >= 80:
            sets[i] = (u, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)})
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a][0] != sets[b][0] and len(sets[a][1] & sets[b][1]) >= threshold * len(sets[a][1] | sets[b][1])}


def test_neardup_pairs_equal_brute_force(spark) -> None:  # noqa: ANN001
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(300)]
    texts: dict[int, tuple[str, str]] = {}
    for i in range(60):
        w = rng.choices(vocab, k=rng.randint(85, 400))
        for c in range(rng.choice([1, 1, 2, 4])):
            v = list(w)
            for _ in range(int(len(v) * rng.choice([0.0, 0.02, 0.05, 0.1, 0.14]))):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            texts[i * 10 + c] = (f"u{i}-{c}", " ".join(v))
    for i, t in enumerate(["we do who sells in " * 30, "we do who sells in " * 31, "la la " * 60]):  # few different shingles
        texts[9000 + i] = (f"s{i}", t)
    pages = spark.createDataFrame([(i, u, t) for i, (u, t) in texts.items()], "page_id long, url string, markdown string")
    cache = spark.createDataFrame([], "cache_id long, url string, markdown string")
    for threshold in (0.6, 0.8):
        found = neardup.classes(pages, cache, threshold=threshold)
        want = jaccard_pairs(texts, 3, threshold)
        assert {tuple(r) for r in neardup.find_pairs(found).collect()} == want and want


def test_neardup_meets_in_rounds_and_leaves_only_what_is_read_again(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(neardup, "ROUND", 1000, raising=False)
    rng = random.Random(5)
    texts: dict[int, tuple[str, str]] = {}
    for i in range(40):
        w = rng.choices([f"w{k}" for k in range(60)], k=rng.randint(85, 300))
        for c in range(3):
            v = list(w)
            for _ in range(int(len(v) * rng.choice([0.0, 0.03, 0.08]))):
                v[rng.randrange(len(v))] = f"w{rng.randrange(60)}"
            texts[i * 10 + c] = (f"u{i}-{c}", " ".join(v))
    pages = spark.createDataFrame([(i, u, t) for i, (u, t) in texts.items()], "page_id long, url string, markdown string")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    blocks_of = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {p for p in blocks_of.getAllFiles().mkString("|").split("|") if "shuffle_" in p}
    tables, before = set(folder.iterdir()), shuffles()
    found = neardup.classes(pages, spark.createDataFrame([], "cache_id long, url string, markdown string"))
    assert {p.name.split("-")[1] for p in set(folder.iterdir()) - tables} == {"members", "classes", "edges"}
    assert sum(os.path.getsize(p) for p in shuffles() - before) < 10_000  # the count of all shingles
    want = jaccard_pairs(texts, 3, 0.6)
    assert {tuple(r) for r in neardup.find_pairs(found, whole=True).collect()} == want and want


def test_neardup_drops_each_share_of_the_lists_and_writes_sets_once(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(neardup, "ROUND", 1000)
    rng = random.Random(6)
    texts = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(85, 300))] for _ in range(60)]
    pages = spark.createDataFrame([(i, f"u{i}", " ".join(w)) for i, w in enumerate(texts)], "page_id long, url string, markdown string")
    written, left, wide, write = [], [], [], neardup.materialize

    def watch(df, name, *args, **kwargs):  # noqa: ANN001, ANN002, ANN003, ANN202
        out = write(df, name, *args, **kwargs)
        written.append((name, "tokens" in out.columns, out))
        lists = next((o for n, _, o in written if n == "lists"), None)
        if name == "lists":
            wide.append(out.selectExpr("max(key) hi", "min(key) lo").first())
        if name == "met":
            left.append(sorted(int(p.name[6:]) for p in Path(lists._webloom_path.removeprefix("file:")).glob("round=*")))
        return out

    monkeypatch.setattr(neardup, "materialize", watch)
    neardup.classes(pages, spark.createDataFrame([], "cache_id long, url string, markdown string"))
    assert [n for n, tokens, _ in written if tokens] == ["classes"]
    assert len(left) > 5 and left == [list(range(r, len(left))) for r in range(len(left))]
    assert 0 <= wide[0].lo and wide[0].hi < 1 << 8 * shingles.WIDTH


def test_shares_are_written_without_a_sort(spark) -> None:  # noqa: ANN001
    df = spark.range(200).selectExpr("id", "cast(id % 16 as int) share")  # as many as neardup.ROUNDS
    out = materialize(df, "shares", by="share")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [done.apply(k).physicalPlanDescription() for k in range(done.size())]
    assert "Sort" not in next(p for p in reversed(plans) if "webloom-shares-" in p)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert {(r.id, r.share) for r in out.collect()} == {(i, i % 16) for i in range(200)}


def test_neardup_keys_travel_packed() -> None:
    rng = np.random.default_rng(2)
    sketch = np.zeros(1 << 20, np.uint8)
    sketch[rng.integers(0, 1 << 20, 5000)] = 4
    keys = shingles.Keys(sketch, 0.6, 3, 32, 4)
    raw = pickle.dumps(keys)
    tokens = np.unique(rng.integers(0, 1 << 40, 300, dtype=np.uint64))
    assert len(raw) < 1 << 17
    assert all((a == b).all() for a, b in zip(keys.of(tokens), pickle.loads(raw).of(tokens), strict=True))


def test_neardup_on_test_pages_equals_brute_force(spark) -> None:  # noqa: ANN001
    texts = {r["page_id"]: (r["url"], r["markdown"]) for r in pq.read_table(f"{DATA}/crawled_data.parquet", columns=["page_id", "url", "markdown"]).to_pylist() if r["markdown"] is not None}
    texts |= {r["cache_id"]: (r["url"], r["markdown"]) for r in pq.read_table(f"{DATA}/crawl_cache.parquet", columns=["cache_id", "url", "markdown"]).to_pylist() if r["markdown"] is not None}
    assert {tuple(r) for r in QUERIES["p4_found"](spark, DATA).collect()} == jaccard_pairs(texts, 3, 0.6)


def test_shingle_bytes_round_trip_and_bit_vectors_never_reject_similar_sets() -> None:
    rng = np.random.default_rng(1)
    for n in (1, 90, 300, 900):
        s = np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64))
        assert (shingles.from_bytes(shingles.to_bytes(s)) == s).all()
        t = np.unique(np.concatenate([s[: int(n * 0.8)], rng.integers(0, 1 << 40, n // 6, dtype=np.uint64)]))
        both = len(np.intersect1d(s, t))
        if both >= 0.6 * (len(s) + len(t) - both):
            assert neardup.may_be_similar(neardup.bit_vector(s), len(s), neardup.bit_vector(t), len(t), 0.6)


def test_boundaries_minimise_padding() -> None:
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = np.unique(rng.integers(1, 60, 12))
        counts = rng.integers(1, 20, len(sizes))
        k = int(rng.integers(1, 6))

        def padding(bounds: list[int], sizes: np.ndarray = sizes, counts: np.ndarray = counts) -> int:
            return sum(int(c) * (min(b for b in bounds if b >= s) - int(s)) for s, c in zip(sizes, counts, strict=True))

        from itertools import combinations

        best = min(padding([*c, int(sizes[-1])]) for r in range(k) for c in combinations([int(s) for s in sizes[:-1]], r))
        got = packing.boundaries(sizes, counts, k)
        assert len(got) <= k and got[-1] == sizes[-1] and padding(got) == best


def test_containers_are_full_and_never_too_full(spark) -> None:  # noqa: ANN001
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 900)) for i in range(3000)], "doc_id long, text string")
    windows = spark.createDataFrame([("s", 512), ("l", 4096)], "window_name string, capacity_tokens long")
    packed = packing.pack(docs, windows)
    rows = packed.groupBy("window_name", "container_id").sum("piece_size").collect()
    assert max(r[2] for r in rows if r[0] == "s") <= 512
    assert {r.window_name: r.fill > 0.97 for r in packing.fill(packed, windows).collect()} == {"s": True, "l": True}
    assert packed.where("pieces > 1 and size <= 512 and window_name = 's'").count() == 0


def test_repeated_lines_count_variants_and_urls(spark) -> None:  # noqa: ANN001
    rows = [(i, f"https://www.Site.example/{i}", ("**Legal notice 2024!**" if i % 2 else "LEGAL  notice 7") + f"\nown line {chr(97 + i)}x\n\nseven" * (i < 7)) for i in range(10)]
    rows += [(100 + i, "https://site.example/same", "Repeated but one url") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, markdown string")
    assert {tuple(r) for r in repeats.find_repeated_lines(pages).collect()} == {(i, 0) for i in range(10)}
    cleaned = {r.page_id: (r.markdown, r.removed_lines) for r in repeats.remove_repeated_lines(pages).collect()}
    assert cleaned[0] == ("own line ax\n\nseven", 1) and cleaned[100] == ("Repeated but one url", 0)


def test_leaks_need_order_names_and_one_stretch() -> None:
    item = "Rule 57 of the Fennock guild forbids any Nelvon heir to trade ledger books after dusk. Linnock has twice as many wool sacks as Baswimere, who lost 369 on the way."
    other = "Rule 12 of the Tamock guild forbids any Zelvon heir to trade ledger books after dusk. Corrock has twice as many wool sacks as Paswimere, who lost 11 on the way."
    index = leaks.Index([(1, item), (2, "Between Ulra and Morby the night coach stops 121 times for glass floats and paper lanterns of the tide mill.")])
    words = item.split()
    assert index.search("Before. " + item.lower().replace(" ", "\n") + " after")
    assert index.search("x " + " ".join(words[:10] + ["really"] + words[10:22]) + " y")  # more than half, a word put in
    assert not index.search(other)  # the same phrases with other names and numbers
    assert not index.search(" ".join(words[:9]))
    assert not index.search(" ".join(reversed(words)))
    assert not index.search((" pad" * 40).join(words))  # in order, but in no one stretch


def test_leaks_do_not_hang_on_rounds(spark, monkeypatch) -> None:  # noqa: ANN001
    d = DATA.replace("sf0.001", "sf0.01")
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    more = docs.limit(3).selectExpr("doc_id + 1000000 AS doc_id", "'Only xylophonist here' AS text").unionByName(docs.select("doc_id", "text"))
    items = items.select("item_id", "text").unionByName(spark.createDataFrame([(999999, "xylophonist")], "item_id long, text string"))
    got = []
    for n in (40, 161):
        monkeypatch.setattr(leaks, "ITEMS_PER_ROUND", n)
        got.append(sorted(tuple(r) for r in leaks.find_leaks(more, items).collect()))
    assert got[0] == got[1] and {d for d, i, *_ in got[0] if i == 999999} == {r.doc_id for r in more.where("doc_id >= 1000000").collect()}


def test_leaks_may_leave_out_a_sentence_and_stand_beside_a_look_alike() -> None:
    item = [f"w{c}{d}" for c in "abcd" for d in "qrstuvwxyz"]  # 40 words
    index = leaks.Index([(1, " ".join(item)), (2, "Something else of the tide mill and the glass floats.")])
    assert index.search("x " + " ".join(item[:15] + item[26:]) + " y")
    assert not index.search("x " + " ".join(item[:15] + ["pad"] * 12 + item[34:]) + " y")
    names = ["Ulra", "Morby", "Fennock", "Nelvon", "Linnock", "Tamock"]
    text = [w for k, w in enumerate(item[:24]) for w in ([w, names[k // 4]] if k % 4 == 3 else [w])]
    index = leaks.Index([(1, " ".join(text)), *[(k, f"Other words number {k} of the mill.") for k in range(2, 60)]])
    alike = ["Zelvon" if w in names else w for w in text]
    assert not index.search(" ".join(alike))
    for both in (alike + ["pad"] * 30 + text[:20], text[:20] + ["pad"] * 30 + alike):
        assert index.search(" ".join(both))


def test_cyrillic_mixups_of_a_part_of_a_line_are_restored() -> None:
    import pyarrow as pa

    words = "Новая станция открыла архив писем в долине у старой реки и город собрал книги".split()
    corpus = [" ".join(words), "Le café déjà vu – l’été à Noël"] * 40
    rows = [tuple(x) for b in encoding._count([pa.RecordBatch.from_arrays([pa.array(corpus)], names=["t"])]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    model = encoding.Model(rows)
    for right, wrong in (("cp1251", "latin-1"), ("koi8-r", "latin-1"), ("koi8-r", "cp1251")):
        for a, b in ((2, 5), (0, 4), (9, 14), (2, 14)):
            bad = [w.encode(right).decode(wrong) if a <= k < b else w for k, w in enumerate(words)]
            assert encoding.repair(" ".join(bad), model) == (True, True, " ".join(words)), (right, wrong, a, b)
        # a sign the wrong table lacks
        assert encoding.repair(" ".join(words).encode(right).decode(wrong) + " → ✓", model) == (True, True, " ".join(words) + " → ✓")
    for fine in corpus[:2]:
        assert not encoding.repair(fine, model)[0]


def test_usual_ratios_have_no_switch_by_size() -> None:
    all_rows = [("en", k, 0.9 - 0.02 * k, 400) for k in range(14, 26)]
    before = None
    for n in (0, 1, 98, 99, 100, 101, 5000):
        got = {(lang, k): v for lang, k, v in stuffing.usual_ratios(all_rows + [("de", k, 0.8, n / 4) for k in (16, 18, 20, 22) if n])}
        if before and n < 5000:
            assert abs(got["de", 20] - before["de", 20]) < (0.01 if n != 98 else 1)
        before = got
    assert abs(got["de", 20] - 0.8) < 0.02 and abs(got["en", 20] - 0.5) < 0.02
    one = dict(((lang, k), v) for lang, k, v in stuffing.usual_ratios([("en", 18, 0.5, 1)]))  # noqa: C402
    assert abs(one["en", 18] - dict(((lang, k), v) for lang, k, v in stuffing.usual_ratios([]))["en", 18]) < 0.05  # noqa: C402


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("The bridge " + "<!-- " + "a note on the mill " * 20 + "-->" + " was open.", "html"), ("The bridge <!-- a note\n\nof the mill --> was open.", "html"), ("The bridge <span\nclass=x1> was open.", "html"),
        ("So \\( a + b = " + "c + d + " * 40 + "e \\) holds.", "latex"), ("So \\[ a + b\n= c \\] holds.", "latex"), ("So $a + \\alpha\n= c$ holds.", "latex"),
        ("The river was calm. " * 15 + "Then {{cite|title=A river. " + "The mill. " * 12 + "The bridge}} came.", "wiki"), ("It was {{cite|\ntitle=A. B\n}} here.", "wiki"),
    ],
)
def test_signs_have_no_bounds(text, kind) -> None:  # noqa: ANN001
    assert markup.kinds_of([text], markup.trees()) == [{kind}]
    if kind != "latex":
        assert not any(x in markup.clean(text, {kind}) for x in ("<", "{{", "note", "cite"))


def test_open_signs_far_apart_are_none() -> None:
    for text in ("Cost \\( one.\n\nAnd so \\) two.", "From $5 to\nabout $7 now.", "5 <!-- 6 crates.\nNo more."):
        assert markup.kinds_of([text], markup.trees()) == [set()]


def test_encodings_are_restored() -> None:
    corpus = ["Le caf\u00e9 d\u00e9j\u00e0 vu \u2013 l\u2019\u00e9t\u00e9 \u00e0 No\u00ebl", "Stra\u00dfe und \u00dcbung sch\u00f6n gr\u00fcn", "\u041d\u043e\u0432\u0430\u044f \u0441\u0442\u0430\u043d\u0446\u0438\u044f \u043e\u0442\u043a\u0440\u044b\u043b\u0430 \u0430\u0440\u0445\u0438\u0432 \u043f\u0438\u0441\u0435\u043c \u0432 \u0434\u043e\u043b\u0438\u043d\u0435", "ma\u00f1ana ni\u00f1o \u00bfqui\u00e9n?"] * 30
    import pyarrow as pa

    rows = [tuple(x) for b in encoding._count([pa.RecordBatch.from_arrays([pa.array(corpus)], names=["t"])]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    model = encoding.Model(rows)
    for good in corpus[:4]:
        assert encoding.repair(good, model) == (False, False, good)
        for wrong in ("latin-1", "cp1252", "cp437", "mac_roman"):
            try:
                bad = good.encode("utf-8").decode(wrong)
            except UnicodeDecodeError:
                continue
            assert encoding.repair(bad, model) == (True, True, good), wrong
    russian = corpus[2]
    for right, wrong in (("cp1251", "latin-1"), ("koi8-r", "cp1251")):
        assert encoding.repair(russian.encode(right).decode(wrong), model) == (True, True, russian)
    assert encoding.repair(corpus[0].encode("utf-8").decode("cp1252").encode("utf-8").decode("cp1252"), model)[2] == corpus[0]
    assert encoding.repair("caf\ufffd", model)[:2] == (True, False)
    for fine in ("\u00c2GE ET FOR\u00caT", "S\u00c3O LI\u00c7\u00d5ES", "at 20 \u00b0C, \u00d7274, \u00bd cup \u00a9 2024 \u00a35"):
        assert not encoding.repair(fine, model)[0]


@pytest.mark.parametrize(
    ("body", "case"),
    [
        ("# Page not found\n\n404", True), ("Please enable JavaScript to view this page.", True), ("# A title\n\nYour text goes here. Type your headline.", True), ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor.", True),
        ("# Hello {{ first_name }}\n\nGood to see you.", True), ("The price is ${amount} today and the rest of this sentence is real.", True), ("Hello, undefined! You have NaN new messages.", True),
        ("```\nTraceback (most recent call last):\n  File \"a.py\", line 2, in f\nKeyError: 'x'\n```", True), ("Seite nicht gefunden.", True), ("Page introuvable.", True),
        ("When a page is gone the server should answer with code 404, and the text should be short. " * 3, False), ("The text `{{ title }}` is an example of how such a page is written.", False),
        ("Some sites say “please enable JavaScript” to readers, which is of little help to most of them when they come from far.", False), ("We met on [[Monday]] at noon.", False), ("", False), ("The old dog ran home.", False),
    ],
)
def test_residue_of_main_bodies(body, case) -> None:  # noqa: ANN001
    assert is_case(body) is case


def is_case(body: str) -> bool:
    """The decision over one body alone, in which each message is its own template."""
    model = notices.notices()
    rows = residue.page_rows(1, blocks.parse_markdown(body), model)
    if any(r[1] for r in rows):
        return True
    said = [r for r in rows if r[3] is not None]
    kinds = model.verdicts([r[3].split(" ") for r in said], [r[6] for r in said])
    bad = sum(r[4] for r, k in zip(said, kinds, strict=True) if k == "bad")
    return bad > 0 and bad >= sum(r[2] for r in rows) + sum(r[4] for r, k in zip(said, kinds, strict=True) if k is None and not r[5])


#: Written apart from the labelled table: notices of servers, shops, scripts and site builders, and lines that only look alike.
UNSEEN = """This site requires JavaScript|HTTP Status 410 – Gone|Oops! That page can’t be found.|The requested URL /a/b was not found on this server.|You don't have permission to access this resource.|Whoops, looks like something went wrong.|JavaScript must be enabled in order for you to use this site|502 Bad Gateway nginx|Request timed out|Site under construction|This video is no longer available|The product you were looking for has been removed from our shop|403 Forbidden|We're sorry, but this application doesn't work properly without JavaScript enabled.|Enable scripts to continue|Diese Seite existiert leider nicht|Die gewünschte Seite konnte nicht geladen werden|Cette page n’est plus disponible|Désolé, une erreur est survenue|Lo sentimos, la página que busca ya no existe|Nie ma takiej strony|Страница не найдена|Произошла ошибка сервера|Página não encontrada|Placeholder paragraph for the home page|Insert headline here|Your heading goes here|Sample text, to be replaced|Service temporarily unavailable, please try later|Uncaught TypeError: x is not a function"""
SOUND = """The mill closed in winter because the river was frozen.|Opening hours: 9:00 to 17:00|Bring two cups of flour and a pinch of salt.|The page boy ran down the stairs.|We found the lost dog near the old bridge.|Le moulin du village est ouvert le dimanche.|Die Bücherei liegt hinter der Kirche.|La biblioteca abre los lunes.|Старая мельница стоит у реки.|Tickets cost 12 euros at the door.|She wrote a script for the school play.|My browser of choice is an old bookshop.|Every error in the ledger was his.|Members meet on the first Sunday of the month."""


def test_unseen_notices_are_found() -> None:
    found = [is_case(x) for x in UNSEEN.split("|")]
    assert sum(found) >= 0.9 * len(found), [x for x, f in zip(UNSEEN.split("|"), found, strict=True) if not f]
    assert [x for x in SOUND.split("|") if is_case(x)] == []


@pytest.mark.parametrize("slot", ["*|FNAME|*", "{first_name}", "[FIRST NAME]", "{{#each items}}", "<?php echo $title; ?>", "{{ title }}", "%%NAME%%", "${user.name}", "<%= name %>", "@@place@@", "[Your city here]"])
def test_slots_in_running_text(slot) -> None:  # noqa: ANN001
    assert residue.has_slot(blocks.parse_markdown(f"Dear {slot}, we are glad that you came to the old mill by the river last week.")[0])


def test_templates_are_mined_once_for_all_messages(spark) -> None:  # noqa: ANN001
    rows = [(k, f"u{k}", None, f"# Head\n\nTicket {k}: the file report{chr(97 + k)} could not be found") for k in range(20)]
    rows += [(100 + k, f"v{k}", None, f"# Head\n\n{k + 2} cups of kind lake") for k in range(20)] + [(200, "w", None, "# Head\n\nSeldom seen word order here")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, markdown string")
    got = {r.template: (r.messages, r.occurrences, r.verdict) for r in residue.find_templates(pages).collect()}
    assert got["ticket <num> the file * could not be found"] == (20, 20, "bad")
    assert got["<num> cups of kind lake"] == (1, 20, None)
    assert {r.page_id for r in residue.find_residue(pages).collect()} == set(range(20))


def test_boilerplate_tree_on_held_out_pages() -> None:
    tree = blocks.classifier()
    right = total = 0
    for html, md, labels in blocks.training_pages(120, seed=99):
        lines, x = blocks.page_lines(html, md)
        right += int(((tree.predict(x) >= 0.5).astype(int) == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.97


def test_markup_trees_on_held_out_blocks() -> None:
    x, y = markup.training_blocks(400, seed=77)
    for kind, tree in markup.trees().items():
        assert ((tree.predict(x) >= 0.5) == y[kind].astype(bool)).mean() > 0.97, kind


#: Written apart from the training table: running text with markup, and look-alikes that carry the same signs.
MARKED = {
    "html": ["See the <em>old</em> mill.", "Fish &amp; chips at noon", "It cost &pound;5 in all", "First line<br/>second line", "<div class='note'>The gate is shut.</div>", "the 5<sup>th</sup> of May", "Caf&eacute; by the river", 'an <a href="https://x.example">address</a> to keep'],
    "latex": [r"We cite \textbf{Smith} here.", r"where $\sum_i x_i$ is finite", r"see \ref{fig:one} for more", r"the bound \(n \geq 2\) holds", r"\begin{quote}A word.\end{quote}", "so $e^{x}$ grows fast"],
    "wiki": ["The [[River Ouse|river]] is wide.", "== Early life ==", "He was '''born''' in spring.", "{{citation needed|date=May 2019}} they say", "See [https://x.example/a the archive] for more.", "[[Category:Mills]]"],
    "markdown": ["This is **very** important.", "Read [the report](https://x.example/r) first.", "## A second heading", "Call `open()` at once.", "It was ~~red~~ blue."],
}
PLAIN = ["It fell from $12.50 to $9 in May.", "if a < b and b > c then stop", "AT&T and R&D; then B&B", r"C:\Users\anna\notes.txt", "Dear {{ first.name }}, see [[ORDER]]", "the array[3] (and its tail)", "a List<Integer> of sums", "3 * 4 * 5 = 60", "the #1 song", "5'' of snow and 6' of mud", "x == y but not =====", "<no name given>", "issue #12 is open", "snake_case and __init__", "write to <anna@x.example>", "tom's 'old' coat"]


def test_markup_of_lines_apart_from_the_table() -> None:
    forest = markup.trees()
    wrong = [(kind, t, k) for kind, lines in MARKED.items() for t, k in zip(lines, markup.kinds_of(lines, forest), strict=True) if k != {kind}]
    false = [(t, k) for t, k in zip(PLAIN, markup.kinds_of(PLAIN, forest), strict=True) if k]
    assert len(wrong) <= 2 and len(false) <= 1, (wrong, false)


def test_clean_text_keeps_structure() -> None:
    assert markup.clean("<h2>Head</h2><p>One&nbsp;&amp; two<ul><li>a<li>b</ul><pre>x = 1</pre>", {"html"}) == "## Head\n\nOne & two\n\n* a\n* b\n\n```\nx = 1\n```"
    assert markup.clean("== Head ==\n'''Bold''' [[page|link]] {{cite|a|b=1}}[[Category:X]]", {"wiki"}) == "## Head\n\nBold link"
    assert markup.clean("\\section{Head} \\emph{x}~\\cite{a} is $\\frac{1}{2}$", {"latex"}) == "## Head\n x is $\\frac{1}{2}$"


def test_sentences_and_syllables() -> None:
    assert reading.sentences("See fig. 3.5 on p. 9. Dr. Who came at 5 p.m. yesterday! Really? Yes.") == ["See fig. 3.5 on p. 9.", "Dr. Who came at 5 p.m. yesterday!", "Really?", "Yes."]
    for word, n in {"the": 1, "table": 2, "baked": 1, "wanted": 2, "people": 2, "official": 3, "delivery": 4, "create": 2, "boxes": 2, "change": 1, "samples": 2, "museum": 3, "curious": 3, "station": 2, "idea": 3, "science": 2, "called": 1, "played": 1, "little": 2, "strength": 1, "differentiation": 6, "useful": 2, "hopeless": 2, "likely": 2, "elementary": 5}.items():
        assert reading.syllables(word) == n, word


def test_reading_bands() -> None:
    easy = "The dog ran to the mill. It was hot. " * 20
    middle = "Visitors often describe the museum as useful and rather remote, which explains why the council finally repaired it. " * 6
    hard = "Institutional differentiation necessitates interdisciplinary configuration of administrative responsibilities, notwithstanding considerable organizational heterogeneity. " * 8
    assert [reading.band(reading.measure([t])[1]) for t in (easy, middle, hard)] == ["easy", "middle", "hard"]


def test_stuffed_blocks_are_redundant(spark) -> None:  # noqa: ANN001
    rng = random.Random(4)
    nouns = "river mill garden bridge teacher window letter summer station evening village corner season doctor castle".split()

    def prose() -> str:
        return " ".join(f"The {rng.choice(nouns)} of the {rng.choice(nouns)} was {rng.choice(['old', 'new', 'calm', 'wide'])} when the {rng.choice(nouns)} came to {rng.choice(nouns)} number {rng.randint(1, 99)}." for _ in range(8))

    rows = [(i, f"u{i}", None, "# T\n\n" + "\n\n".join(prose() for _ in range(3))) for i in range(60)]
    rows += [
        (100, "u", None, "# cheap lamps\n\n" + " ".join(f"desk lamp in Town{k}!" for k in range(40))), (101, "u", None, "\n".join(f"* cheap {rng.choice(nouns)} lamp" for _ in range(60))),
        (102, "u", "<main><h1>T</h1><ul>" + "".join(f"<li><a href=/{k}>{nouns[k % 14]} lamp</a></li>" for k in range(40)) + "</ul></main>", "# T\n\n" + "\n".join(f"* [{nouns[k % 14]} lamp](https://x.example/{k})" for k in range(40))), (103, "u", None, "# Cake\n\n" + "\n".join(f"* {rng.randint(2, 90)} cups of {n}" for n in nouns * 2)), (104, "u", None, "* [a](https://x.example/1)"),
    ]
    got = {r.page_id for r in stuffing.find_stuffed(spark.createDataFrame(rows, "page_id long, url string, html string, markdown string")).collect()}
    assert got == {100, 101, 102}
