"""Evaluation texts leaking into training text (problem 9).

The test items are indexed once: an inverted index of their words with BM25 impacts, the items cut into blocks
and the highest impact of each word kept by block. Every document is cut into overlapping passages, and each
passage is a query: blocks whose summed block maxima stay below the threshold are skipped, the others are
scored posting by posting, and every item above its threshold goes on to the verification (block-max WAND, one
block at a time). The threshold is no tuning knob: it is the least score a passage can have that holds as much
of the item as the verification asks for, so no true case is lost in retrieval. The verification finds the
longest common subsequence of item and passage within one stretch.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: Share of an item's words that must stand in order in one stretch (more than this), share of the names and numbers
#: between the first and the last of them that must be among them, and the document's widest gap between two of them, in words.
MIN_WORDS, MIN_NAMES, GAP = 0.5, 0.5, 8
ITEMS_PER_BLOCK = 16
#: Items indexed at once; more items are taken in rounds, each against all documents.
ITEMS_PER_ROUND = 50_000


def words(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def stretch(n: int) -> int:
    """Words of a document that may hold an item of n words: some may be put in."""
    return int(1.3 * n) + 6


def in_order(mask: dict[str, int], n: int, seq: list[str]) -> int:
    """Length of the longest common subsequence; mask has the places of each of the item's n words as bits."""
    full = (1 << n) - 1
    v = full
    for w in seq:
        m = mask.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def masks(seq: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, w in enumerate(seq):
        out[w] = out.get(w, 0) | 1 << k
    return out


class Words:
    """Number of items, their mean length and the items of each word, over all items whatever round they fall in."""

    def __init__(self) -> None:
        self.items, self.total, self.df = 0, 0, Counter()

    def add(self, text: str | None) -> None:
        w = words(text) if text else []
        self.items += bool(w)
        self.total += len(w)
        self.df.update(set(w))

    @property
    def mean(self) -> float:
        return self.total / max(1, self.items)


class Index:
    """Inverted index over the items of a round, with impacts divided by each item's threshold, so that all share threshold 1."""

    def __init__(self, items: list[tuple[int, str]], known: Words | None = None):
        own = [(i, t, words(t)) for i, t in items if t]
        own = [(i, t, w) for i, t, w in own if w]
        if known is None:
            known = Words()
            for _, t, _ in own:
                known.add(t)
        n_items, df, mean = known.items, known.df, known.mean
        # items that share a rare word stand in one block, so that a block's maxima come from few kinds of items
        own.sort(key=lambda x: (min(((df[w], w) for w in set(x[2]) if df[w] > 1), default=(0, "")), len(x[2])))
        self.ids = [i for i, _, _ in own]
        df = {w: df[w] for _, _, ws in own for w in ws}
        self.vocab = {w: k for k, w in enumerate(sorted(df))}
        rare = max(1, int(0.02 * n_items))
        self.words, self.is_name, self.masks = [], [], []
        posts: list[list[tuple[int, float, float]]] = [[] for _ in self.vocab]
        for k, (_, text, ws) in enumerate(own):
            capital = {c for x in WORD.findall(text) if x[:1].isupper() for c in words(x)}
            tf = Counter(ws)
            norm = K1 * (1 - B + B * len(ws) / mean)
            impact = {x: math.log(1 + (n_items - df[x] + 0.5) / (df[x] + 0.5)) * f * (K1 + 1) / (f + norm) for x, f in tf.items()}
            per = {x: impact[x] / tf[x] for x in tf}  # of one occurrence; a passage that has some occurrences has the word's whole impact
            least = sum(sorted(per[x] for x in ws)[: math.floor(MIN_WORDS * len(ws)) + 1])
            for x, v in impact.items():
                # of what the verification asks for: impact, and occurrences
                posts[self.vocab[x]].append((k, v / least, tf[x] / (math.floor(MIN_WORDS * len(ws)) + 1)))
            self.words.append(ws)
            self.is_name.append([x.isdigit() or (x in capital and df[x] <= rare) for x in ws])
            self.masks.append(masks(ws))
        self.post_items = [np.array([p[0] for p in ps], np.int32) for ps in posts]
        self.post_impact, self.post_share = ([np.array([p[j] for p in ps]) for ps in posts] for j in (1, 2))
        self.n_blocks = -(-len(own) // ITEMS_PER_BLOCK)
        self.block_ids, self.block_max = [], []
        for its, imp in zip(self.post_items, self.post_impact, strict=True):
            blocks, first = np.unique(its // ITEMS_PER_BLOCK, return_index=True)
            self.block_ids.append(blocks)
            self.block_max.append(np.maximum.reduceat(imp, first))
        longest = max((len(w) for w in self.words), default=1)
        self.step = max(64, stretch(longest))

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, impact) of all items above threshold for a passage of these distinct terms."""
        upper = np.bincount(np.concatenate([self.block_ids[t] for t in terms]), np.concatenate([self.block_max[t] for t in terms]), self.n_blocks)
        alive = upper >= 1 - 1e-9
        if not alive.any():
            return []
        its, impact, share = (np.concatenate([post[t] for t in terms]) for post in (self.post_items, self.post_impact, self.post_share))
        if not alive.all():
            keep = alive[its // ITEMS_PER_BLOCK]
            its, impact, share = its[keep], impact[keep], share[keep]
        score = np.bincount(its, impact)
        # an item's words may all be there and still be too few occurrences, or the other way round
        return [(int(k), float(score[k])) for k in np.flatnonzero((score >= 1 - 1e-9) & (np.bincount(its, share) >= 1 - 1e-9))]

    def verify(self, k: int, seq: list[str], have: set[str]) -> tuple[int, int] | None:
        """(words in order, place of the stretch) if the passage holds the item, else None."""
        ws, mask = self.words[k], self.masks[k]
        n, need = len(ws), math.floor(MIN_WORDS * len(ws)) + 1
        if sum(x in have for x in ws) < need:
            return None
        places, size = [p for p, w in enumerate(seq) if w in mask], stretch(n)
        step, last, reach, able = max(1, n // 4), -1, False, []
        for a, p in enumerate(places):
            if a + need > len(places) or places[a + need - 1] - p >= size:
                continue  # too few of the item's words in this stretch
            if last < 0 or p - last >= step:
                # no stretch that begins in the next `step` words holds more than this wider one
                last, reach = p, in_order(mask, n, seq[p : p + size + step]) >= need
                if reach:
                    able.append((0, p))
            if reach and (got := in_order(mask, n, seq[p : p + size])) > -able[-1][0]:
                able[-1] = (-got, p)
        # the best stretch may lack names or hold a gap where another doesn't; what is aligned reaches further than `step`
        return next((x for g, p in sorted(able) if -g >= need and (x := self.aligned(k, seq, p, size, need))), None)

    def aligned(self, k: int, seq: list[str], start: int, size: int, need: int) -> tuple[int, int] | None:
        """The longest chain of matches without a wide gap, if it has enough words and the names that belong in it."""
        ws, names = self.words[k], self.is_name[k]
        start = max(0, start - size // 4)
        part = seq[start : start + size + size // 4]
        n, m = len(ws), len(part)
        table = [[0] * (m + 1)]
        for i in range(n):
            above, row, w = table[-1], [0] * (m + 1), ws[i]
            for j in range(m):
                row[j + 1] = above[j] + 1 if w == part[j] else max(above[j + 1], row[j])
            table.append(row)
        pairs, i, j = [], n, m
        while i and j:
            if ws[i - 1] == part[j - 1] and table[i][j] == table[i - 1][j - 1] + 1:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif table[i - 1][j] >= table[i][j - 1]:
                i -= 1
            else:
                j -= 1
        pairs.reverse()
        chains, chain = [], pairs[:1]
        for a, b in zip(pairs, pairs[1:]):  # noqa: B905
            if b[1] - a[1] > GAP:  # what the document leaves out of the item is no gap
                chains.append(chain)
                chain = []
            chain.append(b)
        best = max([*chains, chain], key=len)
        if len(best) < need:
            return None
        within = [i for i in range(best[0][0], best[-1][0] + 1) if names[i]]
        there = sum(names[i] for i, _ in best)
        if there < MIN_NAMES * len(within):
            return None
        return len(best), start + best[0][1]

    def search(self, text: str) -> dict[int, tuple[int, int, float]]:
        """item -> (words in order, first word of the stretch, score) for a document."""
        seq = words(text)
        vocab, found = self.vocab, {}
        ids = [vocab.get(w, -1) for w in seq]
        for start in range(0, max(1, len(seq) - self.step), self.step):
            terms = list({t for t in ids[start : start + 2 * self.step] if t >= 0})
            hits = self.retrieve(terms) if terms else []
            if hits:
                part = seq[start : start + 2 * self.step]
                have = set(part)
                for k, score in hits:
                    got = self.verify(k, part, have)
                    if got and (k not in found or got[0] > found[k][0]):
                        found[k] = (got[0], start + got[1], score)
        return found


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, words_in_order, item_words, first_word) for each document that holds a test item.

    Null or wordless texts on either side match nothing; no items or no documents give an empty result; repeated
    rows give repeated rows. Other columns are ignored. Counts of words are taken over
    all items, which are then indexed in rounds of ITEMS_PER_ROUND (how they fall into rounds changes no row); the documents are read once a round and never shuffled.
    """
    spark = documents.sparkSession
    schema = f"`{doc_id}` {documents.schema[doc_id].dataType.simpleString()}, `{item_id}` {items.schema[item_id].dataType.simpleString()}, words_in_order int, item_words int, first_word int"
    known = Words()
    for r in items.select(item_text).toLocalIterator():
        known.add(r[0])
    rows = items.select(item_id, item_text).where(f"`{item_text}` is not null").sort(item_id).toLocalIterator()
    out, batch, more = None, [], True
    while more:
        batch = [tuple(r) for _, r in zip(range(ITEMS_PER_ROUND), rows)]  # noqa: B905
        more = len(batch) == ITEMS_PER_ROUND
        index = spark.sparkContext.broadcast(Index(batch, known))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix: Index = index.value
            for b in batches:
                rows = [(d, ix.ids[k], v[0], len(ix.words[k]), v[1]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and ix.ids for k, v in ix.search(t).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows, strict=True), types, strict=True)], names)

        probe = documents.select(doc_id, text)
        target = spark.createDataFrame([], schema).schema
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        types, names = arrow.types, arrow.names
        part = probe.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
