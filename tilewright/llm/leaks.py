"""Evaluation items inside corpus documents: rare n-gram seeds, then local alignment.

1. Documents are read once. Their words (in the consistent form, without regard to case) are coded by the items' vocabulary, and
   documents that hold any word n-gram of any item are kept with the places of these n-grams.
2. The corpus frequency of each item n-gram is counted from those places. Every window of an item that could leak
   (``min_words`` successive words) takes its rarest n-gram as its seed; a copy of a window holds the window's seed.
3. Seeds join documents to items. Each pair is aligned by Smith-Waterman on words over the region around its seeds, which
   gives the score of edited copies and, from the same table, the longest run of successive equal words.

The rarest n-gram of a window is often one that an edit broke, so these seeds find whole windows, not edited copies. For
edited copies (``alignments``) the seeds are the shortest n-grams, all pairs of successive words of an item: a passage that
is nearly a full match must keep a number of them close together, so none is lost.

Items are held by every task, so they are worked off in blocks of bounded size; any number of items is taken.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tilewright.llm.lookalike import Rewriter, representatives
from tilewright.runtime import Cut

WORD = regex.compile(r"[\p{L}\p{Nd}]+")
GREEK = regex.compile(r"\p{Greek}")
MATCH, MISMATCH, GAP = 2, -1, -1


@cache
def latin_form():
    """The rewriting to the consistent form with Latin letters as representatives, made once a process."""
    return Rewriter(representatives()).form


@cache
def small_letters() -> dict[int, str]:
    """Small letters whose capital is written as another letter in the form, and the small letter of that one.

    The form makes a Latin B of a Cyrillic or Greek one, but their small letters look like no Latin letter, so that without this
    a word would not equal itself in capitals. A small letter that looks like another one itself is left alone.
    """
    written = representatives()
    out = {"\u03c2": "\u03c3"}
    for capital, best in written.items():
        small = capital.lower()
        shown = written.get(small, small)
        if len(capital) == len(best) == len(small) == 1 and small != capital and not shown.isascii() and best.lower() != shown:
            out[shown] = best.lower()
    return {ord(a): out.get(b, b) for a, b in out.items()}


@lru_cache(200_000)
def uncased(word: str) -> str:
    """A word of the form without regard to case. A small nu has the form of a v and its capital that of an N, so in words with
    other Greek letters a v stands for nu."""
    word = word.lower()
    if "v" in word and GREEK.search(word):
        word = word.replace("v", "n")
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(small_letters()))


def words(form: str) -> list[str]:
    """The words of a text in its form. An accent that no letter is composed with ends a word, which is looked for in the small
    letters again, as a capital may have been composed with it."""
    if form.isascii():
        return WORD.findall(form.lower())
    return [x for w in WORD.findall(form) for x in ((w.lower(),) if w.isascii() else WORD.findall(uncased(w)))]


def words_of(text: str) -> list[str]:
    return words(latin_form()(text))


@dataclass
class Items:
    """The evaluation items of a block, coded; their number is bounded, as they are broadcast."""

    ids: list
    coded: list[np.ndarray]
    vocabulary: dict[str, int]
    size: int
    #: n-gram length -> n-gram (tuple of codes) -> its number
    grams: dict[int, dict[tuple[int, ...], int]] = field(default_factory=dict)
    #: places (item, first word) of each n-gram
    places: list[list[tuple[int, int]]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list, size: int) -> Items:
        """From rows (i, t) of ids and texts."""
        spelled = [words_of(r["t"] or "") for r in rows]
        vocabulary: dict[str, int] = {}
        coded = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int32) for ws in spelled]
        self = cls([r["i"] for r in rows], coded, vocabulary, size)
        for k, c in enumerate(coded):
            n = min(size, len(c))
            book = self.grams.setdefault(n, {}) if n else {}
            for at in range(len(c) - n + 1 if n else 0):
                g = book.setdefault(tuple(c[at : at + n].tolist()), len(self.places))
                if g == len(self.places):
                    self.places.append([])
                self.places[g].append((k, at))
        return self

    def code(self, ws: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in ws), np.int32, len(ws))

    def hits(self, coded: np.ndarray) -> tuple[list[int], list[int]]:
        """Numbers and places of all item n-grams in a document."""
        found, at = [], []
        known = coded > 0
        for n, book in self.grams.items():
            if len(coded) < n:
                continue
            run = np.convolve(known, np.ones(n, np.int32), "valid") == n
            for p in np.flatnonzero(run).tolist():
                g = book.get(tuple(coded[p : p + n].tolist()))
                if g is not None:
                    found.append(g)
                    at.append(p)
        return found, at

    def seeds(self, frequency: dict[int, int], min_words: int) -> dict[int, list[tuple[int, int]]]:
        """n-gram -> the places (item, word) where it is the rarest one of some window."""
        chosen: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for k, c in enumerate(self.coded):
            n = min(self.size, len(c))
            if not n:
                continue
            book = self.grams[n]
            of = [book[tuple(c[p : p + n].tolist())] for p in range(len(c) - n + 1)]
            span = max(1, min(min_words, len(c)) - n + 1)
            for w in range(len(of) - span + 1):
                best = min(range(w, w + span), key=lambda p: (frequency.get(of[p], 0), p))
                chosen[of[best]].add((k, best))
        return {g: sorted(p) for g, p in chosen.items()}


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, longest run of successive equal words) of two coded texts; 0 equals nothing.

    One row of the table per item word, each computed as a whole: a gap along the document is a running maximum.
    """
    slope = GAP * np.arange(len(doc))
    score = np.zeros(len(doc), np.int64)
    run = np.zeros(len(doc), np.int32)
    best = longest = 0
    for w in item.tolist():
        equal = doc == w if w else np.zeros(len(doc), bool)
        before = np.concatenate([[0], score[:-1]])
        up = np.maximum(np.where(equal, before + MATCH, before + MISMATCH), score + GAP)
        up = np.maximum(up, 0)
        score = np.maximum(np.maximum.accumulate(up - slope) + slope, 0)
        run = np.where(equal, np.concatenate([[0], run[:-1]]) + 1, 0)
        best, longest = max(best, int(score.max(initial=0))), max(longest, int(run.max(initial=0)))
    return best, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlap or touch as one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def regions(at: list[int], reach: int, n: int) -> list[tuple[int, int]]:
    """The stretches of a document of ``n`` words within ``reach`` words of a seed, merged where they overlap."""
    return merged([(max(0, p - reach), min(n, p + reach)) for p in at])


def item_blocks(benchmark: DataFrame, item_id: str, text: str, max_items: int, max_chars: int) -> Iterator[list]:
    """The items (i, t) in blocks of at most ``max_items`` rows and ``max_chars`` characters (or one longer item).

    Items are hashed into bins, whose sizes are counted first; a bin that is too large is hashed again into more of them. Null ids are
    left out. A block is sorted, so its order does not depend on partitions.
    """
    rows = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    weighed = rows.select("*", F.coalesce(F.length("t"), F.lit(0)).alias("_n"))
    one = weighed.agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("chars")).first()
    need = max(1, -(-one["rows"] // max_items), -(-(one["chars"] or 0) // max_chars))
    whole = [(0, 1, F.lit(True))] if need == 1 else []
    split = [(F.lit(True), 2 * need, 0)] if need > 1 else []
    while split:
        inside, n, seed = split.pop()
        slot = F.pmod(F.xxhash64(F.lit(seed), F.col("i").cast("string"), "t"), F.lit(n))
        sizes = weighed.where(inside).groupBy(slot.alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("chars"), F.count_distinct("i", "t").alias("kinds"))
        for r in sizes.toLocalIterator():  # a row a bin
            here = inside & (slot == r["b"])
            if (r["rows"] <= max_items and r["chars"] <= max_chars) or r["kinds"] <= 1:
                whole.append((seed, r["b"], here))
            else:
                split.append((here, 2 * max(-(-r["rows"] // max_items), -(-r["chars"] // max_chars)), seed + 1))
    for *_, here in whole:
        yield sorted(rows.where(here).collect(), key=lambda r: (str(r["i"]), r["t"] or ""))


def _pairs(ids: list, items: list, numbers: list[list], id_type: pa.DataType, item_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(items, item_type), *(pa.array(c, pa.int32()) for c in numbers)], names=["doc_id", "item_id", *names])


def leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    min_words: int = 12,
    gram: int = 5,
    max_items: int = 20_000,
    max_chars: int = 32_000_000,
) -> DataFrame:
    """(doc_id, item_id, score, similarity, run, item_words) of every document and item that share a seed.

    ``run`` is the longest run of successive item words that stands in the document in the same order with nothing but
    non-words between; a leak in the strict sense has ``run >= min(min_words, item_words)``, and none of these is lost.
    ``score`` is the best local alignment (match 2, mismatch and gap -1), ``similarity`` its share of a full match.
    Words are the longest runs of letters and digits, without regard to case, in the consistent form of look-alike
    texts. Null and empty texts and items without a word leak nothing; null ids are left out, ids may be of any type; items
    that repeat a text are reported each; repeated documents too. Items are worked off in blocks of ``max_items`` rows and
    ``max_chars`` characters, one pass over the documents each. An empty corpus or benchmark gives no rows.
    """
    parts = [_leaks(documents, rows, benchmark.schema[item_id].dataType, doc_id, text, min_words, gram) for rows in item_blocks(benchmark, item_id, text, max_items, max_chars)]
    return reduce(DataFrame.unionByName, parts)


def _leaks(documents: DataFrame, rows: list, item_type, doc_id: str, text: str, min_words: int, gram: int) -> DataFrame:
    spark = documents.sparkSession
    items = Items.of(rows, gram)
    shared = spark.sparkContext.broadcast(items)
    doc_kind, item_kind, item_arrow = dict(documents.dtypes)[doc_id], item_type.simpleString(), to_arrow_type(item_type)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            ids, coded, grams, at = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not t:
                    continue
                c = items.code(words_of(t))
                g, p = items.hits(c)
                if g:
                    ids.append(i)
                    coded.append(c)
                    grams.append(g)
                    at.append(p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(coded, pa.list_(pa.int32())), pa.array(grams, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int32()))],
                names=["doc_id", "coded", "grams", "at"],
            )

    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = Cut(texts.mapInArrow(scan, f"doc_id {doc_kind}, coded array<int>, grams array<int>, at array<int>"), "held").df
    counted = held.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    seeds = items.seeds({r["g"]: r["n"] for r in counted.collect()}, min_words)  # as many rows as the items have n-grams
    chosen = spark.sparkContext.broadcast(seeds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seeds = shared.value, chosen.value
        for batch in batches:
            out: list[tuple] = []
            for i, coded, grams, at in zip(*(batch.column(c).to_pylist() for c in range(4))):
                near: dict[int, list[int]] = defaultdict(list)
                for g, p in zip(grams, at):
                    for k, _ in seeds.get(g, ()):
                        near[k].append(p)
                doc = np.array(coded, np.int32)
                for k, places in near.items():
                    item = items.coded[k]
                    best = [align(doc[a:b], item) for a, b in regions(places, 2 * len(item), len(doc))]
                    out.append((i, items.ids[k], max(s for s, _ in best), max(r for _, r in best), len(item)))
            ids, found, *numbers = list(zip(*out)) or [()] * 5
            yield _pairs(ids, found, numbers, batch.schema.field(0).type, item_arrow, ["score", "run", "item_words"])

    pairs = held.mapInArrow(score, f"doc_id {doc_kind}, item_id {item_kind}, score int, run int, item_words int")
    return pairs.select("doc_id", "item_id", "score", (F.col("score") / (MATCH * F.col("item_words"))).alias("similarity"), "run", "item_words")


@dataclass
class Pairs:
    """The pairs of successive words of the items (of items of one word, that word), as sorted keys with their items.

    A passage is a stretch of ``l`` successive item words, ``low <= l < 2 * low`` (``low``: ``min_words`` or the whole item, if
    it is shorter). If a longer one is aligned with a share of a full match, so is one of its halves. An alignment of ``a``
    equal words and ``e`` mismatches and gaps has the score 2a - e, with a <= l. If the score is s >= share * 2l, then
    e <= 2l - s. The equal words stand in e + 1 runs at most, so a - e - 1 >= s - l - 1 pairs of successive item words stand in
    the document, on a + e <= 3l - s of its words and on diagonals that are e apart at most.
    """

    keys: np.ndarray
    #: items of pair ``g``: ``items[bounds[g] : bounds[g + 1]]``; pairs of item ``k`` in its order: ``own[k]``
    bounds: np.ndarray
    items: np.ndarray
    own: list[np.ndarray]
    low: np.ndarray
    #: (pairs, words of the document) of each passage length of item ``k``, the fewest pairs first
    bars: list[list[tuple[int, int]]]
    need: np.ndarray
    #: how many diagonals an alignment may move over
    drift: np.ndarray
    base: int
    single: bool

    @classmethod
    def of(cls, items: Items, share: float, min_words: int) -> Pairs:
        if not 0.75 < share <= 1:
            raise ValueError("below a share of 0.75 an alignment need not keep a pair of words")
        base = len(items.vocabulary) + 1
        raw = [c[:-1].astype(np.int64) * base + c[1:] if len(c) > 1 else c.astype(np.int64) for c in items.coded]
        keys = np.unique(np.concatenate([np.zeros(0, np.int64), *raw]))
        own = [np.searchsorted(keys, r) for r in raw]
        each = [np.unique(o) for o in own]
        pair = np.concatenate([np.zeros(0, np.int64), *each])
        item = np.repeat(np.arange(len(own)), [len(o) for o in each])
        size = np.array([len(c) for c in items.coded], np.int64)
        low = np.minimum(size, min_words)
        bounds = np.searchsorted(np.sort(pair), np.arange(len(keys) + 1))
        bars = [_bars(a, min(b, 2 * a - 1), share) for a, b in zip(low.tolist(), size.tolist())]
        need = np.array([b[0][0] if b else 1 for b in bars], np.int64)
        high = np.minimum(size, np.maximum(2 * low - 1, 0))
        drift = 2 * high - np.floor(MATCH * share * high).astype(np.int64)
        return cls(keys, bounds, item[np.argsort(pair, kind="stable")], own, low, bars, need, drift, base, bool((size == 1).any()))

    def held(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a document, sorted, and their places."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = doc > 0
        at = np.flatnonzero(known[:-1] & known[1:])
        key = doc[at].astype(np.int64) * self.base + doc[at + 1]
        if self.single:
            alone = np.flatnonzero(known)
            at, key = np.concatenate([at, alone]), np.concatenate([key, doc[alone].astype(np.int64)])
        g = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[g] == key
        g, at = g[hit], at[hit]
        order = np.argsort(g, kind="stable")
        return g[order], at[order]

    def candidates(self, doc: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Every item of which a document may hold a passage, with the stretches of the document where it may stand."""
        g, at = self.held(doc)
        if not len(g):
            return
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        distinct, times = g[first], np.diff(np.concatenate([first, [len(g)]]))
        length = self.bounds[distinct + 1] - self.bounds[distinct]
        entry = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(self.bounds[distinct], length)
        total = np.bincount(self.items[entry], np.repeat(times, length), len(self.own))
        for k in np.flatnonzero(total >= self.need).tolist():
            lo, hi = np.searchsorted(g, self.own[k]), np.searchsorted(g, self.own[k], "right")
            n_at = hi - lo
            row = np.repeat(np.arange(len(lo)), n_at)
            places = at[np.arange(n_at.sum()) - np.repeat(np.cumsum(n_at) - n_at, n_at) + np.repeat(lo, n_at)]
            # bands of diagonals, twice and half a band apart, so that any alignment lies in one of them; far apart on one axis
            wide, far = 2 * int(self.drift[k]) + 2, 4 * len(doc)
            diagonal = places - row + len(lo)
            bands = np.concatenate([2 * (diagonal // wide), 2 * ((diagonal + wide // 2) // wide) + 1])
            axis = np.sort(bands * far + np.concatenate([places, places]))
            near = []
            n, widest = self.bars[k][0][0], self.bars[k][-1][1]
            if n > len(axis) or (axis[n - 1 :] - axis[: len(axis) - n + 1]).min() >= widest:
                continue
            for n, span in self.bars[k]:
                if n > len(axis):
                    break
                first = (axis[n - 1 :] - axis[: len(axis) - n + 1] < span).nonzero()[0]
                if len(first):
                    near += zip(np.maximum(axis[first + n - 1] % far - span, 0).tolist(), np.minimum(axis[first] % far + span + 1, len(doc)).tolist())
            if near:
                yield k, merged(near)


def _bars(low: int, high: int, share: float) -> list[tuple[int, int]]:
    """What an alignment keeps of a passage: at least so many pairs on at most so many words of the document, for each number of pairs the most words."""
    out: dict[int, int] = {}
    for n in range(low, high + 1):
        least = _least(n, share)
        pairs = max(1, least - n - 1)
        out[pairs] = max(out.get(pairs, 1), 3 * n - least)
    return sorted(out.items())


def least_score(words: int | np.ndarray, share: float) -> np.ndarray:
    """The lowest score that is ``share`` of a full match of so many words."""
    return np.ceil(MATCH * share * np.asarray(words, np.int64) - 1e-9).astype(np.int64)


@cache
def _least(words: int, share: float) -> int:
    return int(least_score(words, share))


def passages(doc: np.ndarray, item: np.ndarray, low: int, share: float = 0.0) -> tuple[int, int]:
    """(score, words) of the item's passage of ``low`` to ``2 * low - 1`` words with the best share of a full match, the longest of equals.

    The alignments of the passages that begin at each item word are computed side by side, one item word of all of them a step. With a
    ``share``, passages that cannot reach it are passed over: of an alignment with score s, the equal words and the pairs of successive
    equal words are s - 1 or more together.
    """
    m, most = len(item), min(len(item), 2 * low - 1)
    padded = np.concatenate([item, np.full(most, -1, item.dtype)])
    same = (padded[:, None] == doc[None, :]) & (padded[:, None] > 0)
    starts = np.arange(m - low + 1)
    if share:
        equal = np.concatenate([[0], np.cumsum(same.any(axis=1))])
        pairs = np.concatenate([[0], np.cumsum((same[:-1, :-1] & same[1:, 1:]).any(axis=1))])
        good = np.zeros(len(starts), bool)
        for n in range(low, most + 1):
            at = starts[: m - n + 1]
            good[: len(at)] |= equal[at + n] - equal[at] + pairs[at + n - 1] - pairs[at] >= _least(n, share) - 1
        starts = starts[good]
        if not len(starts):
            return 0, low
    gain = np.where(same, MATCH, MISMATCH).astype(np.int16)
    slope = (GAP * np.arange(len(doc))).astype(np.int16) if len(doc) < 30_000 else GAP * np.arange(len(doc))
    score = np.zeros((len(starts), len(doc)), slope.dtype)
    up = np.empty_like(score)
    seen = np.zeros(len(starts), np.int64)
    best = (0, low)
    for step in range(most):
        up[:, :1] = 0
        up[:, 1:] = score[:, :-1]
        up += gain[starts + step]
        np.maximum(up, score + GAP, out=up)
        np.maximum(up, 0, out=up)
        up -= slope
        np.maximum.accumulate(up, axis=1, out=score)
        score += slope
        np.maximum(seen, score.max(axis=1, initial=0), out=seen)
        n = step + 1
        if n >= low:
            inside = seen[starts <= m - n]
            top = int(inside.max()) if len(inside) else 0
            if top * best[1] >= best[0] * n:
                best = (top, n)
    return best


def alignments(
    documents: DataFrame,
    benchmark: DataFrame,
    share: float = 0.8,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    min_words: int = 12,
    max_items: int = 20_000,
    max_chars: int = 32_000_000,
) -> DataFrame:
    """(doc_id, item_id, score, similarity, passage_words, run, item_words) of every document with an edited or whole copy of a passage of an item.

    A passage is a stretch of at least ``min_words`` successive words of the item (of a shorter item, all of them). It stands in the
    document if its best local alignment (match 2, mismatch and gap -1) is ``share`` of a full match or more; none is lost.
    Passages of ``min_words`` to less than twice as many words decide, as one of them is in any longer one. Given are the score and
    the words of the one with the best share, the longest of equals, and the longest run of equal words. Words, ids, blocks
    of items and the treatment of nulls and empty texts are those of ``leaks``.
    """
    parts = [_alignments(documents, rows, benchmark.schema[item_id].dataType, share, doc_id, text, min_words) for rows in item_blocks(benchmark, item_id, text, max_items, max_chars)]
    return reduce(DataFrame.unionByName, parts)


def _alignments(documents: DataFrame, rows: list, item_type, share: float, doc_id: str, text: str, min_words: int) -> DataFrame:
    items = Items.of(rows, 1)
    shared = documents.sparkSession.sparkContext.broadcast((items, Pairs.of(items, share, min_words)))
    doc_kind, item_kind, item_arrow = dict(documents.dtypes)[doc_id], item_type.simpleString(), to_arrow_type(item_type)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, pairs = shared.value
        for batch in batches:
            out: list[tuple] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not t:
                    continue
                doc = items.code(words_of(t))
                for k, places in pairs.candidates(doc):
                    item, low = items.coded[k], int(pairs.low[k])
                    found = [passages(doc[a:b], item, low, share) for a, b in places]
                    best, n = max(found, key=lambda f: (f[0] / f[1], f[1]))
                    if best >= _least(n, share):
                        out.append((i, items.ids[k], best, n, max(align(doc[a:b], item)[1] for a, b in places), len(item)))
            ids, found, *numbers = list(zip(*out)) or [()] * 6
            yield _pairs(ids, found, numbers, batch.schema.field(0).type, item_arrow, ["score", "passage_words", "run", "item_words"])

    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = texts.mapInArrow(score, f"doc_id {doc_kind}, item_id {item_kind}, score int, passage_words int, run int, item_words int")
    return found.select("doc_id", "item_id", "score", (F.col("score") / (MATCH * F.col("passage_words"))).alias("similarity"), "passage_words", "run", "item_words")
