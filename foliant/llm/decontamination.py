"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

Items are the indexed side, each training passage (a window of words, half overlapping the next) is a query. Item
scores are divided by the score that an item gets against itself, so one threshold holds for all. Postings lie in blocks
of items; each term has its largest weight over all items and, sparsely, over each block that holds it. Terms of a window
whose largest weights together stay below a part of the threshold open no block by themselves; blocks of the other terms are dropped
when the sum of block maxima and of what those terms can add can't reach the threshold. In the blocks that are left, WAND
runs: items by number, terms by their next item, and an item is scored only when the block maxima of the terms up to the
pivot reach the threshold.

An item of more than `PASSAGE` words is also indexed by passages of that many words, half overlapping, each with a score
of its own: the whole of it may fit no window, but each of its passages lies whole in one. What is retrieved, by the item
or by a passage, is the item, and its score is the best of them.

Each indexed text is searched by windows of its own length: the least power of two that is twice its words or more, `window` at least. Texts of
one window size share postings, and a document is cut into windows once for each size that occurs. So an item's windows are the same
with and without any other item; others move its scores by document frequencies and the mean length alone.

What is retrieved is verified against the words around the window: an item's question is its first two thirds, its
answer the rest; of the shingles of each, at least `overlap` must occur there. A pair whose shingles agree by chance in
one part alone is not a leak. Shingles are numbers of their words' numbers, exact for up to three words.

Words: A-Z lower-cased, ASCII punctuation and white space divide.

Cases: items of any length, short ones too, are retrieved and verified alike; an item without words matches nothing; items
equal in id and text are one, texts that differ under one id each match for themselves (so may give equal pairs), a null id is an
id like others; a null or empty text has no words; a very long text has as many windows as it needs; of equal scores the windows'
first counts; repeated rows of docs each give their pairs; an empty table on either side gives no pair; further columns are left out.

Items come to the executors in groups of at most `group_bytes` of text, each group in a pass of its own over the documents
(its result is written before the next begins); document frequencies are counted by Spark over all items.
"""

from __future__ import annotations

import math
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import LOWER, UPPER, bound_batches, fresh, row_hash, small_side, stash, utf8

K1, B = 1.2, 0.75
BLOCK = 4
PASSAGE = 256
DIVIDERS = string.punctuation + string.whitespace
_DIVIDE = bytes(ord(" ") if chr(i) in DIVIDERS else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Cells (window by block) that are summed at once.
CELLS = 500_000
#: The terms of a window that open no block add less than this share of the threshold: below 1, so that few blocks are left to look at.
OPEN = 0.4
#: Words of short texts that are searched at once.
AT_ONCE = 20_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_DIVIDE).split()


def passages(words: list[bytes]) -> list[list[bytes]]:
    """The words, and where they are many also half-overlapping passages that cover them, the last one at the end."""
    n = len(words)
    starts = [*range(0, n - PASSAGE, PASSAGE // 2), n - PASSAGE] if n > PASSAGE else []
    return [words, *(words[i : i + PASSAGE] for i in starts)]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def shingle_keys(terms: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k terms, -1 where one of them is unknown (0)."""
    n = len(terms) - k + 1
    if n <= 0 or not k:
        return np.empty(0, np.int64)
    key, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(k):
        part = terms[i : i + n]
        key = key * np.uint64(1 << 21 if k <= 3 else 0x9E3779B97F4A7C15) + part.astype(np.uint64)
        known &= part > 0
    return np.where(known, key.view(np.int64), -1)


def window_of(n_words: int, least: int) -> int:
    """Words of the windows that look for a text of n_words, so that it lies whole in one of them."""
    return max(least, 1 << (2 * min(n_words, PASSAGE) - 1).bit_length())


class Postings:
    """Postings of indexed texts, with the largest weights of each term over all and over each block.

    texts: item, and weights by term, of each. Arrays by term: the texts (items, weights) from first to first of the next term, and the blocks
    that hold it (blocks, tops, and at, where the block's texts begin). So memory follows the number of distinct terms of each text.
    """

    def __init__(self, texts: list[tuple[int, dict[int, float]]], n_terms: int):
        self.whole = np.array([k for k, _ in texts], np.int64)  # the item that an indexed text is from
        t = np.array([t for _, own in texts for t in own], np.int64)
        self.items = np.repeat(np.arange(len(texts)), [len(own) for _, own in texts])
        self.weights = np.array([x for _, own in texts for x in own.values()])
        order = np.lexsort((self.items, t))
        t, self.items, self.weights = t[order], self.items[order], self.weights[order]
        self.first = np.searchsorted(t, np.arange(n_terms + 1))
        block = self.items // BLOCK
        self.at = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (block[1:] != block[:-1])]) if len(t) else np.empty(0, np.int64)
        self.blocks, self.tops = block[self.at], np.maximum.reduceat(self.weights, self.at) if len(t) else np.empty(0)
        self.first_block = np.searchsorted(t[self.at], np.arange(n_terms + 1))
        self.end = np.r_[self.at[1:], len(t)]
        self.most = np.zeros(n_terms)
        np.maximum.at(self.most, t, self.weights)
        self.n_blocks = int(self.items.max()) // BLOCK + 1 if len(t) else 0
        self.keys = t[self.at] * self.n_blocks + self.blocks  # in order

    def block_at(self, terms: np.ndarray, block: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the block arrays of (term, block), and which of them there are."""
        wanted = terms * self.n_blocks + block
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return at, self.keys[at] == wanted

    def wand(self, terms: np.ndarray, blocks: list[int], threshold: float) -> list[tuple[int, float]]:
        """(indexed text, score) of all in the blocks with at least the threshold."""
        found = []
        for b in blocks:
            at, there = self.block_at(terms, b)
            at = at[there]
            end = (b + 1) * BLOCK
            lists = []
            for p in at:
                ids, xs = self.items[self.at[p] : self.end[p]].tolist(), self.weights[self.at[p] : self.end[p]].tolist()
                lists.append([ids[0], 0, ids, xs, float(self.tops[p])])
            while lists:
                lists.sort(key=lambda x: x[0])
                bound, pivot = 0.0, None
                for x in lists:
                    bound += x[4]
                    if bound >= threshold - 1e-6:
                        pivot = x[0]
                        break
                if pivot is None:
                    break
                if lists[0][0] == pivot:
                    score = sum(x[3][x[1]] for x in lists if x[0] == pivot)
                    if score >= threshold:
                        found.append((pivot, score))
                    moved, upto = [x for x in lists if x[0] == pivot], pivot + 1
                else:
                    moved, upto = [x for x in lists if x[0] < pivot], pivot
                for x in moved:
                    while x[1] < len(x[2]) and x[2][x[1]] < upto:
                        x[1] += 1
                    x[0] = x[2][x[1]] if x[1] < len(x[2]) else end
                lists = [x for x in lists if x[0] < end]
        return found

    def open_blocks(self, first: np.ndarray, term: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """(window, block) whose bounds reach the threshold.

        term: each half's terms, once each; first: where a half's terms begin; window w is made of the halves from lo[w] to hi[w].
        """
        top = np.r_[0.0, np.cumsum(self.most[term])]
        likely = np.flatnonzero(top[first[hi]] - top[first[lo]] >= threshold - 1e-5)
        step = max(1, CELLS // max(1, self.n_blocks))
        for i in range(0, len(likely), step):
            some = likely[i : i + step]
            begin, stop = first[lo[some]], first[hi[some]]
            t = term[ranges(begin, stop - begin)]
            once = np.unique(np.repeat(np.arange(len(some)), stop - begin) * len(self.most) + t)
            own, t = np.divmod(once, len(self.most))
            order = np.lexsort((self.most[t], own))
            own, t = own[order], t[order]
            sums = np.cumsum(self.most[t])
            base = np.r_[0.0, sums][np.searchsorted(own, np.arange(len(some)))]
            opens = sums - base[own] >= threshold * OPEN  # the terms before stay below that together
            rest = np.bincount(own[~opens], self.most[t[~opens]], len(some))
            low, low_first = t[~opens], np.searchsorted(own[~opens], np.arange(len(some) + 1))
            own, t = own[opens], t[opens]
            sizes = self.first_block[t + 1] - self.first_block[t]
            at = ranges(self.first_block[t], sizes)
            cells = np.repeat(own, sizes) * self.n_blocks + self.blocks[at]
            total = np.bincount(cells, self.tops[at], len(some) * self.n_blocks)
            open_ = np.flatnonzero((total > 0) & (total >= np.repeat(threshold - 1e-5 - rest, self.n_blocks)))
            window, block = np.divmod(open_, self.n_blocks)
            begin, sizes = low_first[window], low_first[window + 1] - low_first[window]
            of = np.repeat(np.arange(len(open_)), sizes)
            at, there = self.block_at(low[ranges(begin, sizes)], block[of])  # what the other terms add in these blocks
            total = total[open_] + np.bincount(of[there], self.tops[at[there]], len(open_))
            stay = total >= threshold - 1e-5
            yield from zip(some[window[stay]].tolist(), block[stay].tolist())

class Index:
    """A group of items (id, text) with the postings of each window size."""

    def __init__(self, items: list[tuple[object, bytes]], df: dict[bytes, int], n_items: int, mean_words: float, overlap: float, shingle: int = 3, window: int = 64):
        self.overlap, self.shingle = overlap, shingle
        wholes = [(item_id, w) for item_id, text in items if (w := words_of(text))]
        self.ids, self.lengths = [i for i, _ in wholes], np.array([len(w) for _, w in wholes], np.int64)
        # texts that share common words lie in the same blocks, which keeps block maxima low
        texts = sorted((sorted(set(w), key=lambda t: (-df[t], t))[:8], k, w) for k, (_, all_) in enumerate(wholes) for w in passages(all_))
        self.vocab: dict[bytes, int] = {}
        by_window: dict[int, list[tuple[int, dict[int, float]]]] = {}
        for _, k, w in texts:
            norm = K1 * (1 - B + B * len(w) / mean_words)
            own = {self.vocab.setdefault(t, len(self.vocab) + 1): math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in Counter(w).items()}
            total = sum(own.values())
            by_window.setdefault(window_of(len(w), window), []).append((k, {t: x / total for t, x in own.items()}))
        if len(self.vocab) >= 1 << 21:
            raise ValueError("too many terms in one group of items: lower group_bytes")
        self.postings = {size: Postings(own, len(self.vocab) + 1) for size, own in sorted(by_window.items())}
        self.parts = []
        for _, w in wholes:
            cut, own = max(1, round(len(w) * 2 / 3)), self.numbers(w)
            self.parts.append(tuple((k := min(shingle, len(p)), np.unique(shingle_keys(p, k))) for p in (own[:cut], own[cut:])))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))

    def search(self, texts: list[bytes], threshold: float) -> Iterator[tuple[int, int, tuple[float, float, float]]]:
        """(text, item, (score, question overlap, answer overlap)) of verified leaks, the best of all windows, by places of texts and items."""
        if not self.ids:
            return
        n_words = 0
        some: list[tuple[int, np.ndarray]] = []
        for at, text in enumerate(texts):
            words = words_of(text)
            if words:
                some.append((at, self.numbers(words)))
                n_words += len(words)
            if n_words >= AT_ONCE:
                yield from self._search(some, threshold)
                some, n_words = [], 0
        yield from self._search(some, threshold)

    def _search(self, some: list[tuple[int, np.ndarray]], threshold: float) -> Iterator[tuple[int, int, tuple[float, float, float]]]:
        if not some:
            return
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        shingles: dict[tuple[int, int], np.ndarray] = {}
        for window, postings in self.postings.items():
            self._by_window(some, threshold, max(1, window // 2), postings, out, shingles)
        for (d, item), found in out.items():
            yield some[d][0], item, found

    def _by_window(self, some: list[tuple[int, np.ndarray]], threshold: float, step: int, postings: Postings, out: dict[tuple[int, int], tuple[float, float, float]], shingles: dict[tuple[int, int], np.ndarray]) -> None:
        """Put the best of each text and item into out; windows of two steps begin at each step."""
        sizes = np.array([len(t) for _, t in some])
        halves = -(-sizes // step)
        offset = np.r_[0, np.cumsum(halves)]
        terms = np.concatenate([t for _, t in some])
        half = np.repeat(offset[:-1], sizes) + ranges(np.zeros(len(some), np.int64), sizes) // step
        known = postings.most[terms] > 0
        half, term = np.divmod(np.unique((half * len(postings.most) + terms)[known]), len(postings.most))
        first = np.searchsorted(half, np.arange(offset[-1] + 1))
        n_windows = np.maximum(1, halves - 1)
        of = np.repeat(np.arange(len(some)), n_windows)
        lo = ranges(offset[:-1], n_windows)
        hi = np.minimum(lo + 2, offset[of + 1])
        opened: dict[int, list[int]] = {}
        for w, b in postings.open_blocks(first, term, lo, hi, threshold):
            opened.setdefault(w, []).append(b)
        for w, blocks in opened.items():
            own = np.unique(term[first[lo[w]] : first[hi[w]]])
            best: dict[int, float] = {}  # of an item and its passages
            for i, score in postings.wand(own, blocks, threshold):
                item = int(postings.whole[i])
                best[item] = max(score, best.get(item, 0.0))
            d = int(of[w])
            n, s = int(sizes[d]), int(lo[w] - offset[d]) * step
            e = min(n, s + 2 * step)
            for item, score in best.items():
                if out.get((d, item), (0.0,)) >= (score, 1.0, 1.0):
                    continue
                left, right = max(0, s - self.lengths[item]), min(n, e + self.lengths[item])
                shares = []
                for k, part in self.parts[item]:
                    if (d, k) not in shingles:
                        shingles[d, k] = shingle_keys(some[d][1], k)
                    near = shingles[d, k][left : max(left, right - k + 1)]
                    shares.append(float(np.isin(part, near).mean()) if len(part) else 1.0)
                found = (float(score), *shares)
                if min(shares) >= self.overlap and found > out.get((d, item), (0.0,)):
                    out[d, item] = found


#: The index of the latest group in this worker, by a name of its own.
_INDEXES: dict[str, Index] = {}


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, int, float]:
    """The distinct items (item_id, text), the terms' document frequencies, the number of items with words, and their mean number of words."""
    text = F.coalesce("text", F.lit(""))
    items = stash(benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).distinct(), "items")
    plain = F.translate("text", UPPER + DIVIDERS, LOWER + " " * len(DIVIDERS))
    words = items.select("item_id", "text", F.array_remove(F.split(plain, " "), "").alias("w")).where(F.size("w") > 0)
    df = stash(words.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").count(), "frequencies")
    n_items, mean = words.agg(F.count(F.lit(1)), F.avg(F.size("w"))).first()
    return items, df, n_items, float(mean or 1.0)


def _search(rows: DataFrame, benchmark: DataFrame, threshold: float, overlap: float, window: int, group_bytes: int) -> DataFrame:
    """The columns of rows but the last, text, with item_id, score, question_overlap and answer_overlap of each leak."""
    spark = rows.sparkSession
    bound_batches(spark)
    items, df, n_items, mean = _items(benchmark)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(size / group_bytes))
    head = rows.schema.fields[:-1]
    names = [*(f.name for f in head), "item_id", "score", "question_overlap", "answer_overlap"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in head), "item_id long, score double, question_overlap double, answer_overlap double"])
    found = None
    for k in range(groups):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == k)
        part = sorted(((r["item_id"], r["text"].encode()) for r in own.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        terms = {t for _, text in part for t in words_of(text)}
        wanted = spark.createDataFrame([(t.decode(),) for t in sorted(terms)], "t string")
        shared = spark.sparkContext.broadcast((part, {r["t"].encode(): r["count"] for r in df.join(wanted, "t", "left_semi").collect()} if groups > 1 else {r["t"].encode(): r["count"] for r in df.collect()}))

        def search(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _INDEXES.get(name)
            if index is None:
                _INDEXES.clear()
                index = _INDEXES[name] = Index(*shared.value, n_items, mean, overlap, window=window)
            for batch in batches:
                at, out = [], []
                for i, item, x in index.search(utf8(batch.column(batch.num_columns - 1)), threshold):
                    at.append(i)
                    out.append((index.ids[item], *x))
                if out:
                    kinds = [pa.int64()] + [pa.float64()] * 3
                    kept = batch.select(range(batch.num_columns - 1)).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names)

        here = rows.mapInArrow(search, schema)
        if groups > 1:  # one group's index at a time
            here = stash(here, "leaks")
            shared.destroy()
        found = here if found is None else found.unionAll(here)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5, window: int = 64, group_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every document and item that it leaks.

    window: the least words of a window; each item of up to `PASSAGE` words and each passage of a longer one lies whole in one of its own size. Ids are whole numbers.
    """
    return _search(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, threshold, overlap, window, group_bytes)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5, window: int = 64, group_bytes: int = 16_000_000) -> DataFrame:
    """docs without the rows that leak an item; rows are judged one by one, with or without a doc_id, by their own text."""
    first, second = row_hash("doc_id", "text")
    found = _search(docs.select(first.alias("k1"), second.alias("k2"), "text"), benchmark, threshold, overlap, window, group_bytes)
    k1, k2, j1, j2 = fresh(docs.columns, "_k1", "_k2", "_j1", "_j2")
    gone = stash(found.select(F.col("k1").alias(j1), F.col("k2").alias(j2)).distinct(), "leaks")
    kept = docs.withColumns({k1: first, k2: second}).join(small_side(gone), [F.col(k1) == F.col(j1), F.col(k2) == F.col(j2)], "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
