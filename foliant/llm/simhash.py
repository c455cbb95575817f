"""Near duplicates by SimHash, linked by self-joins of binary tries.

Fingerprints within 4 of 64 bits agree in full on k - 4 of k blocks of bits. So each distinct fingerprint goes into one
trie for each choice of k - 4 blocks, with those blocks on top: there the traversal allows no difference, which makes each
value of them a subtree of its own and spreads the subtrees over tasks. k is 5 (five tries, 12 bits or more on top) and rises to
6 (15 tries, 20 bits), 7 (35, 27) and 8 (70, 32) when subtrees of evenly spread fingerprints would hold more than `most`.
Within a subtree, node pairs are followed downwards together, their differing bits are added up, and a pair is dropped when it
has more than 4.

Each task returns a star (fingerprint, least fingerprint) for every component it finds, never its pairs. Subtrees with
more than `most` fingerprints all the same are dealt out in pairs of parts, so no task holds more than two parts. The stars
of all tasks are joined into components by rounds of large-star and small-star joins.

Cases: null, empty and wordless texts have fingerprint zero and are linked like any other; a very long text is hashed in pieces;
rows of one doc_id each get a row, judged by their own text; a null doc_id takes part, and its component_id is that of the least
doc_id of its component (null if there is none); an empty table gives no row; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import bound_batches, forget, fresh, row_hash, small_side, stash, utf8

U1 = np.uint64(1)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of the word shingles of UTF-8 text, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 50_000):
        part = words[at : at + 50_000 + shingle - 1]
        if len(part) < shingle:
            hashes = [h(b" ".join(part), seed)]
        else:
            hashes = [h(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(shingle)))]
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, k1 and k2 (which tell rows apart by doc_id and text) and fp, the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle, seed) for t in utf8(batch.column(3))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp.view(np.int64))], ["doc_id", "k1", "k2", "fp"])

    k1, k2 = row_hash(F.col("doc_id").cast("long"), "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), "text").mapInArrow(of, "doc_id long, k1 long, k2 long, fp long")


@cache
def tries(k: int) -> tuple[tuple[int, tuple[tuple[int, int], ...]], ...]:
    """For each choice of k - 4 of k blocks: the bits of these, and all blocks (start from the top bit, width), these first."""
    edges = [64 * i // k for i in range(k + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]
    out = []
    for top in combinations(range(k), k - 4):
        order = [blocks[i] for i in top] + [blocks[i] for i in range(k) if i not in top]
        out.append((sum(blocks[i][1] for i in top), tuple(order)))
    return tuple(out)


def blocks_for(n: int, most: int) -> int:
    return next((k for k in (5, 6, 7) if n >> min(top for top, _ in tries(k)) < most), 8)


def arranged(fp: np.ndarray, order: tuple[tuple[int, int], ...]) -> np.ndarray:
    """The fingerprints' bits with the blocks in this order."""
    out, at = np.zeros_like(fp), 64
    for start, width in order:
        at -= width
        out |= ((fp >> np.uint64(64 - start - width)) & np.uint64((1 << width) - 1)) << np.uint64(at)
    return out


def restored(fp: np.ndarray, order: tuple[tuple[int, int], ...]) -> np.ndarray:
    out, at = np.zeros_like(fp), 64
    for start, width in order:
        at -= width
        out |= ((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)) << np.uint64(64 - start - width)
    return out


class Forest:
    """Least member of each component among n nodes, for pairs that come in parts."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            if not len(a):
                break
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def trie_links(group: np.ndarray, bits: np.ndarray, fixed: int, budget: int, forest: Forest, at_once: int = 1_000_000) -> None:
    """Link all fingerprints of the same group within `budget` bits.

    group, bits: sorted by both; bits without repeats within a group, equal there in the top `fixed` bits. A node is a range of
    rows with a common prefix; a pair of nodes is (lo, hi, lo, hi, differing bits so far), all pairs at one depth.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    big = ends - starts > 1
    starts, ends = starts[big], ends[big]
    stack = [(fixed, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    ones_at: dict[int, np.ndarray] = {}
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > at_once:
            half = len(a0) // 2
            stack += [(depth, *(x[half:] for x in (a0, a1, b0, b1, err))), (depth, *(x[:half] for x in (a0, a1, b0, b1, err)))]
            continue
        few = (a1 - a0) * (b1 - b0) <= 64
        if depth >= 64:
            few[:] = True
        if few.any():
            compare(bits, a0[few], a1[few], b0[few], b1[few], budget, forest, at_once)
        a0, a1, b0, b1, err = (x[~few] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        if depth not in ones_at:
            ones_at[depth] = np.r_[0, np.cumsum((bits >> np.uint64(63 - depth)) & U1, dtype=np.int64)]
        ones = ones_at[depth]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, err, None), (am, a1, bm, b1, err, None), (a0, am, bm, b1, err + 1, None), (am, a1, b0, bm, err + 1, ~same)]
        kept = []
        for p0, p1, q0, q1, e, also in parts:
            keep = (p0 < p1) & (q0 < q1) & (e <= budget)
            if also is not None:
                keep &= also
            kept.append([x[keep] for x in (p0, p1, q0, q1, e)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*kept))))


def compare(bits, a0, a1, b0, b1, budget: int, forest: Forest, at_once: int) -> None:
    """All fingerprints under each node pair, one by one."""
    width, total = b1 - b0, (a1 - a0) * (b1 - b0)
    ends = np.cumsum(total)
    at = 0
    while at < len(total):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
        n = total[at:upto]
        which = np.repeat(np.arange(at, upto), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i, j = a0[which] + k // width[which], b0[which] + k % width[which]
        near = (i != j) & (np.bitwise_count(bits[i] ^ bits[j]) <= budget)
        forest.link(i[near], j[near])
        at = upto


def star_links(trie: np.ndarray, key: np.ndarray, fp: np.ndarray, k: int, budget: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) of all that are linked, over the subtrees (trie, key) of one task."""
    out = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for t, (top, blocks) in enumerate(tries(k)):
        own = trie == t
        if not own.any():
            continue
        group, x = key[own], arranged(fp[own], blocks)
        order = np.lexsort((x, group))
        group, x = group[order], x[order]
        forest = Forest(len(x))
        trie_links(group, x, top, budget, forest)
        moved = np.flatnonzero(forest.root != np.arange(len(x)))
        back = restored(x, blocks)
        out[0].append(back[moved])
        out[1].append(back[forest.root[moved]])
    return np.concatenate(out[0]), np.concatenate(out[1])


def links(distinct: DataFrame, budget: int = 4, most: int = 20_000, blocks: int | None = None) -> DataFrame:
    """Stars (a, b) over the column fp of distinct, whose components are those of all pairs within budget."""
    if budget > 4:
        raise ValueError("these tries find pairs within 4 bits")
    k = blocks or blocks_for(distinct.count(), most)

    def top_bits(trie: int):
        top, order = tries(k)[trie]
        out, left = F.lit(0).cast("long"), top
        for start, width in order[: k - 4]:
            left -= width
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 64 - start - width).bitwiseAND(F.lit((1 << width) - 1)), left))
        return out

    keyed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("block"), top_bits(t).alias("key")) for t in range(len(tries(k)))))).alias("k")).select("fp", "k.*")
    counted = keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    parted = stash(counted.select("block", "key", F.ceil(F.col("n") / most).alias("parts")), "subtrees")
    dealt = keyed.join(small_side(parted), ["block", "key"])
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts"))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.col("own")))))
    dealt = dealt.select("fp", "block", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def stars() -> pa.RecordBatch:
            fp, block, key = (np.concatenate(x) for x in zip(*held))
            a, b = star_links(block, key, fp.view(np.uint64), k, budget)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        n, last = 0, None
        for batch in batches:  # sorted by subtree: what is whole goes on when enough has come
            fp, block, sub = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(fp):
                continue
            if n >= 100_000 and sub[0] != last or n >= 100_000 and sub[-1] != last:
                cut = int(np.argmax(sub != last))
                held.append([fp[:cut], block[:cut], sub[:cut]])
                yield stars()
                held, n = [[fp[cut:], block[cut:], sub[cut:]]], len(fp) - cut
            else:
                held.append([fp, block, sub])
                n += len(fp)
            last = sub[-1]
        if held:
            yield stars()

    sub = F.xxhash64("block", "key", "i", "j")  # two subtrees under one hash only meet in more comparisons
    return dealt.select("fp", "block", sub.alias("sub")).repartition("sub").sortWithinPartitions("sub").mapInArrow(join, "a long, b long")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(v, root): the least vertex of each vertex's component, for every vertex of edges (a, b) but the roots.

    A round is a large-star and a small-star join; it ends when a round changes nothing. Both sides of each join are written
    tables, so that a vertex with very many edges can be split.
    """
    spark = edges.sparkSession
    edges = stash(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        nearest = stash(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), "nearest")
        large = stash(both.where("u > v").join(small_side(nearest), "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), "large")
        least = stash(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(small_side(least), "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v > u")
        last, edges = edges, stash(small.unionAll(least.select("v", F.col("m").alias("u"))).distinct(), "edges")
        forget(spark, last, nearest, large, least)
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return edges.select("v", F.col("u").alias("root"))


def _named(docs: DataFrame, shingle: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """fingerprints of all rows, and for each fp its component: fp, component_id and k1, k2 of the row that stands for it."""
    fps = stash(fingerprints(docs, shingle), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    distinct = stash(fps.groupBy("fp").agg(F.min(place).alias("first")), "distinct")
    roots = stash(components(links(distinct, budget)), "roots")
    linked = roots.unionAll(roots.select("root", "root").distinct())
    members = stash(linked.join(distinct, linked["v"] == distinct["fp"]).select("fp", "root", "first"), "members")
    firsts = stash(members.groupBy("root").agg(F.min("first").alias("least")), "firsts")
    moved = stash(members.select("fp", "root").join(small_side(firsts), "root").select(F.col("fp").alias("_fp"), "least"), "moved")
    named = distinct.join(small_side(moved), distinct["fp"] == moved["_fp"], "left").select("fp", F.coalesce("least", "first").alias("c"))
    return fps, stash(named.select("fp", F.col("c.doc_id").alias("component_id"), F.col("c.k1").alias("c1"), F.col("c.k2").alias("c2")), "components")


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach, of every row."""
    fps, named = _named(docs, shingle, budget)
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, null last, and of these by a hash of the text.

    Rows are judged one by one, also those without a doc_id and those of one doc_id with different texts. Of rows equal in
    doc_id and text one stays, the first by its columns as JSON.
    """
    fps, named = _named(docs, shingle, budget)
    judged = fps.join(named, "fp").select("k1", "k2", (F.col("k1").eqNullSafe(F.col("c1")) & F.col("k2").eqNullSafe(F.col("c2"))).alias("stays"))
    rows = stash(judged.groupBy("k1", "k2", "stays").count(), "judged")
    k1, k2, j1, j2, packed = fresh(docs.columns, "_k1", "_k2", "_j1", "_j2", "_row")
    first, second = row_hash(F.col("doc_id").cast("long"), "text")

    def keys(condition: str) -> DataFrame:
        return small_side(stash(rows.where(condition).select(F.col("k1").alias(j1), F.col("k2").alias(j2)), "gone"))

    keyed = docs.withColumns({k1: first, k2: second})
    here = lambda: [F.col(k1) == F.col(j1), F.col(k2) == F.col(j2)]
    kept = keyed.join(keys("not stays"), here(), "left_anti")
    if rows.where("stays and count > 1").isEmpty():
        return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
    again = keys("stays and count > 1")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = kept.join(again, here(), "left_semi").groupBy(k1, k2).agg(F.min_by(whole, F.to_json(whole)).alias(packed)).select(f"{packed}.*")
    return kept.join(again, here(), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(once)
