"""Hard negatives by bit-sliced integer products.

Vectors become integers, floor(scale * x). A candidate's integers, shifted to start at zero, are kept as bit-planes: u = sum of
2^b * plane b. An anchor's product with the planes from the most significant down to b leaves a rest of between (2^b - 1) times the
sum of its negative components and (2^b - 1) times that of its positive ones. So each plane halves the interval that holds the score,
and a candidate goes as soon as its interval can't reach the places that are still open: the running last of the first k, or the
bounds that the anchor sets. Intervals are exact integers, so no candidate is lost.

Candidates lie in a written table of blocks of up to `BLOCK` rows. Anchors are a stated set of queries against all of them: they go out
in groups of at most `group_bytes`, one pass over the blocks each for the positives and for the negatives. A task keeps
the first k of each anchor, so what leaves it doesn't grow with its rows.

Cases: a row with a null id, label or vector, or with a null or non-finite component takes no part; an anchor without another row of its
label gives no row, and a positive without a negative within the bounds neither; a positive score below zero has no negatives, as the bounds
are then empty; equal scores go by the smaller id; each of repeated rows counts, and rows of the anchor's own id are not among its others;
the shorter of two vectors counts as filled up with zeros; scores have to fit in a long, else an error says so; an empty table gives no row;
further columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm._common import bound_batches, stash

BLOCK, STEP = 1024, 512
#: Pairs that are still open, as a share of a block's, below which they are taken one by one.
SPARSE = 0.1
PAIRS = 65536
LEAST, MOST = -(2**63), 2**63 - 1

BLOCKS = "n int, dims int, n_planes int, ids binary, labels binary, planes binary"
FOUND = "anchor int, slot int, anchor_id long, score long, id long"


def integers(table: DataFrame, vec_id: str | Column, label: str | Column, vector: str | Column, scale: float) -> DataFrame:
    """id, label and q, the rows that take part with their integers."""
    named = table.select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in (("id", vec_id), ("label", label), ("vector", vector))))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole.alias("q"))


def matrix(lists: pa.Array) -> np.ndarray:
    """A list column as rows of int64, shorter ones filled up with zeros."""
    lens = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lens), int(lens.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lens[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def slice_bits(q: np.ndarray) -> tuple[int, bytes]:
    """The number of planes of q + 2^(planes - 1), and the planes, the most significant first, each row in whole bytes."""
    most = max(int(q.max(initial=0)), -1 - int(q.min(initial=0)))
    n = most.bit_length() + 1
    if n > 62:
        raise ValueError("components beyond 61 bits: scores wouldn't fit in a long")
    u = q + (1 << (n - 1))
    return n, b"".join(np.packbits((u >> b & 1).astype(np.uint8), axis=1).tobytes() for b in range(n - 1, -1, -1))


def to_blocks(rows: DataFrame) -> DataFrame:
    """The rows of `integers` as blocks of bit-planes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n", pa.int32()), ("dims", pa.int32()), ("n_planes", pa.int32()), *((n, pa.binary()) for n in ("ids", "labels", "planes"))])
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                q = matrix(part.column(2))
                n, planes = slice_bits(q)
                ids, labels = (part.column(i).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((len(q), q.shape[1], n, ids, labels, planes), schema.types)], schema=schema)

    return rows.mapInArrow(pack, BLOCKS)


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    planes: np.ndarray  # (planes, rows, dims) of 0 and 1, the most significant first

    @classmethod
    def read(cls, n: int, dims: int, n_planes: int, ids: bytes, labels: bytes, planes: bytes) -> Block:
        bits = np.frombuffer(planes, np.uint8).reshape(n_planes, n, -(-dims // 8))
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.unpackbits(bits, axis=2, count=dims) if dims else np.zeros((n_planes, n, 0), np.uint8))


@dataclass
class Anchors:
    """Anchors with `slots` places each; a slot takes scores from low to high."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    low: np.ndarray  # (anchors, slots)
    high: np.ndarray

    def part(self, at: slice) -> Anchors:
        return Anchors(self.ids[at], self.labels[at], self.q[at], self.low[at], self.high[at])


class First:
    """The first k of each slot of some anchors: by score, the highest first, then by id."""

    def __init__(self, anchors: Anchors, same: bool, k: int):
        self.of, self.same, self.k = anchors, same, k
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = anchors.low.copy()  # a score below can't come in any more

    def add(self, block: Block) -> None:
        a, r, score = self.qualify(block)
        n_slots = self.of.low.shape[1]
        new = []
        for slot in range(n_slots):
            fits = (score >= self.least[a, slot]) & (score <= self.of.high[a, slot])
            new.append((a[fits] * n_slots + slot, score[fits], block.ids[r[fits]]))
        key, score, ids = (np.concatenate([old, *x]) for old, x in zip((self.key, self.score, self.id), zip(*new)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        place = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        keep = place < self.k
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]
        full = place == self.k - 1
        np.maximum.at(self.least.reshape(-1), key[full], score[full])

    def qualify(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and exact score of the pairs that may come in."""
        q = self.of.q
        dims = max(q.shape[1], block.planes.shape[2])
        if q.shape[1] < dims:
            q = np.pad(q, ((0, 0), (0, dims - q.shape[1])))
        planes = np.pad(block.planes, ((0, 0), (0, 0), (0, dims - block.planes.shape[2]))) if block.planes.shape[2] < dims else block.planes
        n = len(planes)
        shift = 1 << (n - 1)
        if block.planes.shape[2] < dims:  # what is filled up is zero, thus 2^(n-1) after the shift
            planes[0, :, block.planes.shape[2] :] = 1
        top = int(np.abs(q).max(initial=0))
        if dims * top * 2 * shift >= 2**62:
            raise ValueError("scores don't fit in a long")
        kind = np.float32 if dims * top < 2**24 else np.float64
        if dims * top >= 2**53:
            kind = np.int64
        factor = q.astype(kind)
        plus, minus = np.where(q > 0, q, 0).sum(1), np.where(q < 0, q, 0).sum(1)
        least, most = self.least.min(1), self.of.high.max(1)
        alive = (self.of.labels[:, None] == block.labels) == self.same
        alive &= self.of.ids[:, None] != block.ids
        known = np.repeat((-shift * q.sum(1))[:, None], planes.shape[1], axis=1)
        b = n - 1
        while b >= 0:  # whole planes while many pairs are open
            known += (factor @ planes[n - 1 - b].T.astype(kind)).astype(np.int64) << b
            rest = (1 << b) - 1
            alive &= (known + (rest * plus)[:, None] >= least[:, None]) & (known + (rest * minus)[:, None] <= most[:, None])
            b -= 1
            if np.count_nonzero(alive) < SPARSE * alive.size:
                break
        a, r = np.nonzero(alive)
        known = known[a, r]
        while b >= 0 and len(a):  # then pair by pair
            bits = planes[n - 1 - b]
            for at in range(0, len(a), PAIRS):
                x = slice(at, at + PAIRS)
                known[x] += np.einsum("ij,ij->i", factor[a[x]], bits[r[x]].astype(kind)).astype(np.int64) << b
            rest = (1 << b) - 1
            open_ = (known + rest * plus[a] >= least[a]) & (known + rest * minus[a] <= most[a])
            a, r, known = a[open_], r[open_], known[open_]
            b -= 1
        return a, r, known


def search(blocks: DataFrame, anchors: Anchors, same: bool, k: int) -> DataFrame:
    """The first k rows of each slot of the anchors over all blocks; same: of their label, else of others."""
    shared = blocks.sparkSession.sparkContext.broadcast(anchors)
    n_slots = anchors.low.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        parts = [First(of.part(slice(at, at + STEP)), same, k) for at in range(0, len(of.ids), STEP)]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                block = Block.read(*row)
                for part in parts:
                    part.add(block)
        for i, part in enumerate(parts):
            if len(part.key):
                anchor, slot = np.divmod(part.key, n_slots)
                columns = [pa.array(x, t) for x, t in ((anchor + i * STEP, pa.int32()), (slot, pa.int32()), (part.of.ids[anchor], pa.int64()), (part.score, pa.int64()), (part.id, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "slot", "anchor_id", "score", "id"])

    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return blocks.mapInArrow(scan, FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    table: DataFrame, *, vec_id: str | Column, label: str | Column, vector: str | Column, anchor: Column, scale: float = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, group_bytes: int = 16 << 20
) -> DataFrame:
    """For each anchor (a condition on the column `id`) and each of its first `positives` others of the same label: the first
    `negatives` rows of other labels whose score lies within low and high hundredths of the positive's.

    Gives anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = table.sparkSession
    bound_batches(spark, BLOCK)
    rows = stash(integers(table, vec_id, label, vector, scale), "integers")
    blocks = stash(to_blocks(rows), "blocks")
    chosen = rows.where(anchor)
    size = F.size("q").cast("long") * 8 + 16 + 40 * positives
    n_groups = -(-(chosen.agg(F.sum(size)).first()[0] or 0) // group_bytes)
    out = [_of_group(spark, blocks, group, positives, negatives, low, high, n_groups > 1) for group in _groups(chosen, n_groups)]
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    while len(out) > 1:
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2])] + out[len(out) & ~1 :]
    return out[0]


def _groups(chosen: DataFrame, n_groups: int) -> Iterator[pa.Table]:
    """The anchors in groups of about equal size, one at a time; equal rows are spread by their place, not by their key."""
    if n_groups <= 1:
        if n_groups:
            yield chosen.toArrow()
        return
    placed = stash(chosen.withColumn("group", F.monotonically_increasing_id() % n_groups), "anchors")
    for g in range(n_groups):
        yield placed.where(F.col("group") == g).drop("group").toArrow()


def _of_group(spark: SparkSession, blocks: DataFrame, group: pa.Table, positives: int, negatives: int, low: int, high: int, write: bool) -> DataFrame:
    ids, labels = (group.column(i).to_numpy() for i in (0, 1))
    q = matrix(group.column(2).combine_chunks())
    free = lambda x, slots: np.full((len(ids), slots), x, np.int64)
    found = stash(search(blocks, Anchors(ids, labels, q, free(LEAST, 1), free(MOST, 1)), True, positives), "positives")
    near = found.select("anchor", (F.col("rank") - 1).alias("slot"), "score").toArrow()  # up to `positives` rows an anchor of the group
    at = tuple(near.column(i).to_numpy() for i in (0, 1))
    score = near.column(2).to_numpy()
    least, most = free(MOST, positives), free(LEAST, positives)  # nothing fits where there is no positive
    least[at], most[at] = -(-low * score // 100), high * score // 100
    wanted = search(blocks, Anchors(ids, labels, q, least, most), False, negatives)
    named = found.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = wanted.join(named, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return stash(out, "negatives") if write else out
