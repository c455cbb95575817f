"""Target-distribution importance resampling by external sort-count.

The features of a text are its runs of 1 to `n` consecutive words; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo the number
of buckets. One pass over the texts writes each batch's buckets as one packed stream of unsigned 16-bit integers with the offset where each
document begins, in the shared folder. Sorting a stream and encoding its runs gives counts by bucket, which Spark sums over all streams. The gain of a
bucket compares its share of the target texts with its share of all documents. A second pass over the streams gathers gains by bucket and
adds them up between offsets (np.add.reduceat); no text is read or cut into words again.

    gain    floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))
    weight  floor of the mean gain of a document's features, 0 without features
    score   weight + floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 8 hex digits of sha256("<seed>:<doc_id>")

Documents of at least `least_words` words are drawn by score, the highest first, ties by doc_id: Gumbel noise makes this a sample without
replacement whose probabilities follow the weights. Scores lie between bounds that don't depend on the number of documents, so counts by
score find the last one that is drawn, and only documents from there on are sorted, over all partitions; a row's rank is its place in its
partition after the rows of those before it.

Ids are whole numbers.

Cases: a null or empty text has no words and is never drawn; a very long text is one run in its stream; a null doc_id is hashed as an empty
one and comes last among equals; repeated rows each count, each may be drawn, and of rows equal in score and id which comes first is left
open; without target texts all gains compare with an even spread; an empty table gives no row; further columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import bound_batches, forget, stash, utf8

#: Every byte but digits, letters and those of characters beyond ASCII divides words; A-Z becomes a-z.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of buckets after which a stream ends.
STREAM = 4 << 20
#: Words whose CRC a worker remembers, and the longest of them.
KNOWN, LONGEST = 200_000, 64
STREAMS = "ids binary, nulls binary, words binary, offsets binary, stream binary"
SCORED = "doc_id long, n_features long, weight long, score long, drawable boolean"


class Buckets:
    """The buckets of a text's features."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets, self.known = n, buckets, {}

    def of(self, text: bytes) -> tuple[int, np.ndarray]:
        words = text.translate(TO_WORDS).split()
        found = [np.fromiter(map(self.bucket, words), np.uint16, len(words))]
        for n in range(2, self.n + 1):
            runs = (b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
            found.append(np.fromiter((zlib.crc32(x) % self.buckets for x in runs), np.uint16, max(0, len(words) - n + 1)))
        return len(words), np.concatenate(found)

    def bucket(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            found = zlib.crc32(word) % self.buckets
            if len(word) <= LONGEST:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[word] = found
        return found


def streams(texts: DataFrame, doc_id: str | None, text: str, n: int, buckets: int) -> DataFrame:
    """Packed bucket streams with the ids, words and offsets of their documents; a stream ends after `STREAM` bytes."""
    if not 1 <= buckets <= 65536:
        raise ValueError("buckets are unsigned 16-bit integers")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, schema = Buckets(n, buckets), pa.schema([(x, pa.binary()) for x in ("ids", "nulls", "words", "offsets", "stream")])
        for batch in batches:
            rows, size = [], 0
            for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                rows.append((i, *of.of(t)))
                size += rows[-1][2].nbytes
                if size >= STREAM:
                    yield stream(rows, schema)
                    rows, size = [], 0
            if rows:
                yield stream(rows, schema)

    def stream(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        ids = np.array([i or 0 for i, _, _ in rows], "<i8")
        nulls = np.array([i is None for i, _, _ in rows], np.uint8)
        words = np.array([w for _, w, _ in rows], "<i8")
        offsets = np.cumsum([0, *(len(x) for _, _, x in rows)]).astype("<i8")
        packed = np.concatenate([x for _, _, x in rows]).astype("<u2")
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, nulls, words, offsets, packed)], schema=schema)

    key = F.lit(None).cast("long") if doc_id is None else F.col(doc_id).cast("long")
    return texts.select(key.alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(pack, STREAMS)


def sort_count(streamed: DataFrame) -> DataFrame:
    """bucket and n, from runs of the sorted streams."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                ordered = np.sort(np.frombuffer(data.as_buffer(), "<u2"))
                starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
                yield pa.RecordBatch.from_arrays([pa.array(ordered[starts].astype(np.int32)), pa.array(np.diff(np.r_[starts, len(ordered)]).astype(np.int64))], ["bucket", "n"])

    return streamed.select("stream").mapInArrow(runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def counted(streamed: DataFrame, buckets: int) -> list[int]:
    """Counts by bucket on the driver, as many as there are buckets."""
    out = [0] * buckets
    for b, n in sort_count(streamed).collect():
        out[b] = n
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """Whole thousandths by bucket."""
    buckets, all_s, all_t = len(source), sum(source), sum(target)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets)))) for s, t in zip(source, target)], np.int64)


def weights(gain: np.ndarray, stream: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The floored mean gain between each two offsets."""
    n = np.diff(offsets)
    some = n > 0
    out = np.zeros(len(n), np.int64)
    if some.any():  # reduceat takes an empty run for its next element, so empty runs stay out
        out[some] = np.add.reduceat(gain[stream], offsets[:-1][some]) // n[some]
    return out


def noise(seed: str, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(streamed: DataFrame, gain: np.ndarray, seed: str, least_words: int) -> DataFrame:
    shared = streamed.sparkSession.sparkContext.broadcast(gain)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                ids, nulls, words, offsets, stream = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, ("<i8", "u1", "<i8", "<i8", "<u2")))
                weight = weights(shared.value, stream, offsets)
                doc_ids = [None if null else i for i, null in zip(ids.tolist(), nulls)]
                score = weight + np.array([noise(seed, i) for i in doc_ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *map(pa.array, (np.diff(offsets), weight, score, words >= least_words))], ["doc_id", "n_features", "weight", "score", "drawable"])

    return streamed.mapInArrow(gather, SCORED)


def ranked(table: DataFrame, percent: int) -> DataFrame:
    """The rows of `scored`, a written table, with rank: 1, 2, ... for the drawn ones, else null."""
    spark = table.sparkSession
    by_score = table.where("drawable").groupBy("score").count().orderBy(F.desc("score")).collect()  # bounded: scores have bounds
    wanted = percent * sum(n for _, n in by_score) // 100
    last, seen = None, 0
    for score, n in by_score:
        if seen >= wanted:
            break
        last, seen = score, seen + n
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return table.select(*columns, F.lit(None).cast("long").alias("rank"))
    may = F.col("drawable") & (F.col("score") >= last)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("tie")]
    tops = table.where(may).withColumn("tie", F.monotonically_increasing_id()).orderBy(*order)  # tie spreads equal rows over the partitions
    tops = stash(tops.select(*columns, F.monotonically_increasing_id().alias("place")), "drawn")
    part = F.shiftright("place", 33)
    offsets, upto = [], 0
    for p, n in tops.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        offsets.append((p, upto))
        upto += n
    offset = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    tops = tops.withColumn("part", part).join(offset, "part").select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    rest = table.where(~may).select(*columns, F.lit(None).cast("long").alias("rank"))
    return tops.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 2, buckets: int = 10_000, seed: str = "2024", least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, by the texts of `target`."""
    bound_batches(docs.sparkSession)
    of_docs = stash(streams(docs, doc_id, text, n, buckets), "streams")
    of_target = stash(streams(target, None, text, n, buckets), "target-streams")
    gain = gains(counted(of_docs, buckets), counted(of_target, buckets))
    table = stash(scored(of_docs, gain, seed, least_words), "scored")
    forget(docs.sparkSession, of_docs, of_target)
    return ranked(table, percent)
