"""Line dedup by overlapping windows of three lines.

Every three consecutive lines make a window. A window found before, in order of doc_id, the text's hash, the row's number
among equal rows, and line, is a repeat: its lines are covered, covered positions are merged, and covered lines are taken out
of the text. The first occurrence stays whole.

Windows are known by two 64-bit hashes of their lines, the second with another seed. First occurrences are minima by
hash, formed before the shuffle; only windows that occur twice are joined back, so a window that a third of all
documents share costs a join that can be split, and no task sees all its places as a group. The covered lines come to their
texts by a broadcast while they are few (`COVERED` bytes), else texts are shuffled once to meet them.

Cases: lines end at \\n; texts of fewer than three lines and null texts stay as they are (a null text is an empty one); a
very long text has as many windows as lines; a window of three lines without words is none; of rows equal in doc_id and text
one is the first and the others repeat it; rows of one doc_id and different texts come in order of the texts' MD5; a null doc_id
comes first; an empty table gives no row; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import WORD, number_equals, stash

WINDOW = 3
#: Bytes of covered positions and their keys that are sent to every executor.
COVERED = 16_000_000
KEY = ["doc_id", "th", "no"]


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text), th (15 digits of its MD5) and no (its number among equal rows)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return number_equals(rows.withColumn("th", F.conv(F.substring(F.md5("t"), 1, 15), 16, 10).cast("long")), ["doc_id", "th"], "no")


def windows(rows: DataFrame) -> DataFrame:
    """h1, h2 of every window, with doc_id, th, no and pos, its first line from 0. rows: those of `numbered`."""
    lines = rows.select(*KEY, F.split("t", "\n").alias("l")).where(F.size("l") >= WINDOW)
    hashed = lines.withColumn("h", F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), x.rlike(WORD).alias("w"))))
    placed = hashed.select(*KEY, F.explode(F.transform(F.slice(F.sequence(F.lit(0), F.size("h") - WINDOW), 1, F.size("h")), lambda i: F.struct(i.alias("pos"), *(F.get("h", i + k).alias(f"l{k}") for k in range(WINDOW))))).alias("x"))
    parts = [F.col(f"x.l{k}") for k in range(WINDOW)]
    told = parts[0]["w"] | parts[1]["w"] | parts[2]["w"]
    return placed.where(told).select(F.xxhash64(*(p["a"] for p in parts)).alias("h1"), F.xxhash64(*(p["b"] for p in parts)).alias("h2"), *KEY, F.col("x.pos").alias("pos"))


def repeats(rows: DataFrame) -> DataFrame:
    """doc_id, th, no and covered: the merged positions of all lines that lie in a repeated window, in order."""
    every = stash(windows(rows), "windows")
    place = F.struct(*KEY, "pos")
    firsts = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    firsts = stash(firsts.select("h1", "h2", "first"), "firsts")
    later = every.join(firsts, ["h1", "h2"]).where(~F.struct(*KEY, "pos").eqNullSafe(F.col("first")))
    by_doc = later.groupBy(*KEY).agg(F.collect_set("pos").alias("at"))  # at most the windows of one document
    return by_doc.select(*KEY, F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (WINDOW - 1)))))).alias("covered"))


def line_dedup(docs: DataFrame, covered_bytes: int = COVERED) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (comma-joined positions from 0) and text without the removed lines."""
    rows = numbered(docs)
    found = stash(repeats(rows), "repeats")
    size = found.agg(F.sum(F.size("covered") * 4 + 64)).first()[0] or 0
    found = found.select(*(F.col(c).alias(f"_{c}") for c in KEY), "covered")
    here = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    joined = rows.join(F.broadcast(found) if size <= covered_bytes else found, here, "left")
    split = joined.select("doc_id", "t", "covered", F.split("t", "\n").alias("l"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("l") - 1), "covered"), lambda i: F.get("l", i))
    n = F.when(F.col("t") == "", 0).otherwise(F.size("l")).cast("long")
    return split.select(
        "doc_id",
        n.alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("covered").cast("array<string>"), ","), F.lit("")).alias("removed"),
        F.when(F.col("covered").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
