"""Mixing sources to target weights by capped water-filling.

Every source is to get its share of all words by weight, but no more than `epochs` times its own words; what a capped
source can't take goes to the others by weight, until none is above its cap. With sources in order of cap by weight,
the uncapped ones all sit at one level, so the fixed point is found with running sums over the sources alone.

A document is taken floor(rate) times, rate being its source's target by size, and once more if its seeded hash lies
below the source's cut. The hash is of doc_id, text and a number among equal rows, so rows without an id or with the same one
are spread like others. Hashes fall into `bins` bins by source, words are summed by bin before any shuffle, and the cut is
the bin's edge whose running sum is nearest to the words that are still due.

Cases: null and empty texts have size 0, and a document of size 0 is never taken; a very long text is one document like
others, and its source can miss its target by half its words; a null source is a source of its own, the last in order; a source
without words has target 0; of rows equal in doc_id, source and text each gets a number, and which one is taken more often is
left open; a tie between two edges goes to the lower one; an empty table gives no row. Columns of any name are carried where
asked for; in `mix` the result's own names replace them, `mixed` returns the columns of docs as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from foliant.llm._common import fresh, number_equals, row_hash, stash

WEIGHTS = (5.0, 2.0, 1.0)
OWN = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def weighed(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with their weights: in order of code points, null last, the weights repeating."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1))


def water_fill(sources: DataFrame, epochs: float = 3.0) -> DataFrame:
    """sources (source, source_size, weight) with target, which shares the sum of all sizes."""
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    at = sources.withColumn("cap", F.col("source_size") * F.lit(epochs))
    at = at.withColumn("total", F.sum("source_size").over(every))
    at = at.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    capped = at.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    return capped.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def plan(sized: DataFrame, weights: tuple[float, ...], epochs: float, bins: int) -> DataFrame:
    """A row for each source: source_size, target, whole repetitions and cut. sized: source, size, bin."""
    summed = stash(sized.groupBy("source", "bin").agg(F.sum("size").alias("words")), "bins")
    sizes = summed.groupBy("source").agg(F.sum("words").alias("source_size"))
    filled = water_fill(weighed(sizes, weights), epochs).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    filled = filled.withColumn("whole", F.floor(F.col("rate") + 1e-12)).withColumn("due", F.col("target") - F.col("whole") * F.col("source_size"))
    running = summed.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))  # at most `bins` rows a source
    edges = running.select("source", (F.col("bin") + 1).alias("edge"), "upto").unionAll(sizes.select("source", F.lit(0).cast("long"), F.lit(0).cast("long")))
    near = edges.alias("e").join(filled.alias("f"), F.col("e.source").eqNullSafe(F.col("f.source")))
    cut = F.min_by("edge", F.struct(F.abs(F.col("upto") - F.col("due")), "edge"))
    return near.groupBy("f.source").agg(*(F.first(c).alias(c) for c in ("source_size", "target", "whole")), cut.alias("cut"))


def planned(docs: DataFrame, carry: list[str], weights: tuple[float, ...], epochs: float, seed: int, bins: int, few: int) -> tuple[DataFrame, dict[str, str]]:
    """The carried columns with size, source_size, target and copies, under names of their own, and these names.

    The plan of up to `few` sources is sent to the executors as a constant table, that of more is joined with the
    documents in 16 parts for each source.
    """
    cols = [F.col(f"`{c}`") for c in carry]
    source, size, bin_, text_id, k1, k2, number, of, total, target, whole, cut, salt, copies = names = fresh(
        carry, "_source", "_size", "_bin", "_text_id", "_k1", "_k2", "_number", "_of", "_source_size", "_target", "_whole", "_cut", "_salt", "_copies"
    )
    first, second = row_hash("doc_id", "source", "text")
    id_ = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select(*cols, F.col("source").alias(source), word_count(F.col("text")).alias(size), id_.alias(text_id), first.alias(k1), second.alias(k2))
    rows = number_equals(rows, [k1, k2], number)
    digits = F.substring(F.md5(F.concat_ws(":", text_id, number, F.lit(str(seed)))), 1, 7)
    rows = rows.withColumn(bin_, F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(bins))).drop(text_id, k1, k2, number)
    sized = rows.select(F.col(source).alias("source"), F.col(bin_).alias("bin"), F.col(size).alias("size"))
    table = stash(plan(sized, weights, epochs, bins).select(F.col("source").alias(of), F.col("source_size").alias(total), F.col("target").alias(target), F.col("whole").alias(whole), F.col("cut").alias(cut)), "plan")
    first_rows = table.limit(few + 1).collect()
    if len(first_rows) <= few:
        kinds = StructType([StructField(n, t) for n, t in zip((of, total, target, whole, cut), (StringType(), LongType(), DoubleType(), LongType(), LongType()))])
        known = docs.sparkSession.createDataFrame([tuple(r) for r in first_rows], kinds)
        joined = rows.join(F.broadcast(known), F.col(source).eqNullSafe(F.col(of)))
    else:
        salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(15))))
        joined = rows.join(salted, F.col(source).eqNullSafe(F.col(of)) & (F.pmod(bin_, F.lit(16)) == F.col(salt)))
    times = F.when(F.col(size) > 0, F.col(whole) + (F.col(bin_) < F.col(cut)).cast("long")).otherwise(0).cast("long")
    out = joined.select(*cols, size, total, target, times.alias(copies))
    return out, {"size": size, "source_size": total, "target": target, "copies": copies}


def mix(docs: DataFrame, carry: list[str] | None = None, weights: tuple[float, ...] = WEIGHTS, epochs: float = 3.0, seed: int = 7, bins: int = 4096, few: int = 10_000) -> DataFrame:
    """The carried columns of docs (all, if not given) and size, source_size, target, copies, taken."""
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in OWN]
    rows, own = planned(docs, carry, weights, epochs, seed, bins, few)
    return rows.select(*(F.col(f"`{c}`") for c in carry), *(F.col(own[c]).alias(c) for c in OWN[:4]), (F.col(own["copies"]) * F.col(own["size"])).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = 3.0, seed: int = 7, bins: int = 4096, few: int = 10_000) -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    rows, own = planned(docs, docs.columns, weights, epochs, seed, bins, few)
    copies = own["copies"]
    return rows.where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*(F.col(f"`{c}`") for c in docs.columns))
