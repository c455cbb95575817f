"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that divides words in every contract here: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    A session on one machine (a master of local or local[...]) gets a temporary folder where that is unset; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='foliant-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, sizes are known, any executor can read it again.

    options: those of the Parquet writer.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove what `stash` wrote: the given tables, or all that this process wrote, once no result that reads them is needed."""
    for path in [t._foliant_path for t in tables] or list(_WRITTEN):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


#: Rows up to which a table that a plan joins with is sent to every executor: at 100 bytes a row 20 MB at most.
SMALL = 200_000


def small_side(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, a written table, marked to be broadcast if it has at most `most` rows; else it is left to be shuffled, which AQE can split."""
    return F.broadcast(df) if df.count() <= most else df


def bound_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Arrow batches of few rows and bytes, so that a worker holds few long texts at once; a smaller number of rows stays.

    Spark reads these settings when the plan runs, so they stay lowered in the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow column of strings; null gives none."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for an operator's own columns that none of `columns` has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(*columns: str | Column) -> list[Column]:
    """Two longs that tell rows apart by these columns, nulls included."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(k), *parts) for k in (1, 2)]


def number_equals(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """df with the column `number`: 0, 1, ... among the rows that are equal in `keys`, 0 for a row that has no equal.

    Which of equal rows gets which number is left open. Where no key occurs twice, nothing more is done. Else rows are
    written with their partition and place; those of repeated keys are counted by key and partition, and a row's number is its
    place in its partition after the rows of the partitions before it. So no task sees all rows of one key.
    """
    again = stash(df.groupBy(*keys).count().where("count > 1").select(keys), "again")
    if again.isEmpty():
        return df.withColumn(number, F.lit(0).cast("long"))
    part, mark, off, place, *own = fresh(df.columns, "_part", "_mark", "_off", "_place", *(f"_k{i}" for i in range(len(keys))), "_kp")
    *own, kp = own
    equal = lambda: [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, own)]
    known = again.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.lit(True).alias(mark))
    placed = df.join(small_side(known), equal(), "left").drop(*own)
    placed = stash(placed.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}), "placed")
    counts = stash(placed.where(mark).groupBy(*keys, part).count(), "counts")
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = stash(counts.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.col(part).alias(kp), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(off)), "offsets")
    inside = F.row_number().over(Window.partitionBy(*keys, part).orderBy(place)) - 1
    ranked = placed.where(mark).withColumn(place, inside).join(small_side(offsets), [*equal(), F.col(part) == F.col(kp)])
    ranked = ranked.select(*(F.col(f"`{c}`") for c in df.columns), (F.col(place) + F.col(off)).cast("long").alias(number))
    return ranked.unionByName(placed.where(F.col(mark).isNull()).select(*(F.col(f"`{c}`") for c in df.columns), F.lit(0).cast("long").alias(number)))
