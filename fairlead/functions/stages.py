"""Steps of a plan: projections that aren't folded into each other, tables kept for later steps, and running sums."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of kept tables that this process has written, by session folder.
_WRITTEN: dict[str, list[str]] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The frame with more columns, each computed once for a row.

    A plain projection may be merged with the next, and a filter pushed below it, by copying definitions into every
    place that names them; with dozens of columns over one another that multiplies. A generator of one row is kept.
    """
    old = [c for c in df.columns if c not in columns]
    row = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select(*old, F.inline(F.array(row)))


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where none is set, a local session, as in tests, gets a temporary one; a
    cluster has to name a folder that its machines share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return context.getCheckpointDir()


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What queries in here shuffle is deleted when they end, as their results are written, not when the driver happens
    to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared folder and read from there.

    Lost executors don't matter to what has been written, later steps don't compute it again, read only the columns
    they name, and know its size. Columns of nothing but nulls without a type become strings. Tables stay until `forget`, as
    frames that read them may be used at any time.
    """
    void = [name for name, kind in df.dtypes if kind == "void"]  # which Parquet hasn't
    df = df.withColumns({c: df[c].cast("string") for c in void}) if void else df
    folder = shared_folder(df.sparkSession)
    path = f"{folder}/kept-{uuid.uuid4().hex}"
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    _WRITTEN.setdefault(folder, []).append(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[kept] = path
    return kept


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(kept: DataFrame) -> None:
    """Deletes the table of a frame that `durable` returned, once nothing that reads it is still to run."""
    path = _PATHS.pop(kept)
    _WRITTEN[shared_folder(kept.sparkSession)].remove(path)
    _delete(kept.sparkSession, path)


def forget(spark: SparkSession) -> int:
    """Deletes the tables kept by this process in the session's shared folder; their number. For a caller that has
    written or collected all results."""
    paths = _WRITTEN.pop(shared_folder(spark), [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """The frame with, for each name in `sums`, the sum of a value over all rows before this one in a total order.

    Rows are dealt by ranges of the order, sorted and numbered, and kept; each range is summed by its own task, and the
    ranges, as many as there are shuffle partitions, are summed one over the other. No task holds more than a range.
    """
    at, part, own = "_at", "_part", {n: f"_{n}" for n in sums}
    dealt = rows.select("*", *(v.alias(own[n]) for n, v in sums.items())).orderBy(*order)
    dealt = durable(dealt.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(*(F.sum(own[n]).alias(own[n]) for n in sums))
    offsets = totals.select(part, *(F.coalesce(F.sum(own[n]).over(earlier), F.lit(0)).alias(n) for n in sums))
    before = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumns({f"{own[n]}_": F.coalesce(F.sum(own[n]).over(before), F.lit(0)) for n in sums})
    met = found.join(F.broadcast(offsets), part)
    return met.select(*rows.columns, *((F.col(n) + F.col(f"{own[n]}_")).alias(n) for n in sums))
