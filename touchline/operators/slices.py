"""Ordered work on groups of any size.

A window over a whole game is fine while a game is a few thousand events.  It
stops being fine when one key holds a large part of the table, because one
task then sorts that whole group.  The helpers here give every row a dense
ordinal inside its group and cut large groups into chunks of at most
``chunk_rows`` consecutive rows:

* groups all small (checked with one map-side-combined count): a plain
  ``row_number`` window, no ``chunk`` column;
* otherwise the large groups, and only they, are range-partitioned on the full
  order (balanced however skewed the keys are), numbered inside each range, and
  given the rows of the earlier ranges; the others stay whole, as chunk 0.  The
  result has a ``chunk`` column and every later window is partitioned by
  ``(keys, chunk)``.

Values that look over a chunk border come from copied border rows
(``with_halo``); running values come from a per-chunk summary, which has one
row per chunk and is scanned with an ordinary window.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows one task may have to sort for one group before the group is cut.
CHUNK_ROWS = 1 << 19


def workspace(spark: SparkSession) -> str:
    """Shared folder for staged tables: the one the cluster names.

    A local session without the setting gets one under its warehouse.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, cutting lineage."""
    return stage_at(df)[0]


def stage_at(df: DataFrame) -> tuple[DataFrame, str]:
    """A staged table and its path, for ``unstage`` once nothing reads it."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def unstage(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def side_by_side(spark: SparkSession, work: Sequence[Callable[[], Any]], most: int) -> list:
    """What each of ``work`` returns; up to ``most`` of them run at the same time.

    For work that is many short jobs in a row, each too small for all cores.
    """
    # Threads of their own get the caller's job group and the like.
    carried = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(1, min(most, len(work)))) as pool:
        begun = [pool.submit(carried(one) if callable(carried) else one) for one in work]
        try:
            return [one.result() for one in begun]
        finally:
            pool.shutdown(cancel_futures=True)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group (partial counts, one row back)."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return top or 0


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "ord",
    total: str = "cnt",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Dense 1-based position of each row in its group, and the group size.

    ``order`` must be a total order inside a group.  Adds ``chunk`` only when
    some group is larger than ``chunk_rows``.
    """
    def by_window(rows: DataFrame) -> DataFrame:
        group = Window.partitionBy(*keys)
        return rows.withColumns({
            out: F.row_number().over(group.orderBy(*order)).cast("long"),
            total: F.count(F.lit(1)).over(group),
        })

    if largest_group(df, keys) <= chunk_rows:
        return by_window(df)
    large = stage(df.groupBy(*keys).count().filter(F.col("count") > chunk_rows).select(*keys))
    whole = by_window(df.join(large, list(keys), "left_anti")).withColumn(
        "chunk", F.lit(0).cast("long"))
    cut = by_ranges(df.join(large, list(keys), "left_semi"), keys, order, out, total, chunk_rows)
    return whole.unionByName(cut)


def by_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, total: str,
    chunk_rows: int,
) -> DataFrame:
    """The numbering of large groups, with their ``chunk``."""
    cols = [F.col(c) for c in (*keys, *order)]
    ranged = stage(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_range", F.shiftright("_at", 33))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        ranged.groupBy(*keys, "_range")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumns({
            "_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
            total: F.sum("_rows").over(group),
        })
        .drop("_rows")
    )
    numbered = ranged.join(pieces, [*keys, "_range"])
    position = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return (
        numbered.withColumn(out, position)
        .withColumn("chunk", F.floor((F.col(out) - 1) / chunk_rows))
        .drop("_at", "_range", "_first", "_before")
    )


def with_halo(
    df: DataFrame, ord_col: str, before: int, after: int, chunk_rows: int
) -> DataFrame:
    """Copy border rows into the neighbouring chunks.

    ``slot`` is the chunk a copy serves; a row is at home where
    ``slot == chunk``.  Each chunk sees ``before`` rows of the previous chunk
    and ``after`` rows of the next one.
    """
    if max(before, after) > chunk_rows:
        raise ValueError("chunk_rows is smaller than the look-around")
    offset = (F.col(ord_col) - 1) % chunk_rows
    chunk = F.col("chunk")
    slots = F.array_compact(F.array(
        chunk,
        F.when((offset < after) & (chunk > 0), chunk - 1),
        F.when(offset >= chunk_rows - before, chunk + 1),
    ))
    return df.withColumn("slot", F.explode(slots))


def at_home(df: DataFrame) -> DataFrame:
    """Drop the border copies.

    ``slot`` takes over as ``chunk``, so the rows stay partitioned by it.
    """
    home = df.filter(F.col("slot") == F.col("chunk"))
    return home.drop("chunk").withColumnRenamed("slot", "chunk")


def running_sums(
    df: DataFrame, keys: Sequence[str], ord_col: str, sums: dict[str, Column],
    source: DataFrame | None = None,
) -> DataFrame:
    """Running totals inside each group, in ordinal order.

    For cut groups, ``source`` may name an earlier frame with the same rows to
    take the chunk totals from, so that ``df`` is not worked out twice.
    """
    def so_far(*group: str):
        return (Window.partitionBy(*group).orderBy(ord_col)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    if "chunk" not in df.columns:
        return df.withColumns({
            n: F.sum(c).over(so_far(*keys)) for n, c in sums.items()})

    earlier = (Window.partitionBy(*keys).orderBy("chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = (
        (source or df).groupBy(*keys, "chunk")
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        .select(*keys, "chunk", *[
            F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_in_{n}") for n in sums
        ])
    )
    return (
        df.withColumns({n: F.sum(c).over(so_far(*keys, "chunk"))
                        for n, c in sums.items()})
        .join(carried, [*keys, "chunk"])
        .withColumns({n: F.col(n) + F.col(f"_in_{n}") for n in sums})
        .drop(*[f"_in_{n}" for n in sums])
    )
