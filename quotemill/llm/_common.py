"""Shared plumbing of the training-data operators.

Everything here keeps three promises: nothing is gathered on the driver that
grows with the data, lineage is cut only through files in the cluster's shared
folder, and a re-run gives the same rows.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workers import importable


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A key with more than 1 in HOT of all rows is joined by broadcast: so there are at most HOT of them.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one in
    local mode, where all tasks share it; an error on a cluster, where they don't."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = jsc.getCheckpointDir()
    if named:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not current.isDefined():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quotemill-"))
        current = jsc.getCheckpointDir()
    return current.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives a lost executor, files go when unreferenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class _Made(threading.local):
    """Paths that this thread made: one thread never removes what another still reads."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed by ``free`` or when the driver ends."""
    path = f"{shared_dir(spark)}/quotemill-{kind}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(where)  # only what exists can be marked
    store.deleteOnExit(where)
    _made.paths.append(path)
    return path


@contextmanager
def free(spark: SparkSession):
    """Removes, at the end of the block, the tables that its thread made in it: for long
    sessions. Results of the block must have been written by then."""
    before = len(_made.paths)
    try:
        yield
    finally:
        for path in _made.paths[before:]:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        del _made.paths[before:]


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    return _written(df, scratch(df.sparkSession, "table"), codec)


def _written(df: DataFrame, path: str, codec: str) -> DataFrame:
    df.write.mode("append").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], codec: str = "zstd") -> DataFrame:
    """``stored`` of what ``make`` returns; the tables that it made on the way go at once."""
    path = scratch(spark, "table")  # made before the block, so it stays
    with free(spark):
        return _written(make(), path, codec)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound an Arrow batch: whole texts are long, 10,000 of them are too many. The bound
    stays in the session, because plans are run after the operator returned."""
    importable()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def spread_join(rows: DataFrame, one: DataFrame, key: list[str], total: int, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``: a row a key, whose ``n`` says how many of the ``total``
    rows have it. Hot keys (see ``HOT``) are joined by broadcast, the others by a shuffle, so
    no task gets the rows of a hot key. ``how`` is inner or left; rows of a null key match nothing."""
    crowded = F.col(n) > F.lit(total // HOT)
    hot, rest = one.filter(crowded).drop(n), one.filter(~crowded).drop(n)
    plain = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(plain)


def _ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with ``_at``: partition and place in it.
    A checkpoint fixes both before they are used."""
    dealt = df.repartitionByRange(parts(df.sparkSession), *order).sortWithinPartitions(*order)
    return cut(dealt.withColumn("_at", F.monotonically_increasing_id()))


def _below(per_part: DataFrame, value: str) -> DataFrame:
    """Sum of ``value`` in lower partitions; ``per_part`` has one row a partition."""
    upto = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_pid", F.coalesce(F.sum(value).over(upto), F.lit(0)).alias("_off"))


def _part() -> Column:
    return F.shiftright("_at", 33)


def numbered(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """``out``: 0, 1, 2... in ``order``, over the whole table. A total order of distinct rows
    makes it the same on every run, however the rows were dealt."""
    dealt = _ranged(df, order)
    offsets = _below(dealt.groupBy(_part().alias("_pid")).agg(F.count("*").alias("_s")), "_s")
    place = F.col("_at") - F.shiftleft(_part(), 33)
    # one row a partition: bounded by the partition count
    return dealt.join(F.broadcast(offsets), _part() == F.col("_pid")).withColumn(out, F.col("_off") + place).drop("_pid", "_off", "_at")


def ranged_prefix(df: DataFrame, order: list[str | Column], sums: dict[str, str], before: bool = False) -> DataFrame:
    """Running sums over the whole table in ``order``: of each column that ``sums`` names, under its name there.

    Range partitions are summed, the sums (one row a partition) are accumulated,
    and each partition adds its offset: no task sees more than its own range.
    ``before`` excludes the row's own value. ``order`` must be a total order for
    reruns to agree.
    """
    dealt, off = _ranged(df, order), {v: f"_off_{v}" for v in sums}
    upto = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per_part = dealt.groupBy(_part().alias("_pid")).agg(*[F.sum(v).alias(o) for v, o in off.items()])
    offsets = per_part.select("_pid", *[F.coalesce(F.sum(o).over(upto), F.lit(0)).alias(o) for o in off.values()])
    within = Window.partitionBy("_pid").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    return (
        dealt.withColumn("_pid", _part()).withColumns({out: F.coalesce(F.sum(v).over(within), F.lit(0)) for v, out in sums.items()})
        .join(F.broadcast(offsets), "_pid")  # one row a partition: bounded by the partition count
        .withColumns({out: F.col(out) + F.col(off[v]) for v, out in sums.items()})
        .drop("_pid", *off.values(), "_at")
    )


def copies(df: DataFrame, n: str = "n", out: str = "copy") -> DataFrame:
    """Each row ``n`` times, ``out`` from 0 to n - 1, however large ``n`` is."""
    step = 1 << 16
    runs = df.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / step))))
    low = F.col("_run") * step
    return runs.filter(F.col(n) > 0).withColumn(out, F.explode(F.sequence(low, F.least(low + step, F.col(n)) - 1))).drop("_run")
