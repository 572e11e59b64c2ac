"""Tables stored by day: batches go in without what is there already, and what is too old goes out.

A table is Parquet under one folder with a directory a day (UTC) of its time. A batch is compared with the days that
it touches only, and history isn't shuffled for it: hashes of a batch's keys are broadcast if they are few enough,
counted beforehand, and what they leave of history is compared in full. A larger batch meets the same days in a
plain join. Inserting a batch again adds nothing, so a run that was cut off is run again. One writer at a time.

A clean-up removes whole days and writes the one day anew that the limit falls into. It is repeatable
likewise; days after the limit aren't opened. Rows of unknown time have a directory of their own and stay.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "_day"
#: Keys of a batch that are broadcast as hashes (8 bytes each), and days that are named one by one.
BROADCAST_KEYS, NAMED_DAYS = 1_000_000, 1_000


def day_of(at: str) -> Column:
    """The day in UTC of a timestamp."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(F.col(f"`{at}`").cast("timestamp")) / 86_400).cast("int"))


def append_days(df: DataFrame, folder: str, at: str) -> None:
    """All rows of a batch in one commit."""
    df.withColumn(DAY, day_of(at)).write.mode("append").partitionBy(DAY).parquet(folder)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(path) and any(s.isDirectory() and s.getPath().getName().startswith(f"{DAY}=") for s in store.listStatus(path))


def stored(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The table with its day; of ``like``'s columns and no rows if there is none yet."""
    schema = like.withColumn(DAY, F.lit(None).cast("date")).schema
    return spark.read.schema(schema).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], schema)


def touched(batch: DataFrame, at: str) -> Column:
    """A filter on the day: the days that the batch has rows of, or their range if they are many."""
    days = [r[0] for r in batch.select(day_of(at).alias("d")).distinct().orderBy(F.col("d").asc_nulls_first()).limit(NAMED_DAYS + 1).collect()]
    unknown = F.col(DAY).isNull() if None in days else F.lit(False)
    if len(days) <= NAMED_DAYS:
        return F.col(DAY).isin([d for d in days if d is not None]) | unknown
    most = batch.agg(F.max(day_of(at))).first()[0]
    return F.col(DAY).between(next(d for d in days if d is not None), most) | unknown


def absent(history: DataFrame, batch: DataFrame, key: list[str], at: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``batch`` whose key (nulls equal nulls) ``history``, a table by day, hasn't. ``at`` is part of the key, so a
    row can be known on its own day only. Rows of one key within the batch all stay: make it distinct first."""
    if at not in key:
        raise ValueError(f"{at} must be part of the key, or equal keys could lie on different days")
    h = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in key])
    old = history.filter(touched(batch, at)).select(*key, h.alias("_h"))
    keys = batch.select(h.alias("_h")).distinct()
    if keys.limit(most + 1).count() <= most:
        old = old.join(F.broadcast(keys), "_h", "left_semi")
    n, k = batch.withColumn("_h", h).alias("n"), old.alias("k")
    same = F.col("n._h") == F.col("k._h")
    for c in key:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}"))
    return n.join(k, same, "left_anti").drop("_h")


def insert_absent(batch: DataFrame, folder: str, key: list[str], at: str) -> None:
    """Appends what of a batch isn't stored yet; of rows with one key any one goes in."""
    once = batch.dropDuplicates(key)
    append_days(absent(stored(batch.sparkSession, folder, batch), once, key, at), folder, at)


# ------------------------------------------------------------- retention


def limit_of(days: int, now: datetime) -> datetime:
    """The oldest time that is kept."""
    from datetime import timedelta

    return now - timedelta(days=days)


def _old(at: str, limit: datetime) -> Column:
    """Older than the limit; only directories up to its day are looked at."""
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.lit(limit)) / 86_400).cast("int"))
    return (F.col(DAY) <= day) & (F.col(at) < F.lit(limit))


def expired(spark: SparkSession, folder: str, at: str, limit: datetime) -> DataFrame:
    """(_day, rows): what a clean-up would remove. A dry run."""
    return spark.read.parquet(folder).filter(_old(at, limit)).groupBy(DAY).agg(F.count("*").alias("rows"))


def _replace(rows: DataFrame, folder: str) -> None:
    """The days that rows have anew; other days aren't touched. Files are staged before old ones go."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(folder)


def clean(spark: SparkSession, folder: str, at: str, limit: datetime) -> int:
    """Removes rows older than ``limit`` (with a time zone); gives how many they were."""
    found = {r[DAY]: r["rows"] for r in expired(spark, folder, at, limit).collect()}  # a row a day
    if not found:
        return 0
    edge = spark.range(1).select(F.date_from_unix_date(F.floor(F.unix_seconds(F.lit(limit)) / 86_400).cast("int"))).first()[0]
    if edge in found:
        table = spark.read.parquet(folder)
        kept = table.filter((F.col(DAY) == F.lit(edge)) & ~_old(at, limit))
        if kept.isEmpty():
            _drop(spark, folder, edge)
        else:
            _replace(kept, folder)
    for day in sorted(d for d in found if d != edge):
        _drop(spark, folder, day)
    return sum(found.values())


def _drop(spark: SparkSession, folder: str, day: date) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{DAY}={day.isoformat()}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession, folder: str, at: str, column: str, limit: datetime) -> int:
    """``column`` of rows older than ``limit`` becomes null, the rows stay; gives how many had a value. Days without one
    aren't written. Runs that aren't finished have no time, and so keep theirs."""
    table = spark.read.parquet(folder)
    due = _old(at, limit) & F.col(column).isNotNull()
    found = {r[DAY]: r["n"] for r in table.filter(due).groupBy(DAY).agg(F.count("*").alias("n")).collect()}  # a row a day
    if found:
        days = table.filter(F.col(DAY).isin(sorted(found)))
        _replace(days.withColumn(column, F.when(~F.coalesce(due, F.lit(False)), F.col(column))), folder)
    return sum(found.values())
