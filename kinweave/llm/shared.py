"""Tables in the folder that all executors share, which cut the lineage of iterative jobs, and joins on hot keys."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of ids or digests is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of one key that a task of a join takes, about; the rows of a key with more are dealt to several tasks.
HOT_ROWS = 500

_open: list[list[str]] = []
_paths: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder, but on a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinweave_shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """df written to the shared folder and read again: an executor that is lost takes nothing of it along.

    Within scratch() the table goes at its end; with `keep` at the end of the scratch() around that, if there is one.
    """
    path = f"{folder(df.sparkSession)}/kinweave/{uuid.uuid4().hex}"
    ([_paths, *_open][-2 if keep and _open else -1]).append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kinweave_path = path
    return out


def drop(spark: SparkSession, paths: list[str]) -> None:
    sc = spark.sparkContext
    for p in paths:
        where = sc._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def forget(df: DataFrame) -> None:
    """Delete a table that stored() returned; nothing may read it any more."""
    path = getattr(df, "_kinweave_path", None)
    for paths in (_paths, *_open):
        if path in paths:
            paths.remove(path)
            drop(df.sparkSession, [path])


def sweep(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of jobs whose result is stored: it does so when the driver collects garbage,
    which a driver with memory to spare does late."""
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete what stored() has kept; the results of earlier operators that still read it are lost."""
    drop(spark, _paths)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within go at the end: results must be stored with keep=True or not read them."""
    _open.append([])
    try:
        yield
    finally:
        drop(spark, _open.pop())


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a stored table if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hot_keys(many: DataFrame, *keys: str, least: int | None = None) -> DataFrame | None:
    """Keys that more rows of a stored table have than a task should take, with _salts, the tasks to deal them to.

    No more than BROADCAST_ROWS keys at any size, as what counts as hot grows with the table; None if there is none.
    """
    return hot_of(many.groupBy(*keys).agg(F.count("*").alias("_n")), "_n", *keys, least=least)


def hot_of(counts: DataFrame, n: str, *keys: str, least: int | None = None) -> DataFrame | None:
    """hot_keys() of a table whose rows are counted already, as `n`, for each key."""
    limit = least or HOT_ROWS
    found = counts.select(*keys, F.col(n).alias("_n")).where(F.col("_n") > limit)
    hot = stored(found.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_n"))
    rows = hot.agg(F.sum("_n")).first()[0]
    if rows is None:
        return None
    limit = max(limit, rows // BROADCAST_ROWS)  # no more keys than BROADCAST_ROWS have more rows than that
    return hot.where(F.col("_n") > limit).withColumn("_salts", F.ceil(F.col("_n") / limit).cast("int")).drop("_n")


def dealt_join(many: DataFrame, one: DataFrame, keys: str | list[str], hot: DataFrame | None, spread: str, how: str = "inner") -> DataFrame:
    """many.join(one, keys), with the rows of hot keys dealt by the hash of `spread` and their rows of `one` copied."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if hot is None:
        return many.join(one, keys, how)

    def salted(df: DataFrame, salt) -> DataFrame:
        hit = [df[k] == hot[f"_hot_{k}"] for k in keys]
        out = df.join(F.broadcast(hot), hit, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
        return out.withColumn("_salt", salt).select(*df.columns, "_salt")

    left = salted(many, F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"))
    right = salted(one, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
