"""Sessions, lineage cuts and the size rules that decide between a broadcast and a shuffle."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: A key is hot when it holds more than this many rows and more than total / MAX_HOT of them.
HOT_ROWS = 1_000_000
#: At most so many keys can be hot, so a table of them may be broadcast.
MAX_HOT = 100_000


def local_session(cpus: int = 4, name: str = "cardscope", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings a session."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",  # exact percentiles of some hundred groups stay hashed
        "spark.executorEnv.OMP_NUM_THREADS": "1",  # Python workers run side by side already
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of this machine only where that is unset and Spark is local."""
    sc = spark.sparkContext
    said = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if said:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(said)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cardscope-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there; survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_once(tasks: list[Callable[[], T]], threads: int = 4) -> list[T]:
    """The results of independent tasks, whose Spark jobs run beside each other."""
    if len(tasks) < 2:
        return [t() for t in tasks]
    with ThreadPoolExecutor(min(threads, len(tasks))) as pool:
        spark = SparkSession.getActiveSession()
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t) if spark else t) for t in tasks]]


def hot_of(counts: DataFrame, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """The rows of a table of counts per key whose `count` exceeds max(hot_rows, total / max_hot): at most max_hot rows."""
    total = counts.agg(F.sum("count").alias("__total"))
    limit = F.greatest(F.lit(hot_rows).cast("double"), F.coalesce(F.col("__total"), F.lit(0)) / F.lit(max_hot))
    return cut_lineage(counts.join(F.broadcast(total), F.col("count") > limit).drop("__total"))


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """Keys with more than max(hot_rows, total / max_hot) rows, with their count: never more than max_hot of them.

    A table of at most hot_rows rows has none, which a count without a shuffle tells."""
    if df.count() <= hot_rows:
        return df.sparkSession.createDataFrame([], df.select(*keys).withColumn("count", F.lit(0).cast("bigint")).schema)
    return hot_of(df.groupBy(*keys).count(), hot_rows, max_hot)


__all__ = ["HOT_ROWS", "MAX_HOT", "at_once", "checkpoint_dir", "cut_lineage", "hot_keys", "hot_of", "local_session"]
