"""Loops over DataFrames, and total orders without a single task."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ready(spark: SparkSession) -> None:
    """Checkpoints go to the folder that spark.checkpoint.dir names. Where none is set a folder of this machine stands in,
    if all of Spark runs in this one process; on a cluster executors would not find it again, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    sc.setCheckpointDir(folder)


def state_of(df: DataFrame, *columns: str) -> tuple:
    """A summary of all rows, whatever their order: two states of a loop are equal if theirs are, but for a chance of
    2^-100 or so. Count, and two whole sums of independent 64-bit hashes."""
    sums = [F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)")) for salt in (1, 2)]
    return tuple(df.agg(F.count("*"), *sums).first())


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a Parquet table in the checkpoints' folder: its lineage is cut, other executors can read it when
    one is lost, and ``drop`` deletes it."""
    spark = df.sparkSession
    ready(spark)
    path = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what ``cut`` wrote; nothing may read these tables any more. Shuffle files that no plan holds go with them."""
    spark = tables[0].sparkSession
    for df in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    swept(tables[0])


def swept(df: DataFrame) -> DataFrame:
    """``df``; shuffle files that no plan holds are deleted now, not when the driver happens to collect its garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], object], most: int = 1000) -> DataFrame:
    """Applies ``step`` until ``measure``, a small summary of the state, stays the same, or ``most`` times. The state before is deleted."""
    state = cut(state)
    seen = measure(state)
    for _ in range(most):
        before, state = state, cut(step(state))
        drop(before)
        now = measure(state)
        if now == seen:
            break
        seen = now
    return state


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the row's place from 1 in a total order: ranges are sorted by themselves, counts of the ranges before are added."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = rows.withColumn("__part", part).join(starts, "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__before")
