"""Tables in the folder that driver and executors share, and joins that split hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 1024
"""A key is hot if it has more than one in so many of all rows: so many keys at most are."""
HOT_ROWS = 1000
"""Rows of one key that a task takes in any case."""

_written: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    for held in _written:
        held.append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan ends there, so branches that share ``df`` neither repeat it nor carry its plan, and a lost executor
    costs no recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def few_files(df: DataFrame) -> DataFrame:
    """``df`` dealt to as few tasks as its bytes ask for, to be written in as few files.

    For results much smaller than what the tasks that make them read, by an extra shuffle of the result. Each file of a
    local folder costs Hadoop runs of chmod, and for the moment of its launch a second process holds the executor's memory.
    """
    return df.hint("rebalance")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    _delete(df.sparkSession, df._shared_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end what was written to the shared folder inside, but for the materialised tables put into the yielded list."""
    _written.append([])
    keep: list[DataFrame] = []
    try:
        yield keep
    finally:
        kept = {df._shared_path for df in keep}
        for path in _written.pop():
            if path not in kept:
                _delete(spark, path)


def join_split(many: DataFrame, one: DataFrame, on: str | list[str], counts: DataFrame, total: int) -> DataFrame:
    """Inner join of ``many`` rows a key with the ``one`` row a key of the other side, hot keys split.

    ``counts`` has ``on`` and ``n``, the rows of ``many`` by key, and ``total`` their sum. A hot key's rows are dealt
    to as many parts as keep each under the bound, and its row on the other side is copied to each. Hot keys are
    at most ``HOT_KEYS``, so their table is broadcast.
    """
    most, on = max(HOT_ROWS, total // HOT_KEYS), [on] if isinstance(on, str) else on
    hot = F.broadcast(counts.filter(F.col("n") > most).select(*on, F.ceil(F.col("n") / most).cast("int").alias("__parts")))
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*many.columns), F.col("__parts"))).cast("int")
    dealt = many.join(hot, on, "left").withColumn("__part", part).drop("__parts")
    copied = one.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [*on, "__part"]).drop("__part")
