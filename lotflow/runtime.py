"""Session helpers shared by every operator: table access and reliable lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark resolves the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Have executors import this package, where it is not installed on them: it is sent as a zip file, once a session.

    The file is built in a temporary folder of the driver, from where Spark's own file server hands it out.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "lotflow"), "zip", root, "lotflow"))


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints: the session's own; without one, a temporary one on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder; later reads survive a lost executor."""
    shared_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_key(df: DataFrame, keys: tuple[str, ...], *order: str | Column) -> DataFrame:
    """Rows dealt by key and sorted by key and ``order``, for one pass over each partition.

    They are dealt by a struct of the keys. An exchange by the columns themselves is left out of a plan that has dealt by
    them already, for a join or a union of joins; such a join may become a broadcast while the query runs, and then the
    rows of a key would lie in several partitions. Keys come in the order of a hash: the sort tells most rows apart by that
    number, and compares the texts of keys only where it is the same.
    """
    hashed = df.repartition(F.struct(*keys)).withColumn("_hash", F.xxhash64(*keys))
    return hashed.sortWithinPartitions("_hash", *keys, *order).drop("_hash")


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings, with ``__`` for each point of a name, that hold inside the block alone; the session has its own again after it."""
    named = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
