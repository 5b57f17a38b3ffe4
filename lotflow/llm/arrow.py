"""How text travels to Python tasks: small, byte-bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts holds, so that long texts cannot fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: extra columns, whatever their names, stay behind."""
    return df.select(*[df[n] for n in names])
