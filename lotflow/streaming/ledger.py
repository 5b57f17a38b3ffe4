"""Sources and stream jobs without state of their own. Every query takes a checkpoint folder and can be restarted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotflow.operators import contracts, dlq, workflow
from lotflow.schemas import MOVEMENT, VENDOR_EMAIL


def movement_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Movements as they arrive in a folder."""
    return spark.readStream.schema(MOVEMENT).option("maxFilesPerTrigger", max_files).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, *topics: str) -> DataFrame:
    """Raw records of Kafka topics, where the cluster has that connector."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("includeHeaders", "true").load()


def deduplicated(stream: DataFrame, event_time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Each event once: for ever, or with bounded state within a watermark."""
    if event_time is None:
        return stream.dropDuplicates(["event_id"])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["event_id"])


def split_writer(rules: dict, good_path: str, dead_path: str, topic: str, log_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """A batch function: good rows typed and appended, bad ones appended as dead letters, before the batch commits.

    With ``log_path`` every row is appended there as it came before anything is decided about it. A batch that runs
    again replaces its own files, so effects are exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if log_path:
            batch.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        good, bad = contracts.split_valid(batch, rules)
        contracts.typed_movements(good).write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        records = bad.select(F.lit(topic).alias("topic"), F.col("event_id").alias("key"), F.to_json(F.struct(*batch.columns)).alias("value"), F.array().cast("array<struct<key:string,value:binary>>").alias("headers"), F.array_join("errors", ",").alias("reason"))
        dlq.dead_letters(records).write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")

    return write


def run_ingest(spark: SparkSession, source: str, good_path: str, dead_path: str, checkpoint: str, topic: str = "inventory.movement.v1", log: str | None = None) -> StreamingQuery:
    """Everything that has arrived: deduplicated, logged raw if ``log`` names a folder, validated, split."""
    stream = deduplicated(movement_stream(spark, source))
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(split_writer(contracts.MOVEMENT_RULES, good_path, dead_path, topic, log)).start()


def settled_figures(spark: SparkSession, source: str, checkpoint: str, out: str, waiting: str, schema: str) -> StreamingQuery:
    """Settled figures of a feed after each batch: one row a batch in ``out``, over all rows so far.

    Rows with ``resolved`` are watermarks; the newest so far holds. Rows above it wait in ``waiting``, a folder a batch,
    until a later watermark settles them. A batch reads what the one before left and replaces its own folders when it
    runs again.
    """
    from lotflow.operators import settlement

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, marks = batch.where("resolved is null").drop("resolved"), batch.where("resolved is not null").select(F.col("resolved").alias("watermark"))
        before = None
        if batch_id:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{waiting}/batch={batch_id - 1}"))
            before = spark.read.parquet(f"{out}/batch={batch_id - 1}")
            marks = marks.unionByName(before.select(F.col("watermark").cast("long")))
        split = settlement.split(rows, marks)
        new = settlement.figures(split).join(marks.agg(F.max("watermark").cast("long").alias("watermark")))
        if before is not None:
            totals = ["settled", "settled_value", "exceptions"]
            new = new.join(before.select(*[F.col(c).alias(f"_{c}") for c in totals])).withColumns({c: F.coalesce(c, F.lit(0)) + F.col(f"_{c}") for c in totals}).drop(*[f"_{c}" for c in totals])
        new.select("watermark", "settled", "in_flight", F.coalesce("settled_value", F.lit(0.0)).alias("settled_value"), "exceptions").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        split.where("not settled").select(*rows.columns).write.mode("overwrite").parquet(f"{waiting}/batch={batch_id}")

    return spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def append_outbox(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that appends transitions as outbox rows; a batch that runs again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        workflow.outbox(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def email_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Vendor e-mails as they arrive in a folder."""
    return spark.readStream.schema(VENDOR_EMAIL).option("maxFilesPerTrigger", max_files).parquet(path)


def run_changefeed(stream: DataFrame, topic: str, updated: str, out: str, checkpoint: str, source: str | None = None, sources: int = 1) -> StreamingQuery:
    """Rows of a table as change-feed envelopes, with watermarks that hold: no later row is at or below one.

    ``source`` names the column of the source partition, of which there are ``sources``; in each ``updated`` ascends. A
    batch's watermark is the least of the newest ``updated`` of all of them, so there is none before every one was heard
    of, and none that repeats the last. What each had reached is kept in ``out`` beside the envelopes, a folder a batch.
    A row at or below a watermark that is out breaks its source's order: it is not sent, but kept in ``late``.
    """
    from lotflow.sources.changefeed import encode

    name = F.lit("") if source is None else F.col(source).cast("string")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        reached = batch.groupBy(name.alias("source")).agg(F.max(updated).alias("newest"))
        before = None
        if batch_id:
            before = spark.read.parquet(f"{out}/reached/batch={batch_id - 1}")
            reached = reached.unionByName(before).groupBy("source").agg(F.max("newest").alias("newest"))
        reached.write.mode("overwrite").parquet(f"{out}/reached/batch={batch_id}")
        frontier = lambda df: df.agg(F.when(F.count("*") >= sources, F.min("newest")).alias("m")).first().m
        last, now = None if before is None else frontier(before), frontier(spark.read.parquet(f"{out}/reached/batch={batch_id}"))
        behind = F.lit(False) if last is None else F.coalesce(F.col(updated) <= F.lit(last), F.lit(False))
        batch.where(behind).write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        mark = spark.range(1).select(F.lit(None if now == last else now).alias("m"))
        encode(batch.where(~behind), topic, updated, mark).write.mode("overwrite").parquet(f"{out}/sent/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
