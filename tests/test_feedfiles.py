import gzip
import json

from pyspark.sql import functions as F

from lotflow.sources import changefeed
from lotflow.sources.feedfiles import ChangefeedFiles


def line(k):
    return json.dumps({"after": {"aggregate_id": f"a{k}", "event_type": "T", "sequence_engine_key": k}, "updated": str(k)})


def put(folder, n, keys, end="\n"):
    folder.mkdir(exist_ok=True)
    (folder / f"{n:05d}.ndjson").write_text("\n".join(map(line, keys)) + end)


def test_files_as_a_table(spark, tmp_path):
    spark.dataSource.register(ChangefeedFiles)
    feed = tmp_path / "feed"
    put(feed, 1, range(5000))
    put(feed, 2, [7001, 7002], end="")
    (feed / "00003.ndjson.gz").write_bytes(gzip.compress((line(8000) + "\n\n" + line(8001)).encode()))
    (feed / "_writing").write_text("nothing")
    (feed / "00004.ndjson").write_text("")
    rows = spark.read.format("changefeed_files").option("path", str(feed)).option("topic", "orchestrator_outbox").load()
    assert rows.count() == 5004 and rows.where("file = '00003.ndjson.gz'").agg(F.max("offset")).first()[0] == 2
    events = changefeed.projections(changefeed.decode(rows)[0])
    assert {int(r.sequence_engine_key) for r in events.collect()} == {*range(5000), 7001, 7002, 8000, 8001}


def run(spark, tmp_path, most=None):
    sizes = []

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch_id}")
        sizes.append(batch.select("file").distinct().count())

    reader = spark.readStream.format("changefeed_files").option("path", f"{tmp_path}/feed").option("topic", "t")
    if most:
        reader = reader.option("maxFiles", most).option("progress", f"{tmp_path}/progress.json")
    query = reader.load().writeStream.option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(write).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sizes


def kept(spark, tmp_path):
    return sorted(int(json.loads(r.value)["updated"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_stream_restarts_without_loss_or_repeats(spark, tmp_path):
    spark.dataSource.register(ChangefeedFiles)
    put(tmp_path / "feed", 1, [1, 2])
    put(tmp_path / "feed", 2, [3])
    run(spark, tmp_path)
    put(tmp_path / "feed", 3, [4, 5])
    run(spark, tmp_path)
    run(spark, tmp_path)
    assert kept(spark, tmp_path) == [1, 2, 3, 4, 5]


def test_batches_are_bounded_also_after_a_restart(spark, tmp_path):
    spark.dataSource.register(ChangefeedFiles)
    for n in range(5):
        put(tmp_path / "feed", n, [n])
    first = run(spark, tmp_path, most=2)
    for n in range(5, 10):
        put(tmp_path / "feed", n, [n])
    second = run(spark, tmp_path, most=2)
    assert max(first + second) == 2 and sum(first + second) == 10
    assert kept(spark, tmp_path) == list(range(10))
