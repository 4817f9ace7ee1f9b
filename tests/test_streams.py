"""Streams against the batch: sessions, days, promotion, progress, cancelling."""

import threading
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from playloom.functions.core import DAY_MS
from playloom.operators import ingest, parsing, reconstruct
from playloom.sources.rotations import rotated_lines, with_hints
from playloom.streaming import sessions as streaming

EVENTS = f"instance_id long, {streaming.EVENT}"


@pytest.fixture(scope="module")
def events(spark, sf):
    """Events of some users with end hints; every source's lines in the order of its times, and the sources in the order of days."""
    lines = rotated_lines(spark, sf).filter("instance_id < 15 and instance_id % 3 <> 0 and instance_id % 5 <> 0")
    found = with_hints(parsing.log_events(lines)).select("instance_id", *[f.split()[0] for f in streaming.EVENT.split(", ")])
    rows = [tuple(r) for r in found.collect()]
    order = max(r[5] for r in rows)
    at = order * DAY_MS + 36_000_000
    tail = [(99, "start", None, at, "99/a", order, 1, 0, 94, at + 1_830_000), (99, "server", "a.b:1", at + 1_800_000, "99/a", order, 2, 0, 95, at + 1_830_000)]
    return spark.createDataFrame(rows + tail, EVENTS)


def run(spark, events, folder, parts, late):
    """The stream over the parts, one in each micro-batch, then one far event of another instance that moves the watermark on."""
    far = spark.createDataFrame([(-1, "stopping", None, (20_000 + k) * DAY_MS, "z", 30_000, k, 0, 96, None) for k in range(2)], EVENTS)
    for k, part in enumerate([*parts, far.limit(1), far]):
        part.coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
        for f in (folder / "in" / f"{k:03d}").glob("*.parquet"):
            f.touch()
        time.sleep(0.05)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    stream = streaming.stream_sessions(source, late)
    query = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.table("closed").filter("instance_id > 0").collect())


def test_stream_equals_batch(spark, events, tmp_path):
    """In pieces of a few days, shuffled within; all sessions, open ones and those that end by a hint among them."""
    want = sorted(tuple(r) for r in reconstruct.sessions(events).collect())
    days = sorted(r[0] for r in events.select("source_order").distinct().collect())
    borders = [days[0], days[len(days) // 3], days[2 * len(days) // 3], days[-1] + 1]
    parts = [events.filter((F.col("source_order") >= low) & (F.col("source_order") < high)).orderBy(F.xxhash64("line_number")) for low, high in zip(borders, borders[1:])]
    progress = streaming.Progress()
    spark.streams.addListener(progress)
    try:
        got = run(spark, events, tmp_path, parts, "2 days")
        for _ in range(50):
            if progress.seen.get("closed", {}).get("rows") == events.count() + 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    assert {w[5] for w in want} >= {"source_end_hint", "next_start", "client_stopping", "crash", "clean_shutdown"}
    assert got == want
    assert progress.seen["closed"]["rows"] == events.count() + 3 and progress.seen["closed"]["late"] == 0


def test_days_are_cut_at_midnight(spark, tmp_path):
    start = 100 * DAY_MS + 20 * 3_600_000
    rows = [(1, start, start + 30 * 3_600_000 + 500), (1, start, start), (1, 101 * DAY_MS, 102 * DAY_MS), (2, start - 1, start - 5), (-1, 200 * DAY_MS, 200 * DAY_MS + 1000), (-1, 300 * DAY_MS, 300 * DAY_MS)]
    table = spark.createDataFrame(rows, "instance_id long, start_ms long, end_ms long")
    for k in range(3):
        table.filter(F.lit(k == 0) & (F.col("instance_id") > 0) | (F.col("start_ms") == (k + 1) * 100 * DAY_MS)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.05)
    days = streaming.stream_days(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), offset_min=120)
    days.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(r["instance_id"], r["day"]): (r["seconds"], r["slices"]) for r in spark.table("days").filter("instance_id > 0").collect()}
    first = [date.fromordinal(date(1970, 1, 1).toordinal() + d) for d in (100, 101, 102)]
    assert got == {(1, first[0]): (7200, 2), (1, first[1]): (86400 + 79200, 2), (1, first[2]): (14400 + 7200, 2), (2, first[0]): (0, 1)}


def test_promotion_grows_with_the_batch(spark, tmp_path):
    """A batch that is run again adds nothing; earlier files stay as they are."""
    store = ingest.Snapshots(spark, f"file://{tmp_path}/store")
    rows = spark.range(1000).select(F.col("id").alias("instance_id"))
    fence = store.acquire("stream")
    for number in (0, 1, 1, 2):
        streaming.promote_batch(rows.filter(F.col("instance_id") % 3 == number), number, store, fence)
    streaming.promote_batch(rows.filter("false"), 3, store, fence)
    assert store.revision() == 3 and sorted(r[0] for r in store.read("sessions").collect()) == list(range(1000))
    assert len(list((tmp_path / "store").glob("sessions-*"))) == 3
    rows.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("instance_id long").parquet(f"{tmp_path}/in")
    other = ingest.Snapshots(spark, f"file://{tmp_path}/other")
    for _ in range(2):
        streaming.promote_stream(source, other, f"{tmp_path}/cp").awaitTermination()
    assert other.read("sessions").count() == 1000


def test_a_run_can_be_cancelled(spark):
    failed = []

    def work():
        with streaming.Run(spark, "slow"):
            try:
                spark.range(0, 8, 1, 8).mapInPandas(lambda batches: [time.sleep(60)] and batches, "id long").count()
            except Exception as stopped:
                failed.append(str(stopped))

    thread = threading.Thread(target=work)
    thread.start()
    time.sleep(3)
    streaming.Run(spark, "slow").cancel()
    thread.join(40)
    assert not thread.is_alive() and failed and "cancel" in failed[0].lower()
    assert spark.range(5).count() == 5
