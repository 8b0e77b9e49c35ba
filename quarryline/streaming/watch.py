"""Streaming: the watch loop over change events, rate windows, and the adaptive batch size as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryline.operators.changes import last_events, upserted, without
from quarryline.sources.versions import Versions


def debounced(events: DataFrame, key: str, time: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """(key, start, end, events): events of a key closer than `gap` are one batch. Late events up to `delay` count."""
    if events.isStreaming:
        events = events.withWatermark(time, delay)
    grouped = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def per_window(events: DataFrame, key: str, time: str, value: str, width: str, delay: str = "10 minutes") -> DataFrame:
    """(key, start, events, total, most): tumbling windows; bounded state by the watermark."""
    if events.isStreaming:
        events = events.withWatermark(time, delay)
    grouped = events.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("events"), F.sum(value).alias("total"), F.max(value).alias("most"))
    return grouped.select(key, F.col("w.start").alias("start"), "events", "total", "most")


def apply_changes(stored: DataFrame, events: DataFrame, key: str = "path", time: str = "ts", action: str = "action") -> DataFrame:
    """A table after a batch of events (add, change, unlink): the last event of a key decides; others of the batch are void."""
    last = last_events(events, key, time)
    kept = without(stored, last, key)
    new = last.where(F.col(action) != "unlink").select(*stored.columns)
    return upserted(kept, new, key)


def watched(spark: SparkSession, target: str, schema: T.StructType) -> Versions:
    """The table a watch loop keeps, partitioned by a hash of its key."""
    return Versions(spark, target, T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]), "bucket")


def watch(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str, key: str = "path", time: str = "ts", action: str = "action", once: bool = True, buckets: int = 64):
    """Keep the table at `target` in step with a stream of events (read it with `watched(...).read()`).

    A batch writes only the buckets its keys fall into; its number names the version and the manifest it starts from, so a
    repeated batch overwrites its own result and the sink is idempotent. What the last two batches do not use is removed.
    """
    table = watched(spark, target, T.StructType([f for f in stream.schema.fields if f.name != action]))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("bucket", bucket)
        touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # at most `buckets` rows
        changed = apply_changes(table.read(touched, number - 1), batch, key, time, action)
        table.commit(changed, {table.folder_of(v) for v in touched}, f"{number}", number - 1)
        table.vacuum()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


#: Bounds, target and factors of the adaptive batch size.
SMALLEST, LARGEST, START, TARGET_MS, SLACK = 10, 200, 50, 2000.0, 0.1


def next_batch(size: int, quick: int, response: float, target: float = TARGET_MS) -> tuple[int, int]:
    """(size, quick answers in a row) after an answer: a slow one shrinks by a fifth, a second quick one grows by a fifth."""
    if response > target * (1 + SLACK):
        return max(SMALLEST, int(size * 0.8)), 0
    if response < target * (1 - SLACK):
        return (min(LARGEST, int(size * 1.2)), 0) if quick >= 1 else (size, quick + 1)
    return size, 0


def adaptive_batches(stream: DataFrame, key: str, order: str, value: str, target: float = TARGET_MS) -> DataFrame:
    """(key, order, size): the batch size after each answer of a stream, kept as state for each key."""

    def update(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, quick = state.get if state.exists else (START, 0)
        for pdf in parts:
            pdf, sizes = pdf.sort_values(order), []
            for v in pdf[value]:
                size, quick = next_batch(size, quick, v, target)
                sizes.append(size)
            yield pd.DataFrame({"key": [k[0]] * len(pdf), "at": pdf[order].to_numpy(), "size": sizes})
        state.update((size, quick))

    picked = stream.select(key, order, value)
    return picked.groupBy(key).applyInPandasWithState(update, "key string, at long, size int", "size int, quick int", "append", GroupStateTimeout.NoTimeout)


def adaptive_sizes(df: DataFrame, key: str, order: str, value: str, target: float = TARGET_MS) -> DataFrame:
    """(key, answers, size): the batch size of each key after all its answers, over a finished table.

    The state depends on every answer before, so a key is one stream: rows are sorted within partitions by key and order
    and pass through one batch at a time; nothing of a key is held but its state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, size, quick, n = None, START, 0, 0
        for pdf in batches:
            out = []
            for k, v in zip(pdf["key"], pdf["value"]):
                if k != now:
                    if now is not None:
                        out.append((now, n, size))
                    now, size, quick, n = k, START, 0, 0
                size, quick = next_batch(size, quick, v, target)
                n += 1
            yield pd.DataFrame(out, columns=["key", "answers", "size"])
        if now is not None:
            yield pd.DataFrame([(now, n, size)], columns=["key", "answers", "size"])

    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).alias("at"), F.col(value).cast("double").alias("value"))
    return rows.repartition("key").sortWithinPartitions("key", "at").select("key", "value").mapInPandas(run, "key string, answers long, size int")
