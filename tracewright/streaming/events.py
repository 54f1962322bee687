"""Streams of events: windowed counts, pipeline events by topic, first-write-wins state, new blobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewright.session import ship
from tracewright.sources.files import file_system, scratch

#: Topics of pipeline control events (fixed values).
TOPICS = ("pipeline.stage.completed", "pipeline.stage.failed", "pipeline.snapshot.ready")


def window_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """events(ts timestamp, event_type, value) -> counts and sums by window and type."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a file stream."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    fs, place, _ = file_system(spark, path)
    rows = reader.parquet(path) if fs.isDirectory(place) else reader.option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stream over what is there into a table of the shared folder, and reads that. Each batch
    writes the windows that it changed, open ones too; the last version of a window counts. No event is
    late here, in whatever order the files come."""
    out = f"{scratch(spark)}/windows-{uuid.uuid4().hex}"
    rows = window_counts(event_stream(spark, f"{sf_dir}/events.parquet"), "1 day", late="36500 days")

    def batch(changed: DataFrame, number: int) -> None:
        changed.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/{number:09d}")

    stream = rows.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    written = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, batch int").option("recursiveFileLookup", "true").parquet(f"{out}/data")
    return written.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("last")).select("start", "event_type", "last.n", "last.total")


def dispatch(events: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str):
    """Starts a stream of (topic, payload); each batch's rows go to the handler of their topic."""

    def batch(rows: DataFrame, _: int) -> None:
        rows.persist()
        for topic, handle in handlers.items():
            handle(rows.where(F.col("topic") == topic))
        rows.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def envelope(rows: DataFrame, source: str = "tracewright") -> DataFrame:
    """(topic, payload) -> CloudEvents-like JSON in `value`; the id is a hash of the content."""
    body = F.struct(F.lit("1.0").alias("specversion"), F.col("topic").alias("type"), F.lit(source).alias("source"), F.sha2(F.concat_ws("|", "topic", "payload"), 256).alias("id"), F.lit("application/json").alias("datacontenttype"), F.col("payload").alias("data"))
    return rows.select(F.to_json(body).alias("value"))


def new_blobs(blobs: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream's blobs (etag, seen_at timestamp, ...), each etag once while it is remembered."""
    return blobs.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["etag"])


class FirstWrite(StatefulProcessor):
    """Keeps the first value written under a key; a delete clears it, so the next write holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for op, value in zip(batch["op"], batch["value"], strict=True):
                if op == "delete":
                    self.value.clear()
                elif not self.value.exists():
                    self.value.update((value,))
        now = self.value.get()[0] if self.value.exists() else None
        yield pd.DataFrame({"key": [key[0]], "value": [now]})

    def close(self) -> None:
        pass


def keyed_state(writes: DataFrame) -> DataFrame:
    """A stream of (key, op: put or delete, value) -> the key's value after each batch. Needs the
    RocksDB state store."""
    ship(writes.sparkSession)
    return writes.groupBy("key").transformWithStateInPandas(FirstWrite(), "key string, value string", "Update", "None")


class OnlineTemplates(StatefulProcessor):
    """Drain clusters of one bucket, kept over batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clusters = handle.getListState("clusters", "template string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        from tracewright.operators.drain import SIMILAR, similarity

        known = [t[0] for t in self.clusters.get()] if self.clusters.exists() else []
        out = []
        for batch in rows:
            for tokens in batch["tokens"]:
                tokens = list(tokens)
                hit = next((t for t in known if similarity(t.split(" "), tokens) >= SIMILAR), None)
                if hit is None:
                    hit = " ".join(tokens)
                    known.append(hit)
                    self.clusters.appendValue((hit,))
                out.append((" ".join(tokens), hit))
        yield pd.DataFrame(out, columns=["message", "template"])

    def close(self) -> None:
        pass


def online_templates(messages: DataFrame, depth: int = 4) -> DataFrame:
    """A stream of messages -> (message masked, template), with a state for each bucket."""
    from tracewright.functions import text

    ship(messages.sparkSession)
    rows = messages.select(text.masked_tokens(F.col("message")).alias("tokens")).where("tokens is not null")
    return rows.withColumn("bucket", F.to_json(F.slice("tokens", 1, depth))).groupBy("bucket").transformWithStateInPandas(OnlineTemplates(), "message string, template string", "Append", "None")
