"""Streams over files of rows: deduplication, queue state, counters, late rows."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from ..operators.tables import new_rows
from ..staging import drop, new_dir, numbered

#: State on disk, as keyed state of any size needs it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a folder of Parquet files, or over a single file: a pattern, unlike a path, need not be a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def ingest_dedup(rows: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first row of each key; state is dropped once the watermark passes."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def rates(rows: DataFrame, ts: str, by: list[str], width: str, slide: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Counts by window, tumbling or sliding; rows later than the watermark are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.withWatermark(ts, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def session_rates(rows: DataFrame, ts: str, by: list[str], gap: str, delay: str = "0 seconds") -> DataFrame:
    """Counts by session: runs of rows less than ``gap`` apart."""
    return rows.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def run_available(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over what is there and return what its sink holds; for ``complete`` and ``update`` modes each batch's rows with its number.

    With a ``folder`` of the caller's a later call goes on from where this one ended.
    """
    spark, base = stream.sparkSession, folder or new_dir(stream.sparkSession, "stream")
    sink = f"{base}/out"

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{sink}/part={batch}")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).start().awaitTermination()
    schema = stream.schema.add("batch", "integer")
    return spark.read.schema(schema).parquet(sink)


def complete(stream: DataFrame) -> DataFrame:
    """The last state of a stream run in complete mode."""
    out = run_available(stream, "complete")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").drop("batch")  # one row


def each_batch(stream: DataFrame, state: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """A table that ``step(state, batch)`` replaces for every batch.

    The state after batch n lies in ``folder`` under n + 1, so a batch that runs again starts from the same state, and
    a later call with the same ``folder`` goes on where this one ended; ``state`` is the start of the first call alone.
    The whole table is written for each batch, and states before the last but one are deleted: a step may change any
    row. ``queue_state`` is for state by key.
    """
    spark, base = stream.sparkSession, folder or new_dir(stream.sparkSession, "stream")
    schema, at = state.schema, f"{base}/state"
    state.write.mode("ignore").parquet(f"{at}/upto=0")

    def run(df: DataFrame, batch: int) -> None:
        before = spark.read.schema(schema).parquet(f"{at}/upto={batch}")
        step(before, df).write.mode("overwrite").parquet(f"{at}/upto={batch + 1}")
        for n in numbered(spark, at, "upto"):
            if n < batch:
                drop(spark, f"{at}/upto={n}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(run).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/upto={numbered(spark, at, 'upto')[-1]}")


def durable_ingest(rows: DataFrame, target: DataFrame, keys: list[str], order: str, folder: str | None = None) -> DataFrame:
    """``target`` and every new key of the stream, for good: each batch writes only what it adds, and a later call with the same ``folder`` goes on."""
    spark, base = rows.sparkSession, folder or new_dir(rows.sparkSession, "stream")
    at, schema = f"{base}/added", target.schema
    target.limit(0).write.mode("ignore").parquet(f"{at}/batch=-1")

    def added(before: int | None = None) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{at}/batch={n}" for n in numbered(spark, at, "batch") if before is None or n < before])

    def run(df: DataFrame, batch: int) -> None:
        known = target.unionByName(added(batch))
        new_rows(known, df, keys, [F.col(order)]).select(target.columns).write.mode("overwrite").parquet(f"{at}/batch={batch}")

    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(run).start().awaitTermination()
    return target.unionByName(added())


class _Progress(StreamingQueryListener):
    """What Spark reports of each batch of one query."""

    def __init__(self) -> None:
        self.batches: dict[int, tuple[int, int]] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def of(self, run: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        arrived = p.observedMetrics.get("arrived")
        self.batches[p.batchId] = (arrived["n"] if arrived else 0, sum(o.numRowsDroppedByWatermark for o in p.stateOperators))

    def onQueryTerminated(self, event) -> None:
        self.of(str(event.runId)).set()


def late_rows(rows: DataFrame, ts: str, width: str, delay: str = "0 seconds", folder: str | None = None) -> DataFrame:
    """(batch, arrived, counted, dropped_groups) of a stream that ``rates`` counts by tumbling windows.

    ``arrived`` is the rows with a time that a batch brought, ``counted`` how many of them ``rates`` took into its
    windows; the others were later than its watermark. ``dropped_groups`` is Spark's own count of what its state store
    refused, in rows after the sums that precede the shuffle. Nothing here knows the watermark. A later call with the
    same ``folder`` goes on where this one ended and adds its batches.
    """
    spark, base = rows.sparkSession, folder or new_dir(rows.sparkSession, "stream")
    sums, reports = f"{base}/sums", f"{base}/progress"
    arrived = rows.where(F.col(ts).isNotNull()).observe("arrived", F.count(F.lit(1)).alias("n"))
    stream = rates(arrived.withColumn("value", F.lit(0.0)), ts, [], width, delay=delay).select("start", "n")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{sums}/batch={batch}")

    progress = _Progress()
    spark.streams.addListener(progress)
    try:
        query = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).start()
        query.awaitTermination()
        if not progress.of(str(query.runId)).wait(60):
            raise TimeoutError("no report of the stream's end came")
    finally:
        spark.streams.removeListener(progress)
    if progress.batches:
        found = [(n, *x) for n, x in sorted(progress.batches.items())]
        spark.createDataFrame(found, "batch int, arrived long, dropped_groups long").write.mode("overwrite").parquet(f"{reports}/from={found[0][0]}")
    reported = spark.read.schema("batch int, arrived long, dropped_groups long").parquet(*[f"{reports}/from={n}" for n in numbered(spark, reports, "from")]) if numbered(spark, reports, "from") else spark.createDataFrame([], "batch int, arrived long, dropped_groups long")
    # a window's sum is written by each batch that adds to it: what a batch added is the difference to the one before
    written = spark.read.schema("start timestamp, n long, batch int").parquet(sums)
    before = F.lag("n", 1, 0).over(Window.partitionBy("start").orderBy("batch"))
    added = written.withColumn("added", F.col("n") - before).groupBy("batch").agg(F.sum("added").alias("counted"))
    return reported.join(added, "batch", "left").select("batch", "arrived", F.coalesce("counted", F.lit(0)).alias("counted"), "dropped_groups")


@contextmanager
def _on_disk(spark: SparkSession) -> Iterator[None]:
    """State stores on disk while a stream is started, and no batches without rows, of which timers would make one after the other."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Article(StatefulProcessor):
    """The queue row of one article: its status and attempts as value state, and a timer while it is PENDING."""

    def __init__(self, patience: int | None) -> None:
        self.patience = patience

    def init(self, handle) -> None:
        self.handle, self.row = handle, handle.getValueState("row", "status string, attempts int")

    def _wait(self, status: str, timers) -> None:
        if self.patience is not None and status == "PENDING":
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # the names are Spark's
        row = initialState.iloc[0]
        attempts = None if pd.isna(row["attempts"]) else int(row["attempts"])
        self.row.update((row["status"], attempts))
        self._wait(row["status"], timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stages = {s for part in rows for s in part["stage"]}
        if not self.row.exists():
            return
        status, attempts = self.row.get()
        after = "SCRAPED" if status == "PENDING" and "SCRAPED" in stages else "CLASSIFIED" if status == "SCRAPED" and "CLASSIFIED" in stages else status
        if after != status:
            self.row.update((after, attempts))
            for timer in list(self.handle.listTimers()) if self.patience is not None else []:
                self.handle.deleteTimer(timer)
            yield pd.DataFrame({"article_id": [key[0]], "status": [after], "change": ["MOVED"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, _ = self.row.get()
        self._wait(status, timerValues)
        yield pd.DataFrame({"article_id": [key[0]], "status": [status], "change": ["WAITING"]})

    def close(self) -> None: ...


def queue_changes(rows: DataFrame, queue: DataFrame, folder: str, patience: int | None = None) -> DataFrame:
    """(article_id, status, change, batch): what a stream of (article_id, stage) changes in the queue.

    The state of each article lies in a state store, keyed by its id, so a batch reads and writes the articles that it
    brings and no others, and only changes are written out. ``queue`` is the state that the first call starts from; a
    later call with the same ``folder`` goes on where the one before ended. An article that stays PENDING for
    ``patience`` milliseconds is reported as WAITING by the next batch, again and again. Articles that aren't queued are
    left alone.
    """
    spark, kind = rows.sparkSession, queue.schema["article_id"].dataType.simpleString()
    start = queue.select("article_id", "status", F.col("attempts").cast("int").alias("attempts")).where("article_id IS NOT NULL").groupBy("article_id")
    with _on_disk(spark):
        changes = rows.select("article_id", "stage").where("article_id IS NOT NULL").groupBy("article_id").transformWithStateInPandas(
            statefulProcessor=_Article(patience), outputStructType=f"article_id {kind}, status string, change string", outputMode="Update", timeMode="None" if patience is None else "ProcessingTime", initialState=start)

        def write(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

        changes.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).start().awaitTermination()
    return spark.read.schema(f"article_id {kind}, status string, change string, batch int").parquet(f"{folder}/changes")


def queue_state(rows: DataFrame, queue: DataFrame, folder: str | None = None) -> DataFrame:
    """The queue after a stream of (article_id, stage) with stages SCRAPED and CLASSIFIED; a batch moves an article by one step."""
    moved = queue_changes(rows, queue, folder or new_dir(rows.sparkSession, "stream")).where("change = 'MOVED'")
    last = moved.groupBy("article_id").agg(F.max_by("status", "batch").alias("__status"))
    return queue.join(last, "article_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")


def new_vs_baseline(rows: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """A stream-static join: new rows with the baseline rows of the same key."""
    return rows.join(baseline, key)
