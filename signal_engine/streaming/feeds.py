"""Event feeds on Structured Streaming: listeners, net-new admission, windows, and an outbox state machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_feed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A feed of Parquet files; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def net_new(events: DataFrame, key: str, time: str, late: str | None = "1 day") -> DataFrame:
    """Unseen keys only. With a lateness bound the state is dropped behind the watermark; with None it is kept."""
    return events.dropDuplicates([key]) if late is None else events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def net_new_table(events: DataFrame, key: str, path: str, checkpoint: str) -> DataFrame:
    """Run over what is there and return the table of keys ever seen, each once. The table itself is what is known: a
    batch adds the keys that no earlier batch has, so nothing grows in memory, and a batch that comes again replaces
    what it wrote."""
    spark = events.sparkSession
    schema = events.select(key).schema

    def admit(rows: DataFrame, batch: int) -> None:
        known = spark.read.schema(f"{schema[0].simpleString().replace(':', ' ')}, batch_number long").parquet(path).where(F.col("batch_number") < batch)
        new = rows.select(key).distinct()
        new.join(known.withColumnRenamed(key, "_known"), F.col(key).eqNullSafe(F.col("_known")), "left_anti").write.mode("overwrite").parquet(f"{path}/batch_number={batch}")

    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch_number=-1")
    events.select(key).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(admit).start().awaitTermination()
    return spark.read.schema(schema).parquet(path).select(key)


def tumbling(events: DataFrame, time: str, width: str, *keys: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).count()


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).count()


def stream_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str) -> DataFrame:
    """Right events of the same key within an interval after the left one; both sides have watermarks."""
    return left.join(right, (left[key] == right[key]) & (right[right_time] >= left[left_time]) & (right[right_time] <= left[left_time] + F.expr(f"INTERVAL {within}")))


def fan_out(events: DataFrame, listeners: Mapping[str, tuple[Column, Callable[[DataFrame, int], None]]], checkpoint: str):
    """One stream to many listeners: each micro-batch is persisted once and filtered per listener. Handlers must be
    idempotent by (batch id, key), as a batch can come again after a failure."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for condition, action in listeners.values():
            action(batch.where(condition), batch_id)
        batch.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle)


def run_to_table(df: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Run over what is there into a Parquet table and return it. A batch writes its own folder, so one that is run
    again after a failure replaces what it wrote; in complete mode each batch replaces the table."""
    if mode not in ("append", "complete"):
        raise ValueError(f"no table of mode {mode}")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_number={batch if mode == 'append' else 0}")

    spark, names = df.sparkSession, df.columns
    spark.createDataFrame([], df.schema).write.mode("ignore").parquet(f"{path}/batch_number=-1")
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path).select(*names)


OUTBOX = "key string, state string, at timestamp"


def outbox(events: DataFrame, key: str, time: str, event: str, ttl_ms: int = 3_600_000) -> DataFrame:
    """Stateful outbox: ready -> dispatching -> sent; other transitions are refused; a dispatch without an end
    within the ttl of event time becomes needs_reconciliation."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    allowed = {(None, "ready"), ("ready", "dispatching"), ("dispatching", "sent"), ("needs_reconciliation", "sent")}

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.update(("needs_reconciliation",))
            yield pd.DataFrame({"key": [k[0]], "state": ["needs_reconciliation"], "at": [pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")]})
            return
        last = None
        for rows in frames:
            for r in rows.sort_values(time).itertuples():
                if (now, getattr(r, event)) in allowed:
                    now, last = getattr(r, event), getattr(r, time)
        if last is not None:
            state.update((now,))
            if now == "dispatching":
                state.setTimeoutTimestamp(max(int(pd.Timestamp(last).timestamp() * 1000) + ttl_ms, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({"key": [k[0]], "state": [now], "at": [last]})

    grouped = events.withWatermark(time, "1 hour").groupBy(key)
    return grouped.applyInPandasWithState(step, OUTBOX, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def ready_events(df: DataFrame, tolerance_s: int, now: Column) -> DataFrame:
    """Webhook rows whose signed time lies within the tolerance."""
    return df.where(F.abs(F.unix_seconds(now) - F.unix_seconds(F.col("sent_at").cast("timestamp"))) <= tolerance_s)


def isolate_errors(df: DataFrame, column: str, tried: Column, message: Column, fail: bool = False) -> DataFrame:
    """A computed column with the row's error beside it, or failing the query."""
    bad = tried.isNull() & message.isNotNull()
    value = F.when(bad, F.raise_error(message).cast("string")).otherwise(tried) if fail else tried
    return df.withColumn(column, value).withColumn("_error", F.when(bad, message))
