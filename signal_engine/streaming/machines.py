"""Keyed state over event streams: a state machine driven by a transition table, calls with a time to live, late rows
beside those on time, change feeds and joins of two streams.

State lives in the session's state store (RocksDB, which arbitrary state needs); a batch that is run again after a
failure starts from the state of the batch before it and replaces what it wrote (see ``feeds.run_to_table``). Rows of
a key are handled in the order of their batches, inside a batch by time and id.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CALL_BUCKETS = 1 << 14  # calls whose state is read and written together
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


@dataclass(frozen=True)
class Machine:
    """States and their allowed transitions.

    transitions: (state, event) -> next state. timeouts: state -> (seconds of event time, next state), for items that
    stay so long without a transition. terminal: states that refuse every event.
    """

    initial: str
    transitions: Mapping[tuple[str, str], str]
    timeouts: Mapping[str, tuple[int, str]] = field(default_factory=dict)
    terminal: frozenset[str] = frozenset()

    def __post_init__(self):
        if bad := [s for s, _ in self.transitions if s in self.terminal] + [s for s in self.timeouts if s in self.terminal]:
            raise ValueError(f"terminal states with a way out: {sorted(set(bad))}")
        if any(seconds <= 0 for seconds, _ in self.timeouts.values()):
            raise ValueError("a timeout takes more than 0 seconds")

    def move(self, state: str, event: str | None) -> tuple[str, str, str | None]:
        """(next state, status, error) of an event in a state."""
        if state in self.terminal:
            return state, "invalid", "terminal_state"
        if (state, event) in self.transitions:
            return self.transitions[state, event], "completed", None
        known = any(event == e for _, e in self.transitions)
        return state, "invalid", "forbidden_transition" if known else "unknown_event"

    def table(self, spark: SparkSession) -> DataFrame:
        """The transition matrix: (from_state, event, to_state, terminal)."""
        rows = [(s, e, t, t in self.terminal) for (s, e), t in self.transitions.items()] + [(s, None, t, t in self.terminal) for s, (_, t) in self.timeouts.items()]
        return spark.createDataFrame(rows, "from_state string, event string, to_state string, terminal boolean")


class _MachineProcessor(StatefulProcessor):
    """Per key: the state, when it was entered, and the ids handled that may come again. Each call to the state store
    is a message to the JVM, so a key's batch makes a fixed number of them, however many rows it has."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, since long")
        self.seen = handle.getListState("seen", "id long, at long")

    def _due(self, state: str, since: int) -> int | None:
        """Microseconds at which the state ends by itself."""
        return since + self.machine.timeouts[state][0] * 1_000_000 if state in self.machine.timeouts else None

    def _expire(self, key, state: str, since: int, until: int) -> Iterator[tuple[Row, str, int]]:
        """Timeouts up to ``until``, each with the state and time after it."""
        while (due := self._due(state, since)) is not None and due <= until:
            after = self.machine.timeouts[state][1]
            yield self._row(key, None, state, after, "timed_out", None, due), after, due
            state, since = after, due

    @staticmethod
    def _row(key, event_id, before, after, status, error, at) -> Row:
        return Row(key=key[0], event_id=event_id, from_state=before, to_state=after, status=status, error=error, at=at)

    @staticmethod
    def _timer(due: int) -> int:
        return due // 1000 + 1  # milliseconds, not before it is due

    def _enter(self, old: tuple[str, int] | None, state: str, since: int, fired: int | None = None) -> None:
        """Keep the state, with the timer of its end in place of the old state's one."""
        if old == (state, since):
            return
        before, after = (None if x is None else self._due(*x) for x in (old, (state, since)))
        if before is not None and self._timer(before) != fired:
            self.handle.deleteTimer(self._timer(before))
        self.now.update((state, since))
        if after is not None:
            self.handle.registerTimer(self._timer(after))

    def handleInputRows(self, key, rows, timerValues):
        old = self.now.get()
        state, since = old = tuple(old) if old is not None else (self.machine.initial, None)
        gone = timerValues.getCurrentWatermarkInMs() * 1000
        known = {i: at for i, at in self.seen.get()}
        kept = {i: at for i, at in known.items() if at >= gone}  # rows behind the watermark are not given to a key again
        new = {}
        for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            if r["event_id"] in kept or r["event_id"] in new:
                continue  # a replay
            new[r["event_id"]] = r["at"]
            if since is not None:
                for row, state, since in self._expire(key, state, since, r["at"]):
                    yield row
            after, status, error = self.machine.move(state, r["event"])
            yield self._row(key, r["event_id"], state, after, status, error, r["at"])
            if status == "completed":
                state, since = after, r["at"]
        if len(kept) < len(known):
            self.seen.put([*kept.items(), *new.items()]) if kept or new else self.seen.clear()
        elif new:
            self.seen.appendList(list(new.items()))
        if since is not None:
            self._enter(None if old[1] is None else old, state, since)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = self.now.get()
        if old is not None:
            state, since = old = tuple(old)
            at = expiredTimerInfo.getExpiryTimeInMs()
            for row, state, since in self._expire(key, state, since, at * 1000):
                yield row
            self._enter(old, state, since, at)

    def close(self) -> None:
        pass


def run_machine(events: DataFrame, machine: Machine, key: str, event_id: str, event: str, time: str, late: str = "1 hour") -> DataFrame:
    """The state outputs of a stream: (key, event_id, from_state, to_state, status, error, at, transition_key). A
    transition is ``completed``; a refused event ``invalid``, with the reason, and leaves the state as it is; a state
    that ends by itself ``timed_out``, when an event or the watermark passes its time. A replayed event id gives
    nothing. transition_key is the same whenever a transition is computed again, for idempotent sinks."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(time, late).select(F.col(key).alias("key"), F.col(event_id).cast("long").alias("event_id"), F.col(event).cast("string").alias("event"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(time).alias("_time"))
    out = rows.groupBy("key").transformWithState(_MachineProcessor(machine), f"key {kind}, event_id long, from_state string, to_state string, status string, error string, at long", "Append", "EventTime")
    number = F.coalesce(F.col("event_id").cast("string"), F.concat(F.lit("timeout:"), F.col("at").cast("string")))
    return out.withColumn("transition_key", F.sha2(F.concat_ws("\n", F.col("key").cast("string"), number), 256)).withColumn("at", F.timestamp_micros("at")).withColumnRenamed("key", key)


def handoffs(outputs: DataFrame, machine: Machine) -> DataFrame:
    """The next state's inputs: completed and timed-out transitions into states that are not terminal, by
    transition_key."""
    return outputs.where(F.col("status").isin("completed", "timed_out") & ~F.col("to_state").isin(*machine.terminal, "")).withColumnRenamed("to_state", "state").drop("from_state", "status", "error")


class _TtlProcessor(StatefulProcessor):
    """Per bucket of calls: when each was last run, and the milliseconds from which it is stale. The bucket's calls are
    read and written together, as each message to the state store costs as much as many rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "key string, at long, stale long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues):
        low = timerValues.getCurrentWatermarkInMs()
        runs = {call: (at, stale) for call, at, stale in self.last.get()}
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
            last, ttl = runs[r["key"]][0] if r["key"] in runs else None, r["ttl"]
            fresh = last is not None and (ttl is None or r["at"] - last < ttl * 1_000_000)
            if not fresh:
                last = r["at"]
            runs[r["key"]] = last, None if ttl is None else (last + max(ttl, 0) * 1_000_000) // 1000 + 1
            yield Row(id=r["id"], action="reuse" if fresh else "run", ran_at=last)
        self._keep(runs, low)

    def _keep(self, runs, low: int, fired: int | None = None) -> None:
        """Keep what is not stale, with a timer at which more of it will be."""
        left = [(call, at, stale) for call, (at, stale) in runs.items() if stale is None or stale > low]
        self.last.put(left) if left else self.last.clear()
        old = self.timer.get()
        before, after = None if old is None else old[0], max((stale for *_, stale in left if stale is not None), default=None)
        if before == after:
            return
        if before is not None and before != fired:
            self.handle.deleteTimer(before)
        if after is None:
            self.timer.clear()
        else:
            self.timer.update((after,))
            self.handle.registerTimer(after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # rows behind the watermark are not given to a key again, so stale calls run whenever they come
        self._keep({call: (at, stale) for call, at, stale in self.last.get()}, expiredTimerInfo.getExpiryTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def close(self) -> None:
        pass


def calls_with_ttl(calls: DataFrame, call: Sequence[str], request: str, time: str, stale_after: Column, late: str = "1 hour") -> DataFrame:
    """(request, action, ran_at) of a stream of requests: ``reuse`` while the call's last run is younger than the
    request's ``stale_after`` seconds (0: always run, null: never stale), else ``run``. Requests of a call have one
    stale_after. A call's state is dropped once the watermark says that it is stale and its bucket is read, at the latest
    when all of the bucket's calls are stale; that of a call that never gets stale is kept for good, as its receipt is."""
    key = F.sha2(F.to_json(F.struct(*call), {"ignoreNullFields": "false"}), 256)
    rows = calls.withWatermark(time, late).select(key.alias("key"), F.col(request).cast("long").alias("id"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), stale_after.cast("long").alias("ttl"), F.col(time).alias("_time"))
    out = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(CALL_BUCKETS))).groupBy("bucket").transformWithState(_TtlProcessor(), "id long, action string, ran_at long", "Append", "EventTime")
    return out.select(F.col("id").alias(request), "action", F.timestamp_micros("ran_at").alias("ran_at"))


def part_late_rows(events: DataFrame, time: str, delay: str, root: str, checkpoint: str) -> None:
    """Run over what is there into two tables, ``root/on_time`` and ``root/late``, together every row once as it came.

    A row is late if it is older than the greatest time of earlier batches less the delay. The greatest times are kept
    in ``root/marks``, one row a batch; a batch that is run again reads only those of earlier batches and replaces what
    it wrote, so it parts its rows as before. A null time is on time."""

    def handle(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        marks = spark.read.schema("high timestamp, batch long").parquet(f"{root}/marks").where(F.col("batch") < batch)
        # one row
        parted = rows.join(F.broadcast(marks.agg((F.max("high") - F.expr(f"INTERVAL {delay}")).alias("_low"))), F.lit(True), "left")
        is_late = F.coalesce(F.col(time).cast("timestamp") < F.col("_low"), F.lit(False))
        for name, keep in (("on_time", ~is_late), ("late", is_late)):
            parted.where(keep).drop("_low").write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
        rows.agg(F.max(F.col(time).cast("timestamp")).alias("high")).write.mode("overwrite").parquet(f"{root}/marks/batch={batch}")

    spark = events.sparkSession
    for name, schema in (("on_time", events.schema), ("late", events.schema), ("marks", "high timestamp")):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}/batch=-1")
    events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()


def change_feed(versions: DataFrame, key: str, number: str, values: Sequence[str], deleted: Column) -> DataFrame:
    """(key, number, operation, before, after) from numbered versions of rows (1, 2, ... without gaps): INSERT, UPDATE or DELETE with the
    images before and after; versions that change nothing give no row. Each version meets the one before it by (key,
    number), so that a key with many versions is spread over all tasks."""
    image = F.struct(*[F.col(c) for c in values])
    shaped = versions.select(F.col(key), F.col(number), F.when(~deleted, image).alias("after"))
    before = shaped.select(F.col(key), (F.col(number) + 1).alias(number), F.col("after").alias("before"))
    both = shaped.join(before, [key, number], "left")
    operation = F.when(F.col("before").isNull() & F.col("after").isNotNull(), "INSERT").when(F.col("before").isNotNull() & F.col("after").isNull(), "DELETE").when(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("after")), "UPDATE")
    return both.select(key, number, operation.alias("operation"), "before", "after").where(F.col("operation").isNotNull())


def listen(changes: DataFrame, operations: Sequence[str], before: Mapping[str, Mapping[str, object]] | None = None, after: Mapping[str, Mapping[str, object]] | None = None) -> DataFrame:
    """Changes of the given operations whose images pass the listener's predicates; works on tables and streams. A
    predicate on an image that the operation lacks (before of INSERT, after of DELETE) does not hold."""
    from signal_engine.operators.enrichment import listener

    if unknown := set(operations) - {"INSERT", "UPDATE", "DELETE"}:
        raise ValueError(f"unknown operations: {sorted(unknown)}")
    keep = F.col("operation").isin(*operations)
    for image, predicates in (("before", before), ("after", after)):
        if predicates:
            keep = keep & F.col(image).isNotNull() & listener({f"{image}.{c}": tests for c, tests in predicates.items()})
    return changes.where(keep)


def followed_by(first: DataFrame, then: DataFrame, key: str, time: str, within: str, late: str = "1 hour") -> DataFrame:
    """Each row of a stream with the rows of a second one of the same key within an interval after it; without any,
    once with nulls, when both watermarks say that none can come. Both sides' state is dropped behind the watermarks.
    The second side's columns, all but the key, get the prefix ``then_``."""
    left = first.withWatermark(time, late)
    renamed = then.withWatermark(time, late).select(*[F.col(c).alias(f"then_{c}") for c in then.columns])
    near = (F.col(key) == F.col(f"then_{key}")) & (F.col(f"then_{time}") >= F.col(time)) & (F.col(f"then_{time}") <= F.col(time) + F.expr(f"INTERVAL {within}"))
    return left.join(renamed, near, "leftOuter").drop(f"then_{key}")


def sliding(events: DataFrame, time: str, width: str, slide: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Counts by windows of a width that begin every ``slide``; an event lies in several of them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), *keys).count()
