"""Work that depends on order: durable cuts of lineage and folds over the rows of a key."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix=f"signal-engine-{uuid.uuid4().hex[:6]}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset an own one, in local runs only."""
    if where := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's checkpoint folder (an own one where none is set)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fold_in_order(df: DataFrame, key: str, order: Sequence[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, object]], column: str, kind: str, keep: Sequence[str]) -> DataFrame:
    """Rows of each key in order through step(state, row) -> (state, value): the columns in keep, and the values as
    ``column``. Rows stream through sorted partitions, so that a task holds one batch and one key's state, however
    many rows the key has; a key's own rows are one sequence by definition. A null key is a key."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{column}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            values = []
            for row in batch.to_pylist():
                if held is None or held[0] != row[key]:
                    held, state = (row[key],), start()
                state, value = step(state, row)
                values.append(value)
            kept = batch.select(list(keep))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(values, {"boolean": pa.bool_(), "string": pa.string(), "bigint": pa.int64()}[kind])], names=[*keep, column])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
