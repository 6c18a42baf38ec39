"""Structured Streaming over append-only observation tables: tails, de-duplication, versions; ``states`` has items with removals.

``drain`` runs a stream until all files present are read and gives the result as a table. Checkpoints, results and states
lie in the folder of ``spark.checkpoint.dir``; a batch that is repeated after a failure overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import folder


def source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet file or folder at ``path``, at most ``files`` in a batch (None: all that are there).

    The path is given as a pattern: only so does a stream take a single file.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, at: str | None = None) -> DataFrame:
    """All rows that an append-mode stream gives for the files present, and gave before for those that a former call with the same folder ``at`` read."""
    spark = stream.sparkSession
    at = at or folder(spark)
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def tail(stream: DataFrame, key: str, after: int) -> DataFrame:
    """Rows whose id lies behind a cursor; the checkpoint replaces the cursor from then on."""
    return stream.where(F.col(key) > after)


def once_within(stream: DataFrame, keys: list[str], at: str, overlap: str = "3 days") -> DataFrame:
    """One row for each key although sources are read again with an overlap; later repeats than that are new rows.

    Spark starts a watermark at 1970: rows up to then count as late and go. Rows without time are kept.
    """
    return stream.withWatermark(at, overlap).dropDuplicatesWithinWatermark(keys)


ROWS, STATE = "event_id long, item long, version_no long, event string", "payload string, version_no long"


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The change events of one item in a batch; the state holds its payload and the number of its versions."""
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    payload, version = state.get if state.exists else (None, 0)
    out = []
    for event_id, new in zip(rows["event_id"], rows["payload"], strict=True):
        new = None if pd.isna(new) else new
        if version and new == payload:
            continue
        out.append((event_id, "updated" if version else "added", version + 1))
        payload, version = new, version + 1
    state.update((payload, version))
    if out:
        yield pd.DataFrame({"event_id": [o[0] for o in out], "item": pd.array([key[0]] * len(out), "Int64"), "version_no": [o[2] for o in out], "event": [o[1] for o in out]})


def change_stream(stream: DataFrame) -> DataFrame:
    """The change events of observations (event_id, ts, item, payload), as a stream with one keyed state for each item. Batches must come in the
    order of (ts, event_id) for each item; inside a batch any order will do. A null payload counts as a value of its own."""
    return stream.select("event_id", "ts", "item", "payload").groupBy("item").applyInPandasWithState(fold, ROWS, STATE, "append", GroupStateTimeout.NoTimeout)


def changes(stream: DataFrame) -> DataFrame:
    """The change events of a stream of observations, as a table."""
    return drain(change_stream(stream))


def say_end(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ended = state.exists
    for rows in batches:
        yield rows.assign(kind="line")[["run", "line", "kind"]]
        if rows["final"].any() and not ended:
            ended = True
            state.update((True,))
            yield pd.DataFrame({"run": [key[0]], "line": pd.array([None], "Int64"), "kind": ["end"]})


def tail_with_end(lines: DataFrame) -> DataFrame:
    """Lines (run, line, final) as they come, and one row of kind ``end`` for each run, once a line says that its status is final."""
    return lines.groupBy("run").applyInPandasWithState(say_end, "run long, line long, kind string", "ended boolean", "append", GroupStateTimeout.NoTimeout)
