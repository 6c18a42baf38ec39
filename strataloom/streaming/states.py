"""The state of items over time as a stream: versions, removals by absence and recoveries in one stateful processor.

Input rows are sightings (platform, item, run, at, event_id, payload) and, with a null item, the end of a complete run (platform, run).
They are grouped by (platform, shard): an item has one shard by hash, and a run's end goes to all shards of its platform, so a platform with
a large share of all rows is many groups. For each group four states are kept:

* ``items`` (map): payload, version, last run, the bucket it waits in, and whether it is gone;
* ``waiting`` (map from bucket and part): the items last seen when that number of complete runs had ended, one part for each batch;
* ``parts`` (map from bucket): how many parts it has, and the run whose end closed it;
* ``ended`` (value): how many complete runs have ended, and which was the last.

A run's end looks only at the two buckets whose items may have been missed ``limit`` times just now, and drops the older one: each
sighting is put into one bucket and looked at twice. So the cost of a batch follows its own rows and the items that are due, not all items ever seen,
and no table is rewritten. An item is due if it is still in the bucket (any sighting moves it on).

Batches come in the order of runs; inside a batch any order will do. A repeated end of a run counts once. A null payload is a
value of its own. With state rows encoded in Avro (``rocks``) later versions of the processor may add fields to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "platform long, item string, run long, at timestamp, event_id long, event string, version_no long, payload string"
PROVIDER, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FORMAT = "spark.sql.streaming.stateStore.encodingFormat"


@contextmanager
def rocks(spark: SparkSession, evolving: bool = True):
    """The state store that several states for a key need, set while a query starts and runs, and put back afterwards. ``evolving``: state rows
    whose schema may grow (Avro), which Spark has only for queries without a second kind of state behind the processor."""
    settings = {PROVIDER: STORE} | ({FORMAT: "avro"} if evolving else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ItemStates(StatefulProcessor):
    """Folds the rows of one (platform, shard) into change events."""

    ENDED = "n long, run long"

    def __init__(self, limit: int = 3):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item string", "payload string, version long, run long, bucket long, gone boolean")
        self.waiting = handle.getMapState("waiting", "bucket long, part long", "items array<string>")
        self.parts = handle.getMapState("parts", "bucket long", "parts long, closed long")
        self.ended = handle.getValueState("ended", self.ENDED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        frame = frame.assign(end=frame["item"].isna()).sort_values(["run", "end", "at", "event_id"], kind="stable")
        n, last = self.ended.get()[:2] if self.ended.exists() else (0, None)
        held: dict[str, list] = {}  # payload, version, run, bucket, gone of the items of this batch
        moved: dict[int, list[str]] = {}
        out = []

        def state(item: str) -> list | None:
            if item not in held:
                found = self.items.getValue((item,)) if self.items.containsKey((item,)) else None
                held[item] = list(found) if found else None
            return held[item]

        for r in frame.itertuples(index=False):
            run = int(r.run)
            if r.end:
                if last is not None and run <= last:
                    continue
                self.put_by(moved)
                n, last = n + 1, run
                parts, _ = self.part(n - 1)
                self.parts.updateValue((n - 1,), (parts, run))  # bucket n - 1 was closed by this run's end
                for item in self.due(n, state):
                    s = held[item]
                    s[4] = True
                    out.append((r.platform, item, run, pd.NaT, None, "removed", s[1], s[0]))
                continue
            payload = None if pd.isna(r.payload) else r.payload
            s = state(r.item)
            fresh = s is None or s[0] != payload
            event = "added" if s is None else "recovered" if s[4] else "updated" if fresh else None
            version = (s[1] if s else 0) + fresh
            if event:
                out.append((r.platform, r.item, run, r.at, int(r.event_id), event, version, payload))
            if s is None or s[3] != n or s[4]:
                moved.setdefault(n, []).append(r.item)
            held[r.item] = [payload, version, run, n, False]
        self.put_by(moved)
        for item, s in held.items():
            if s is not None:
                self.items.updateValue((item,), tuple(s))
        if n:
            self.ended.update(self.told(n, last))
        if out:
            names = [c.split()[0] for c in EVENTS.split(", ")]
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"event_id": "Int64"}).assign(at=pd.to_datetime(frame["at"]))

    def told(self, n: int, run: int) -> tuple:
        """The row of ``ended``; a later version may have more in it."""
        return n, run

    def part(self, bucket: int) -> tuple[int, int | None]:
        return self.parts.getValue((bucket,)) if self.parts.containsKey((bucket,)) else (0, None)

    def put_by(self, moved: dict[int, list[str]]) -> None:
        """Writes what this batch put into buckets, a part for each."""
        for bucket, items in moved.items():
            parts, closed = self.part(bucket)
            self.waiting.updateValue((bucket, parts), (items,))
            self.parts.updateValue((bucket,), (parts + 1, closed))
        moved.clear()

    def due(self, n: int, state) -> list[str]:
        """Items missed by exactly ``limit`` complete runs when the n-th has ended. An item in bucket b was seen when b runs had ended; if the run it
        was seen in has closed the bucket itself, it has missed n - b - 1 runs, else n - b."""
        out = []
        for bucket, own in ((n - self.limit, False), (n - self.limit - 1, True)):
            if bucket < 0:
                continue
            parts, closed = self.part(bucket)
            for k in range(parts):
                for item in self.waiting.getValue((bucket, k))[0]:
                    s = state(item)
                    if s[3] == bucket and not s[4] and (s[2] >= closed) == own:
                        out.append(item)
                if own:
                    self.waiting.removeKey((bucket, k))
            if own and self.parts.containsKey((bucket,)):
                self.parts.removeKey((bucket,))
        return list(dict.fromkeys(out))

    def close(self) -> None:
        pass


def item_events(rows: DataFrame, limit: int = 3, shards: int = 16, processor: StatefulProcessor | None = None) -> DataFrame:
    """The change events (added, updated, recovered, removed) of a stream of sightings and ends of runs; see above. ``at`` carries the watermark of ``rows`` on, so
    that windows may follow; removals have none. Start the query inside ``rocks``."""
    own = F.when(F.col("item").isNull(), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int")))
    dealt = rows.select("platform", "item", "run", "at", "event_id", "payload", F.explode(own).alias("shard"))
    return dealt.groupBy("platform", "shard").transformWithStateInPandas(processor or ItemStates(limit), EVENTS, "append", "none")


class Seen(StatefulProcessor):
    """Added and updated sightings of one shard of items, with their times, for windows behind it. A row without an item only moves the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item string", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        frame = frame[frame["item"].notna()].sort_values(["at", "event_id"], kind="stable")
        held: dict[str, tuple | None] = {}
        at, event = [], []
        for r in frame.itertuples(index=False):
            payload = None if pd.isna(r.payload) else r.payload
            if r.item not in held:
                held[r.item] = self.items.getValue((r.item,)) if self.items.containsKey((r.item,)) else None
            before = held[r.item]
            if before is None or before[0] != payload:
                at.append(r.at)
                event.append("added" if before is None else "updated")
                held[r.item] = (payload,)
        for item, value in held.items():
            self.items.updateValue((item,), value)
        if at:
            yield pd.DataFrame({"at": at, "event": event})

    def close(self) -> None:
        pass


def trailing_day(rows: DataFrame, late: str = "1 day", shards: int = 16) -> DataFrame:
    """(until, added, updated): changes of the 24 hours before each full hour, from a stream of sightings (item, at, event_id, payload), in append mode: the
    version state of each item and, behind it, sliding windows, both under one watermark. A window is given out once no row can change it
    any more, and leaves the state then: the state of the windows holds what the last day and ``late`` have, however long the stream runs. A worker holds
    one shard's rows of a batch at a time; a row of null item at the end of a log closes the windows that are open."""
    dealt = rows.withWatermark("at", late).select("item", "at", "event_id", "payload", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard"))
    changes = dealt.groupBy("shard").transformWithStateInPandas(Seen(), "at timestamp, event string", "append", "EventTime", eventTimeColumnName="at")
    kind = lambda e: F.count_if(F.col("event") == e)
    out = changes.groupBy(F.window("at", "24 hours", "1 hour").alias("w")).agg(kind("added").alias("added"), kind("updated").alias("updated"))
    return out.select(F.col("w.end").alias("until"), "added", "updated")
