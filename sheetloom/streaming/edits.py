"""Annotation sessions as a stateful stream: clicks wait for their number, confirmed ones become rows, and rows are undone and deleted.

The state of a sheet is kept by row and by pages of the undo stack, so an event touches a few entries, however many rows the sheet has and however often one was put. It survives
restarts with the stream's checkpoint, and an event at or below the last one applied is a repeat and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ranks import best

EVENT = "map_num string, seq long, op string, id long, x double, y double"
ROW = "map_num string, id long, at long, seq long, x double, y double, alive boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PAGE, PAGES = 256, 64  # rows of a page of the undo stack; pages held at a time
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Entries:
    """A map of the state, with what a batch reads and writes kept until its end."""

    def __init__(self, state):
        self.state, self.own, self.changed = state, {}, set()

    def get(self, key: int):
        if key not in self.own:
            self.own[key] = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
        return self.own[key]

    def put(self, key: int, value) -> None:
        self.own[key] = value
        self.changed.add(key)

    def flush(self) -> None:
        for key in self.changed:
            if (value := self.own[key]) is not None:
                self.state.updateValue((key,), value)
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))


class _Stack:
    """The rows put by depth: [id, seq, x, y, depth of the row of the same id below or None], in pages of the state. Some are held at a time."""

    def __init__(self, state):
        self.state, self.pages, self.changed = state, {}, set()

    def page(self, n: int) -> list:
        if n not in self.pages:
            if len(self.pages) >= PAGES:
                self.flush()
            self.pages[n] = json.loads(self.state.getValue((n,))[0]) if self.state.containsKey((n,)) else []
        return self.pages[n]

    def get(self, depth: int) -> list:
        return self.page(depth // PAGE)[depth % PAGE]

    def put(self, depth: int, row: list) -> None:
        """``row`` becomes the top; what undone rows have left above goes."""
        rows = self.page(depth // PAGE)
        del rows[depth % PAGE :]
        rows.append(row)
        self.changed.add(depth // PAGE)

    def flush(self) -> None:
        for n in self.changed:
            self.state.updateValue((n,), (json.dumps(self.pages[n]),))
        self.pages, self.changed = {}, set()


class EditSession(StatefulProcessor):
    """click puts a pending place, cancel takes it back, confirm makes it the row ``id``; add puts a row at once, undo takes the last row put back, delete takes the row ``id`` away.

    A confirm without a pending place and an undo without a row do nothing. A row that is put again stands over the one before, which comes back if the
    later one is undone; a delete holds for what was put before it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", "seq long, depth long")
        self.pending = handle.getValueState("pending", "x double, y double")
        self.stack = handle.getMapState("stack", "page long", "rows string")
        self.standing = handle.getMapState("standing", "id long", "depth long")
        self.deleted = handle.getMapState("deleted", "id long", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        last, depth = self.position.get() if self.position.exists() else (None, 0)
        place = self.pending.get() if self.pending.exists() else None
        stack, standing, deleted = _Stack(self.stack), _Entries(self.standing), _Entries(self.deleted)
        touched: dict[int, int] = {}

        for r in events.itertuples(index=False):
            if pd.isna(r.seq) or last is not None and r.seq <= last:
                continue
            last, k = int(r.seq), None if pd.isna(r.id) else int(r.id)
            if r.op == "click":
                place = (float(r.x), float(r.y))
            elif r.op == "cancel":
                place = None
            elif k is not None and (r.op == "add" or r.op == "confirm" and place is not None):
                x, y = place if r.op == "confirm" else (None if pd.isna(r.x) else float(r.x), None if pd.isna(r.y) else float(r.y))
                place = None if r.op == "confirm" else place
                below = standing.get(k)
                stack.put(depth, [k, last, x, y, below and below[0]])
                standing.put(k, (depth,))
                depth, touched[k] = depth + 1, last
            elif r.op == "undo" and depth:
                depth -= 1
                k, *_, below = stack.get(depth)
                standing.put(k, None if below is None else (below,))
                touched[k] = last
            elif r.op == "delete" and k is not None:
                deleted.put(k, (last,))
                touched[k] = last
        out = []
        for k, at in touched.items():
            at_depth, gone = standing.get(k), deleted.get(k)
            top = stack.get(at_depth[0])[1:4] if at_depth else None
            alive = top is not None and (gone is None or top[0] > gone[0])
            out.append((key[0], k, at, *(top if alive else (None, None, None)), alive))
        for entries in (stack, standing, deleted):
            entries.flush()
        if last is not None:
            self.position.update((last, depth))
        if place is not None:
            self.pending.update(place)
        elif self.pending.exists():
            self.pending.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])

    def close(self) -> None:
        pass


def edit_updates(events: DataFrame) -> DataFrame:
    """The state of every row that a batch of a stream (map_num, seq, op, id, x, y) has touched: ``at`` is the event, ``alive`` whether the row stands."""
    return events.where("map_num is not null").groupBy("map_num").transformWithStateInPandas(EditSession(), ROW, "Update", "None")


def run_edit_stream(spark: SparkSession, log: str, table: str, checkpoint: str) -> None:
    """Take in what is new in a log of events, JSON lines, and append the touched rows' states to ``table``, a folder for each batch, so a repeated batch replaces itself.

    A sheet's events come in the order of ``seq``, within a file or in one file after the other.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        updates = edit_updates(spark.readStream.schema(EVENT).json(log))
        write = lambda df, k: df.write.mode("overwrite").parquet(f"{table}/batch={k:012d}")
        stream = updates.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        stream.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def standing_rows(spark: SparkSession, table: str) -> DataFrame:
    """map_num, id, seq, x, y of the rows that stand after all batches of a table."""
    states = spark.read.schema(ROW).option("recursiveFileLookup", True).parquet(table)
    return best(states, ["map_num", "id"], [F.desc("at")]).where("alive").select("map_num", "id", "seq", "x", "y")
