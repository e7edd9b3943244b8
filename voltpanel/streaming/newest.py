"""The newest row of every key of a stream, kept as state; only changes are handed on.

The state holds one row per key, however often the key is published, so a feed that repeats
whole weeks to revise a day costs a lookup per row and nothing behind it. Rows compare by
the ordering columns and then by the others, as in ``operators.keyed.keep_newest``, so
the last change of a key is the row that one pass over all files would keep, whatever the
order, repeats or size of batches. A null counts as least.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestRow(StatefulProcessor):
    """Holds a key's newest row and emits it when it changes, once per batch at most."""

    def __init__(self, columns: list[str], newest: list[str], payload: StructType):
        self.columns, self.newest, self.payload = columns, newest, payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", self.payload)

    def rank(self, values: dict) -> list[tuple]:
        order = [*self.newest, *self.payload.names]
        return [(False,) if values[c] is None else (True, values[c]) for c in order]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = dict(zip(self.payload.names, self.held.get())) if self.held.exists() else None
        best = known
        for row in rows:
            values = {c: row[c] for c in self.payload.names}
            if best is None or self.rank(values) > self.rank(best):
                best = values
        if best is not known:
            self.held.update(tuple(best[c] for c in self.payload.names))
            yield Row(**{**dict(zip([c for c in self.columns if c not in best], key)), **best})

    def close(self) -> None:
        pass


def newest_changes(feed: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """Stream of the rows that become their key's newest one; columns in the feed's order.

    Keys are dealt over the shuffle partitions, and a row with a null key has a state of its own
    like any other. This kind of state needs the RocksDB store, so the session is set to it.
    """
    feed.sparkSession.conf.set(STATE_STORE, ROCKS)
    columns = [*keys, *[c for c in feed.columns if c not in keys]]
    ordered = feed.select(*columns)
    payload = StructType([f for f in ordered.schema if f.name not in keys])
    changes = ordered.groupBy(*keys).transformWithState(NewestRow(columns, newest, payload), ordered.schema, "Update", "None")
    return changes.select(*feed.columns)
