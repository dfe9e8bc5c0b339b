"""The current state of runs from a stream of events: of every column the newest value that isn't null, by event number.

The same view as registry.current() gives of a whole table, kept up as events come: events may come in any order and more
than once, as what counts is their number, not when they come. The state of a run is one value a column, however many events
it has. Runs without an event for some time can be forgotten; an event after that begins the run anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestValues(StatefulProcessor):
    """Of each key's columns, as text, the value with the largest event number; rows out have the key, how often it has
    changed, and the columns."""

    def __init__(self, key: str, order: str, columns: list[str], forget_ms: int | None = None):
        self.key, self.order, self.columns, self.forget_ms = key, order, columns, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        name, number, value = StructField("name", StringType()), StructField("number", LongType()), StructField("value", StringType())
        self.newest = handle.getMapState("newest", StructType([name]), StructType([number, value]), self.forget_ms)
        self.changes = handle.getValueState("changes", StructType([number]), self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = {name[0]: tuple(held) for name, held in self.newest.iterator()} if self.newest.exists() else {}
        before = dict(found)
        for frame in rows:
            for column in self.columns:
                some = frame.loc[frame[column].notna() & frame[self.order].notna(), [self.order, column]]
                if len(some):
                    # of equal numbers the largest value, so that the order they come in is of no account
                    newest = max(zip(some[self.order].astype("int64").tolist(), some[column].tolist()))
                    if column not in found or newest > found[column]:
                        found[column] = newest
        for column, held in found.items():
            if before.get(column) != held:
                self.newest.updateValue((column,), held)
        changes = (self.changes.get()[0] if self.changes.exists() else 0) + 1
        self.changes.update((changes,))
        yield pd.DataFrame({self.key: [key[0]], "changes": [changes]} | {c: [found[c][1] if c in found else None] for c in self.columns})

    def close(self) -> None:
        pass


def newest_values(events: DataFrame, key: str = "run_id", order: str = "event_no", forget_ms: int | None = None) -> DataFrame:
    """(key, changes, columns): a row for each key with events in a batch, its state after them; the one with most changes is
    a key's current state. Keys and event numbers are whole numbers or texts and whole numbers; a null key is a key of its own.

    Sets the session's state store to the one that such state needs.
    """
    kinds = dict(events.dtypes)
    columns = [c for c in events.columns if c not in (key, order)]
    events.sparkSession.conf.set(STORE, ROCKS)
    texts = events.select(F.col(key).cast("string").alias(key), F.col(order).cast("long").alias(order), *(F.col(c).cast("string").alias(c) for c in columns))
    schema = StructType([StructField(key, StringType()), StructField("changes", LongType()), *(StructField(c, StringType()) for c in columns)])
    mode = "None" if forget_ms is None else "ProcessingTime"
    states = texts.groupBy(key).transformWithStateInPandas(NewestValues(key, order, columns, forget_ms), schema, "Update", mode)
    return states.select(F.col(key).cast(kinds[key]).alias(key), "changes", *(F.col(c).cast(kinds[c]).alias(c) for c in columns))


def current_of(states: DataFrame, key: str = "run_id") -> DataFrame:
    """The current state of each key among all rows that newest_values() has given."""
    rest = [c for c in states.columns if c not in (key, "changes")]
    return states.groupBy(key).agg(F.max_by(F.struct(*rest), "changes").alias("_s")).select(key, *(F.col(f"_s.{c}").alias(c) for c in rest))
