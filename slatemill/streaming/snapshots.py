"""The polled snapshot directory as a stream: new files become quotes as they arrive, boards are kept as state."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slatemill.sources.odds_json import EVENTS, parse_snapshots


def stream_snapshots(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The batch parser applied to a file stream, each poll once."""
    raw = (spark.readStream.schema(EVENTS).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(path))
    return parse_snapshots(raw, F.col("_metadata.file_name"))


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """Price in force per cell, kept as aggregation state (complete or update mode)."""
    return quotes.groupBy("fixture_id", "book", "line", "side").agg(F.max("t").alias("t"), F.max_by("price", "seq").alias("price"))


CELL = ["fixture_id", "book", "line", "side"]


class BoardState(StatefulProcessor):
    """The price in force of one cell: the update of the largest `seq` up to the decision, `lead` milliseconds before the
    start. A timer there emits it, if it is offered, and clears the state; updates after the decision are dropped."""

    def __init__(self, lead: int):
        self.lead = lead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, seq long, t timestamp, price double, active boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        new = held
        for b in rows:
            at = b["start"].astype("int64") // 10 ** (6 if "[ns]" in str(b["start"].dtype) else 3) - self.lead
            t = b["t"].astype("int64") // 10 ** (6 if "[ns]" in str(b["t"].dtype) else 3)
            b = b.assign(_at=at)[t <= at]
            for at, seq, t, price, active in b[["_at", "seq", "t", "price", "active"]].itertuples(index=False):
                if new is None or seq > new[1]:
                    new = (int(at), int(seq), t, float(price), bool(active))
        if new is not None and new is not held:
            if held is None or held[0] != new[0]:
                if held is not None:
                    self.handle.deleteTimer(held[0])
                self.handle.registerTimer(new[0])
            self.last.update(new)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return iter(())
        _, _, t, price, active = self.last.get()
        self.last.clear()
        offered = active and price > 1
        return iter([pd.DataFrame({**{c: [k] for c, k in zip(CELL, key)}, "t": [t], "price": [price]})] if offered else [])

    def close(self) -> None:
        pass


def stream_boards(quotes: DataFrame, lead_minutes: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """Boards of a stream of price changes (fixture_id, start, book, line, side, t, seq, price, active) at the decision
    `lead_minutes` before each start: a cell's row comes once event time has passed it by `late`, and its state
    goes. Append mode; the session needs the RocksDB state store."""
    kind = {f.name: f.dataType.simpleString() for f in quotes.schema.fields}
    schema = ", ".join(f"{c} {kind[c]}" for c in CELL) + ", t timestamp, price double"
    return (quotes.withWatermark("t", late).groupBy(*CELL)
            .transformWithStateInPandas(BoardState(int(lead_minutes * 60_000)), schema, "Append", "EventTime"))
