"""Structured Streaming forms of intake, running finds and the leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.tables import setting, ship
from ..sources.files import read_submissions, stream_submissions

intake = stream_submissions


class _Upsert(StatefulProcessor):
    """State of one fingerprint: its row on the board. A batch's first row in order replaces it; a change is a row out."""

    def __init__(self, schema, order: list[tuple[str, bool]]):
        self.schema, self.order = schema, order

    def init(self, handle) -> None:
        self.row = handle.getValueState("row", self.schema)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of Spark's interface
        import pandas as pd

        first = None
        for pdf in rows:
            both = pdf if first is None else pd.concat([first, pdf])
            for name, ascending in reversed(self.order):  # nulls as Spark orders them
                both = both.sort_values(name, ascending=ascending, kind="stable", na_position="first" if ascending else "last")
            first = both.head(1)
        if first is None:
            return
        new = tuple(None if pd.isna(v) else v for v in first[self.schema.names].astype(object).iloc[0])
        if self.row.get() != new:
            self.row.update(new)
            yield first[self.schema.names]

    def close(self) -> None:
        pass


def upsert_leaderboard(stream: DataFrame, path: str, checkpoint: str, fingerprint: str, order: list[tuple[str, bool]]) -> StreamingQuery:
    """Keep a leaderboard: of each batch the first row of a fingerprint, in `order` of (column, ascending), replaces its
    row on the board. The board's rows are the query's state, one per fingerprint; each batch writes only the rows that
    it changed, as `path`/epoch=N, so a batch that is repeated after a failure writes the same files again, and a
    restart from `checkpoint` goes on. leaderboard() reads the board. Returns the started query."""
    ship(stream.sparkSession)
    names = stream.schema
    changed = stream.groupBy(fingerprint).transformWithStateInPandas(_Upsert(names, order), names, "Update", "None")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    with setting(stream.sparkSession, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        return changed.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def leaderboard(spark: SparkSession, path: str, schema: str, fingerprint: str) -> DataFrame:
    """The board that upsert_leaderboard() keeps: each fingerprint's last change."""
    changes = spark.read.schema(f"{schema}, epoch long").parquet(path)
    names = [c for c in changes.columns if c != "epoch"]
    return changes.groupBy(fingerprint).agg(F.max_by(F.struct(*names), "epoch").alias("row")).select("row.*")


def running_lightest(stream: DataFrame, keys: list[str], weight: str, tie: str) -> DataFrame:
    """Streaming aggregate of the lightest find per key. State is one row per catalogue key and never expires."""
    return stream.groupBy(*keys).agg(F.min(weight).alias("weight"), F.min_by(tie, F.struct(weight, tie)).alias("witness"))


__all__ = ["intake", "leaderboard", "read_submissions", "running_lightest", "stream_submissions", "upsert_leaderboard"]
