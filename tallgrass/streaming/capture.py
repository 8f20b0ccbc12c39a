"""A keyed set that a stream of captured records keeps up to date, in the stream's own state store.

A record with a new key is added at the end; one with another answer replaces the key's record in place; one with the
same answer leaves it, with its time, as it was. Each key's record is one value of the state store, so a batch reads and
writes the keys that it holds and nothing else. The state lives in the checkpoint folder: it is there after a restart, and
``CaptureSet.read`` is a snapshot of it that needs no running stream.

Besides the state there is a feed of changes, one folder a batch, written again whole if a batch is run again. It tells
readers what to look at anew: ``LiveBase`` holds a base table with the set's records over it, and makes its frame again
only when a batch has brought a change.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tallgrass.operators import merge
from tallgrass.operators.scan import Starts, scan
from tallgrass.sources.shared import shared_folder

RECORD = "ord long, answer string, pos long"
CHANGE = "key {key}, ord long, answer string, pos long, change string, updates long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Upsert(StatefulProcessor):
    """One key's records of a batch, taken by ``ord`` (null first), against its record so far."""

    def init(self, handle) -> None:  # noqa: ANN001
        self.record = handle.getValueState("record", RECORD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        had = self.record.get() if self.record.exists() else None
        frame = pd.concat([r[["ord", "answer", "gone"]] for r in rows])
        taken = sorted(((None if pd.isna(o) else int(o), None if pd.isna(a) else a, bool(g)) for o, a, g in frame.itertuples(index=False)), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2]))
        now, updates = had, 0
        for order, answer, gone in taken:
            if gone:
                now = None
            elif now is None:
                now = (order, answer, order)
            elif now[1] != answer:
                now, updates = (order, answer, now[2]), updates + 1
        if now == had:
            return
        if now is None:
            self.record.clear()
        else:
            self.record.update(tuple(now))
        change = "gone" if now is None else "added" if had is None else "updated"
        order, answer, pos = now or had
        yield pd.DataFrame({"key": [key[0]], "ord": pd.array([order], "Int64"), "answer": [answer], "pos": pd.array([pos], "Int64"), "change": [change], "updates": [updates]})

    def close(self) -> None:
        pass


class CaptureSet:
    """The set in ``folder``, which driver and executors share; ``key_type`` is the SQL type of its keys."""

    def __init__(self, spark: SparkSession, folder: str, key_type: str = "long"):
        self.spark, self.folder, self.key_type = spark, folder, key_type
        self.progress, self.feed = f"{folder}/progress", f"{folder}/changes"

    def start(self, records: DataFrame, **trigger) -> StreamingQuery:  # noqa: ANN003
        """Takes the streamed ``records`` (key, ord, answer; ``gone``, if there is one: the key leaves the set) in, from where the set left off."""
        given = records if "gone" in records.columns else records.withColumn("gone", F.lit(False))
        rows = given.select(F.col("key").cast(self.key_type).alias("key"), F.col("ord").cast("long").alias("ord"), "answer", F.coalesce("gone", F.lit(False)).alias("gone"))
        changes = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Upsert(), outputStructType=CHANGE.format(key=self.key_type), outputMode="update", timeMode="none")
        writer = changes.writeStream.outputMode("update").foreachBatch(self._feed).option("checkpointLocation", self.progress).trigger(**(trigger or {"availableNow": True}))
        before = self.spark.conf.get(STORE)
        self.spark.conf.set(STORE, ROCKS)
        try:
            return writer.start()
        finally:
            self.spark.conf.set(STORE, before)

    def _feed(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.feed}/batch={batch_id}")

    def _files(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def version(self) -> int:
        """The last batch that is whole; -1 before any."""
        if not self._files(f"{self.progress}/commits/0"):
            return -1
        return self.spark.read.format("state-metadata").load(self.progress).agg(F.max("maxBatchId")).first()[0]

    def read(self) -> DataFrame:
        """``key ord answer pos`` of every record in the set, after its last whole batch."""
        if self.version() < 0:
            return self.spark.createDataFrame([], f"key {self.key_type}, {RECORD}")
        return self.spark.read.format("statestore").option("stateVarName", "record").load(self.progress).select("key.key", "value.*")

    def changes(self, since: int = -1) -> DataFrame:
        """The feed of whole batches after ``since``: ``batch key ord answer pos change updates``."""
        upto = self.version()
        if upto <= since:
            return self.spark.createDataFrame([], f"batch long, {CHANGE.format(key=self.key_type)}")
        rows = self.spark.read.schema(f"{CHANGE.format(key=self.key_type)}, batch long").parquet(self.feed)
        return rows.filter((F.col("batch") > since) & (F.col("batch") <= upto)).select("batch", "key", "ord", "answer", "pos", "change", "updates")

    def report(self) -> DataFrame:
        """``batch added updated gone`` of every batch that changed something."""
        counts = [F.count_if(F.col("change") == c).alias(c) for c in ("added", "updated", "gone")]
        return self.changes().groupBy("batch").agg(*counts)


class LiveBase:
    """A base table (key and other columns) under the records of a set: a key's captured record stands in for the base's.

    ``records`` is made again, and ``version`` goes up, only if a batch since the last look has changed something.
    """

    def __init__(self, base: DataFrame, captured: CaptureSet):
        self.base, self.captured = base, captured
        self.version, self._seen, self._records = 0, -2, None

    def records(self) -> DataFrame:
        now = self.captured.version()
        if self._records is None or (now > self._seen and self.captured.changes(self._seen).limit(1).count()):
            self._records = merge.refresh(self.base, self.captured.read().select(*[c for c in self.base.columns if c in ("key", "ord", "answer", "pos")]), "key")
            self.version += 1
        self._seen = now
        return self._records


def changed_only(rows: DataFrame, key_col: str, order_col: str, state_col: str, spread: bool = False) -> DataFrame:
    """Rows whose state differs from the one before of the same key. ``spread``: a key is read by several tasks."""
    return scan(rows, [key_col], order_col, spread, _new=Starts(state_col)).filter("_new").drop("_new")


def capture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files into a capture set; its state once all of them are read."""
    captured = CaptureSet(spark, f"{shared_folder(spark)}/capture-{uuid.uuid4().hex}")
    given = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(given).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    captured.start(events.select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.col("event_type").alias("answer"))).awaitTermination()
    return captured.read()
