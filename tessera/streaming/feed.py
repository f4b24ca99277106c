"""Change feeds as streams: idempotent, latest-wins upserts into snapshots, compacted by size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import latest
from ..sources.files import Files, shared_dir


class SnapshotSink:
    """Keeps the latest version of each key under a folder: parquet deltas, and a manifest that names base and deltas.

    Each batch is written once under its number and then named in the manifest, so a repeated batch changes nothing. When
    compact_at deltas have gathered, base and deltas become a new base."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], seq: str, schema: str, compact_at: int = 8):
        self.spark, self.path, self.key, self.seq, self.schema, self.compact_at = spark, path.rstrip("/"), key, seq, schema, compact_at
        self.files = Files(spark)

    def _manifest(self) -> dict:
        return self.files.read_json(f"{self.path}/manifest.json") or {"base": None, "deltas": [], "last": -1}

    def apply(self, batch: DataFrame, number: int) -> None:
        m = self._manifest()
        if number <= m["last"]:
            return
        name = f"delta-{number}-{uuid.uuid4().hex}"
        latest(batch, self.key, self.seq).write.parquet(f"{self.path}/{name}")
        m["deltas"].append(name)
        m["last"] = number
        if len(m["deltas"]) >= self.compact_at:
            base = f"base-{number}-{uuid.uuid4().hex}"
            self._rows(m).write.parquet(f"{self.path}/{base}")
            m["base"], m["deltas"] = base, []
        self.files.write_json(f"{self.path}/manifest.json", m)

    def _rows(self, m: dict) -> DataFrame:
        names = [*([m["base"]] if m["base"] else []), *m["deltas"]]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return latest(self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names]), self.key, self.seq)

    def read(self) -> DataFrame:
        """The live rows: the last version of each key, unless it is a deletion."""
        return self._rows(self._manifest()).where("op <> 'delete'")


def deduplicated(stream: DataFrame, key: list[str], time_col: str, delay: str) -> DataFrame:
    """Drops repeats of an operation key that come within the delay."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(key)


def start(stream: DataFrame, sink: SnapshotSink, checkpoint: str, once: bool = True):
    writer = stream.writeStream.foreachBatch(lambda df, n: sink.apply(df, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the events table through a stream of changes and returns the final state: id, seq, value."""
    base = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    schema = "seq long, op string, id long, value double"
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = source.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"), F.col("user_id").alias("id"), "value")
    sink = SnapshotSink(spark, f"{base}/state", ["id"], "seq", schema)
    start(rows, sink, f"{base}/checkpoint").awaitTermination()
    return sink.read().select("id", "seq", "value")
