"""Changeset files as they arrive: each micro-batch is applied to the last published snapshot.

A batch may bring several files; they are applied in the order of their names. Every applied batch is
published as a new version folder before a pointer names it, so a reader never sees half a batch, and a
batch that runs again after a failure writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geoloom.operators import changes
from geoloom.sources import model

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _published(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("batch bigint, version string").json(f"{folder}/published")


def latest(spark: SparkSession, folder: str) -> model.Dataset:
    """The snapshot that was published last."""
    row = _published(spark, folder).orderBy(F.desc("batch")).first()
    return model.read(spark, f"{folder}/{row.version}")


def publish(snapshot: model.Dataset, folder: str, batch: int) -> None:
    """Write a version and name it as the batch's."""
    version = f"version={batch}"
    model.write(snapshot, f"{folder}/{version}", mode="overwrite")
    row = snapshot.spark.createDataFrame([(batch, version)], "batch bigint, version string")
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/published/batch={batch}")


def run(spark: SparkSession, incoming: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Start applying the files in ``incoming`` to the snapshots in ``folder`` (publish batch -1 first)."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", "*.xml").load(incoming).select("path", "modificationTime")

    def apply(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        rows = batch.select("path", "modificationTime").distinct().orderBy("path").collect()
        if not rows:
            return
        paths = [r.path for r in rows]
        # The files say when, so that a batch that runs again stamps the same time.
        stamp = max(r.modificationTime for r in rows)
        before = _published(own, folder).where(F.col("batch") < number).orderBy(F.desc("batch")).first()
        snapshot, _ = changes.apply_files(model.read(own, f"{folder}/{before.version}"), paths, stamp)
        publish(snapshot, folder, number)

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
