"""Pose ingestion as a stream of docked molecules: each micro-batch is merged like a run of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pocketloom.plans.poses import ingest, pose_rows
from pocketloom.runtime import scratch_dir


def start_ingest(docked: DataFrame, manifest: str, graphs: str, duplicates: str, name: str = "poses", checkpoint: str | None = None) -> StreamingQuery:
    """Adds docked molecules (the columns that pose_rows takes) to the three tables as they arrive, until nothing is left.

    A micro-batch that is repeated after a failure adds nothing twice: its poses are in the manifest by then, and are
    logged as duplicates.
    """
    where = checkpoint or f"{scratch_dir(docked.sparkSession)}/streams/{name}"

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest(pose_rows(batch), manifest, graphs, duplicates)

    return docked.writeStream.foreachBatch(add).option("checkpointLocation", where).trigger(availableNow=True).start()
