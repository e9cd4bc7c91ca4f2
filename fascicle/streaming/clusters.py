"""Greedy clustering of a stream: each micro-batch adds its centres to those of the batches before.

The state is a folder with a table of centres for each batch, named by the batch's
number. A batch is clustered against the centres of lower numbers alone, as
:func:`fascicle.operators.clustering.find_centers` clusters its batches, and its table
comes about in one step. A batch that comes again, after a failure or a restart,
writes nothing if its table is there, and the same table if it is not; so the centres
after any sequence of replays are those of the batches in the order of their numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fascicle.operators.clustering import extend
from fascicle.plans.durable import ranked
from fascicle.schema import CENTRE, split_size

_STATE = "batch long, rank long, z_fwd array<double>, z_rev array<double>"


def _versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """The tables that are whole, by their batch."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return {int(n.removeprefix("batch-")): f"{folder}/{n}" for n in names if n.startswith("batch-")}


def _held(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(_STATE).parquet(*paths) if paths else spark.createDataFrame([], _STATE)


def centres(spark: SparkSession, folder: str) -> DataFrame:
    """(label, z_fwd, z_rev) of all batches so far, labelled in their order."""
    every, _ = ranked(_held(spark, list(_versions(spark, folder).values())), "batch", "rank", name="nth")
    return every.select((F.col("nth") + 1).cast("int").alias("label"), "z_fwd", "z_rev") if every.columns else spark.createDataFrame([], CENTRE)


def fold(folder: str, max_dist: float, scaler: float = 1.0, order: list[str] | None = None, split=split_size) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` does with each micro-batch of latents."""

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        there = _versions(spark, folder)
        if batch in there:
            return
        known = _held(spark, [p for n, p in there.items() if n < batch])
        new = extend(rows, known, max_dist, scaler, order, split)
        # Written aside first: a table that bears its batch's name is whole.
        aside = f"{folder}/making-{uuid.uuid4().hex}"
        new.select(F.lit(batch).cast("long").alias("batch"), "rank", "z_fwd", "z_rev").write.parquet(aside)
        path = spark._jvm.org.apache.hadoop.fs.Path
        path(aside).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(aside), path(f"{folder}/batch-{batch}"))

    return step


def start(latents: DataFrame, folder: str, checkpoint: str, max_dist: float, scaler: float = 1.0, order: list[str] | None = None, split=split_size, once: bool = False) -> StreamingQuery:
    writer = latents.writeStream.foreachBatch(fold(folder, max_dist, scaler, order, split)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
