"""Nearest-neighbour searches among labelled points: the k nearest, all within a radius, the k nearest within one.

Distances are squared for ``l2``, sums of absolute differences for ``l1``; ``so2``
takes the last number alone, as an angle, and its absolute difference the shorter way
round. A point matches a radius if it is strictly nearer. Ties go to the lower label.
A row or point that is null or holds null or non-finite numbers matches nothing.

Few points travel with one pass over the rows; more are met by cells
(:mod:`fascicle.operators.metric`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fascicle.operators import metric as cells_of
from fascicle.operators import scoring
from fascicle.operators.metric import find, matrix
from fascicle.plans.durable import materialise


def checked(k: int | None, radius: float | None, metric: str = "l2") -> None:
    if metric not in ("l1", "l2", "so2"):
        raise ValueError(f"no metric {metric}")
    if k is None and radius is None or k is not None and k < 1:
        raise ValueError("a search needs a positive k, a radius or both")


def neighbours(latents: DataFrame, points: DataFrame, k: int | None = 1, radius: float | None = None, metric: str = "l2", key: str = "sid", report: dict | None = None, most: int | None = None) -> DataFrame:
    """(``key``, nth, label, distance): for every row its ``k`` nearest points, ``nth`` from 1, or with no ``k`` all within ``radius``; with both, at most ``k`` within it.

    A row without any match, or any row where there are no points, has no rows. Points of
    more than ``most`` numbers are met by cells, as in :func:`fascicle.operators.scoring.score`.
    """
    checked(k, radius, metric)
    rows = latents.select(F.col(key).alias("key"), F.col("z_fwd").cast("array<double>").alias("z"))
    held = scoring.carried(points, most)
    if held is None:
        cells, placed = cells_of.build(points.select(F.col("label").cast("long").alias("id"), F.lit(0).cast("long").alias("tag"), F.col("z_fwd").cast("array<double>").alias("z")), metric)
        return by_cells(rows, cells, placed, k, radius, key, report)
    kind = latents.schema[key].dataType.simpleString()
    labels, centres = held
    if not len(labels):
        return latents.sparkSession.createDataFrame([], f"`{key}` {kind}, nth int, label int, distance double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                offsets, names, far = find(matrix(b.column("z"), centres.shape[1]), labels, centres, k, radius, metric)
                lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v)) for v in (names.astype(np.int32), far)]
                yield pa.RecordBatch.from_arrays([b.column("key"), *lists], ["key", "label", "d"])

    found = rows.mapInArrow(run, f"`key` {kind}, label array<int>, d array<double>")
    found = found.select("key", F.posexplode(F.arrays_zip("label", "d")).alias("nth", "p"))
    return found.select(F.col("key").alias(key), (F.col("nth") + 1).alias("nth"), F.col("p.label").alias("label"), F.col("p.d").alias("distance"))


def by_cells(rows: DataFrame, cells: cells_of.Cells, placed: DataFrame, k: int | None, radius: float | None, key: str, report: dict | None = None) -> DataFrame:
    """The same for ``rows`` (key, z) and points that are in cells already."""
    numbered = materialise(rows.withColumn("id", F.monotonically_increasing_id()))
    found = cells_of.search(numbered.select("id", F.lit(0).cast("long").alias("tag"), "z"), cells, placed, k, radius, report)
    return numbered.select("id", "key").join(found, "id").select(F.col("key").alias(key), "nth", "label", F.col("d").alias("distance"))


def add(points: DataFrame, more: DataFrame) -> DataFrame:
    """The points and further ones, whose labels must be new: a label that both have raises where the result is computed."""
    both = points.select("label", "z_fwd").unionByName(more.select("label", "z_fwd"))
    one = both.groupBy("label").agg(F.count("*").alias("n"), F.first("z_fwd").alias("z_fwd"))
    return one.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two points of label "), F.col("label").cast("string"))).cast("int")).otherwise(F.col("label")).alias("label"), "z_fwd")


def remove(points: DataFrame, labels: DataFrame) -> DataFrame:
    """The points without those labels."""
    return points.join(labels.select("label").distinct(), "label", "left_anti")
