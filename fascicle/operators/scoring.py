"""Nearest-centre scores of latents, in either direction.

The forward and the reversed code are each compared with the centres' forward codes;
the forward match is taken when it is strictly nearer. Equal distances give the
lowest label. Without centres, and for a latent that is null or holds null or
non-finite numbers, score and label are null.

Centres of up to ``SLICE_NUMBERS`` numbers travel with one pass over the latents; more
are met by cells (:mod:`fascicle.operators.metric`), so that nobody holds them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fascicle.operators import metric
from fascicle.operators.metric import matrix, nearest
from fascicle.plans.durable import materialise

#: Numbers of centres that travel with a pass.
SLICE_NUMBERS = 8_000_000


def carried(centres: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(labels, codes) in ascending labels, or None if they are more than ``most`` numbers, too many to travel with a task."""
    n, width = centres.agg(F.count("*"), F.max(F.size("z_fwd"))).first()
    if n * max(width or 0, 1) > (SLICE_NUMBERS if most is None else most):
        return None
    rows = centres.select("label", F.col("z_fwd").cast("array<double>").alias("z")).orderBy("label").toArrow()
    return rows.column("label").to_numpy().astype(np.int64), matrix(rows.column("z").combine_chunks()) if n else np.zeros((0, 0))


_BEST = "__fwd double, __fwd_label int, __rev double, __rev_label int"


def _carry(latents: DataFrame, labels: np.ndarray, centres: np.ndarray) -> DataFrame:
    """``latents`` with the nearest centre of either direction; rows stay where they are."""
    schema = ", ".join([*(f"`{c}` {latents.schema[c].dataType.simpleString()}" for c in latents.columns), _BEST])
    at = [latents.columns.index(c) for c in ("z_fwd", "z_rev")]
    names = [*latents.columns, *(c.split()[0] for c in _BEST.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            best = []
            for i in at:
                d2, where = nearest(matrix(b.column(i), centres.shape[1]), centres)
                none = where < 0
                best += [pa.array(d2, mask=none), pa.array(labels[where].astype(np.int32), mask=none)]
            yield pa.RecordBatch.from_arrays([*b.columns, *best], names)

    return latents.mapInArrow(run, schema)


def _by_cells(latents: DataFrame, centres: DataFrame, report: dict | None) -> DataFrame:
    """The same by cells of the centres. Rows get numbers of their own, so that rows of one id stay apart."""
    rows = materialise(latents.withColumn("__row", F.monotonically_increasing_id()))
    code = lambda c: F.col(c).cast("array<double>").alias("z")
    cells, placed = metric.build(centres.select(F.col("label").cast("long").alias("id"), F.lit(0).cast("long").alias("tag"), code("z_fwd")))
    # Two queries a row: even numbers forward, odd ones reversed.
    asked = [rows.select((2 * F.col("__row") + side).alias("id"), F.lit(0).cast("long").alias("tag"), code(c)) for side, c in enumerate(("z_fwd", "z_rev"))]
    found = metric.search(asked[0].unionByName(asked[1]), cells, placed, report=report)
    side = lambda c, odd: F.max(F.when(F.col("id") % 2 == odd, F.col(c)))
    best = found.groupBy(F.shiftright("id", 1).alias("__row")).agg(side("d", 0).alias("__fwd"), side("label", 0).alias("__fwd_label"), side("d", 1).alias("__rev"), side("label", 1).alias("__rev_label"))
    return rows.join(best, "__row", "left").drop("__row")


def score(latents: DataFrame, centres: DataFrame, scaler: float = 1.0, key: str = "sid", report: dict | None = None, most: int | None = None) -> DataFrame:
    """(``src`` if there is one, ``key``, score, label, forward) of every row of ``latents``. Without a shuffle where the centres travel with the pass, as they must on a stream.

    Centres of more than ``most`` numbers (``SLICE_NUMBERS`` if not given) are met by
    cells, and ``report`` gets the share of distances that these spared.
    """
    own = [c for c in ("src", key) if c in latents.columns]
    held = carried(centres, most)
    if held is not None and not len(held[0]):
        return latents.select(*own, F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("boolean").alias("forward"))
    if held is None and latents.isStreaming:
        raise ValueError(f"a stream meets at most {SLICE_NUMBERS} numbers of centres; score its batches with foreachBatch")
    rows = latents.select(*own, "z_fwd", "z_rev")
    out = _by_cells(rows, centres, report) if held is None else _carry(rows, *held)
    # A code without a match leaves the other one.
    forward = F.coalesce(F.col("__fwd") < F.col("__rev"), F.when(F.col("__fwd").isNotNull(), True).when(F.col("__rev").isNotNull(), False))
    nearer = lambda c: F.when(forward, F.col(f"__fwd{c}")).otherwise(F.col(f"__rev{c}"))
    return out.select(*own, (F.sqrt(nearer("")) * F.lit(float(scaler))).alias("score"), nearer("_label").alias("label"), forward.alias("forward"))


def centroids(latents: DataFrame, by: str) -> DataFrame:
    """The mean latent of each group of ``by``, labelled 1, 2, ... in its order; partial per task."""
    dim = len(latents.select("z_fwd").first()[0])
    means = [F.avg(F.get(F.col(c), F.lit(i))).alias(f"{c}_{i}") for c in ("z_fwd", "z_rev") for i in range(dim)]
    from pyspark.sql import Window

    groups = latents.groupBy(by).agg(*means)
    # A row for each group: as many as there are centres.
    return groups.select(F.row_number().over(Window.orderBy(by)).cast("int").alias("label"), *(F.array(*[F.col(f"{c}_{i}") for i in range(dim)]).alias(c) for c in ("z_fwd", "z_rev")))
