"""Scores back onto streamlines and into voxels.

Voxels are half-open boxes from an origin, cubes unless each axis has its own size; or
they lie as an affine map says, turned or sheared as it may be. A streamline's segments
are cut in the space of voxel indices, at the planes between voxels; each piece counts
in the voxel of its middle, with its length in the world. The image is the sum of score times length over the sum of length. Cut
pieces are summed within a task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fascicle.operators.geometry import flat_points


def guard_counts(left: DataFrame, right: DataFrame, key: str = "sid") -> DataFrame:
    """One row: counts of both sides and of keys that one side lacks. Files that belong together have none of these."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    keys = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return keys.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("r"), F.lit(0)).alias("n_right"),
        F.count(F.when(F.col("r") == 0, 1)).alias("only_left"), F.count(F.when(F.col("l") == 0, 1)).alias("only_right"),
    )


def require_match(left: DataFrame, right: DataFrame, what: str, key: str = "sid") -> None:
    row = guard_counts(left, right, key).first()
    if row["n_left"] != row["n_right"] or row["only_left"] or row["only_right"]:
        raise ValueError(f"{what}: {row['n_right']} rows for {row['n_left']} streamlines; {row['only_left']} have none")


def annotate(streamlines: DataFrame, scores: DataFrame | None = None, labels: DataFrame | None = None, key: str = "sid", check: bool = True) -> DataFrame:
    """``streamlines`` with ``score``, ``label`` or both."""
    if scores is None and labels is None:
        raise ValueError("scores, labels or both are needed")
    for name, side in (("scores", scores), ("labels", labels)):
        if side is not None:
            if check:
                require_match(streamlines, side, name, key)
            streamlines = streamlines.join(side, key)
    return streamlines


def threshold(scores: DataFrame, least: float) -> DataFrame:
    """Scores of at most ``least`` become 0, if it is positive; their streamlines still count in the image."""
    return scores.withColumn("score", F.when(F.col("score") <= least, F.lit(0.0)).otherwise(F.col("score"))) if least > 0 else scores


def weighted(scores: DataFrame, weights: DataFrame, key: str = "sid") -> DataFrame:
    return scores.join(weights, key).withColumn("score", F.col("score") * F.col("weight")).drop("weight")


def to_indices(xyz: np.ndarray, size: float | np.ndarray, origin: np.ndarray, affine: np.ndarray | None) -> np.ndarray:
    """Places in units of voxels: voxel i reaches from i to i + 1. An affine map (3 x 4) gives the middle of a voxel."""
    if affine is None:
        return (xyz - origin) / size
    return (xyz - affine[:, 3]) @ np.linalg.inv(affine[:, :3]).T + 0.5


def cut_segments(a: np.ndarray, b: np.ndarray, size: float | np.ndarray, origin: np.ndarray, affine: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, voxel, length) of each piece of the segments from ``a`` to ``b``."""
    p, q = (to_indices(x, size, origin, affine) for x in (a, b))
    owner, at = [np.arange(len(a)), np.arange(len(a))], [np.zeros(len(a)), np.ones(len(a))]
    for c in range(3):
        low, high = np.floor(np.minimum(p[:, c], q[:, c])) + 1, np.ceil(np.maximum(p[:, c], q[:, c])) - 1
        count = np.maximum(0, high - low + 1).astype(np.int64)
        k = np.repeat(np.arange(len(a)), count)
        plane = low[k] + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
        owner.append(k)
        at.append((plane - p[k, c]) / (q[k, c] - p[k, c]))
    owner, at = np.concatenate(owner), np.concatenate(at)
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    piece = np.flatnonzero((owner[1:] == owner[:-1]) & (at[1:] - at[:-1] > 1e-9))
    k, s, e = owner[piece], at[piece], at[piece + 1]
    voxel = np.floor(p[k] + ((s + e) / 2)[:, None] * (q[k] - p[k])).astype(np.int64)
    return k, voxel, (e - s) * np.sqrt(((b - a) ** 2).sum(1))[k]


def voxelise(streamlines: DataFrame, size: float | tuple[float, float, float] = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), affine: np.ndarray | None = None) -> DataFrame:
    """(i, j, k, length, score_length) over all streamlines, ``score_length`` being the sum of score times length."""
    scored = streamlines.select("points", (F.col("score") if "score" in streamlines.columns else F.lit(1.0)).cast("double").alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xyz, offsets = flat_points(b.column(0))
            owner = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
            seg, voxel, length = cut_segments(xyz[inner], xyz[inner + 1], np.array(size, float), np.array(origin), affine)
            score = b.column(1).to_numpy(zero_copy_only=False)[owner[inner][seg]]
            # One integer for each voxel of the box that this batch reaches, when it fits: records sort far more slowly.
            low = voxel.min(0) if len(voxel) else np.zeros(3, np.int64)
            shape = voxel.max(0) - low + 1 if len(voxel) else np.ones(3, np.int64)
            if shape.astype(float).prod() < 2**62:
                flat, at = np.unique(np.ravel_multi_index((voxel - low).T, shape), return_inverse=True)
                keys = np.stack(np.unravel_index(flat, shape), 1) + low
            else:
                keys, at = np.unique(voxel, axis=0, return_inverse=True)
                at = at.ravel()
            sums = [np.bincount(at, w, len(keys)) for w in (length, np.nan_to_num(score) * length)]
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, c].astype(np.int32)) for c in range(3)), *(pa.array(s) for s in sums)], ["i", "j", "k", "length", "score_length"])

    parts = scored.where("size(points) > 1").mapInArrow(run, "i int, j int, k int, length double, score_length double")
    return parts.groupBy("i", "j", "k").agg(F.sum("length").alias("length"), F.sum("score_length").alias("score_length"))


def image(voxels: DataFrame) -> DataFrame:
    """(i, j, k, value): the length-weighted mean score."""
    return voxels.select("i", "j", "k", F.when(F.col("length") != 0, F.col("score_length") / F.col("length")).otherwise(F.col("score_length")).alias("value"))


#: Voxels of a block along each axis.
SIDE = 32


def _stencil(voxels: DataFrame, shape: tuple[int, int, int], work) -> DataFrame:
    """``work`` on dense blocks with a rim of one voxel: a voxel goes to its block, and to those that it borders on. Voxels outside the grid are left out."""
    inside = voxels.select("i", "j", "k", "value")
    for c, n in zip("ijk", shape):
        inside = inside.where((F.col(c) >= 0) & (F.col(c) < n))
        near = F.array_distinct(F.array(*[F.floor((F.col(c) + d) / SIDE).cast("int") for d in (-1, 0, 1)]))
        inside = inside.withColumn(f"b{c}", F.explode(near))

    def run(t: pa.Table) -> pa.Table:
        at = np.stack([t.column(c).to_numpy() for c in "ijk"], 1).astype(np.int64)
        low = np.array([t.column(f"b{c}")[0].as_py() for c in "ijk"]) * SIDE - 1
        dense, there = np.zeros((SIDE + 2,) * 3), np.zeros((SIDE + 2,) * 3, bool)
        spot = tuple((at - low).T)
        dense[spot], there[spot] = t.column("value").to_numpy(zero_copy_only=False), True
        grid = [(low[c] + np.arange(SIDE + 2) >= 0) & (low[c] + np.arange(SIDE + 2) < shape[c]) for c in range(3)]
        grid = grid[0][:, None, None] & grid[1][None, :, None] & grid[2][None, None, :]
        # Places of the grid with a voxel within reach.
        near = (_boxed(there.astype(np.int32)) > 0) & grid[1:-1, 1:-1, 1:-1]
        value = work(dense, grid, near)
        out = np.argwhere(near) + low + 1
        return pa.table({**{c: pa.array(out[:, n].astype(np.int32)) for n, c in enumerate("ijk")}, "value": value})

    # A group is a block with its rim, whatever the input.
    return inside.groupBy("bi", "bj", "bk").applyInArrow(run, "i int, j int, k int, value double")


def _boxed(x: np.ndarray) -> np.ndarray:
    """Sums over the 27 places around each inner place, axis by axis."""
    for axis in range(3):
        x = np.moveaxis(x, axis, 0)
        x = np.moveaxis(x[:-2] + x[1:-1] + x[2:], 0, axis)
    return x


def _mean(dense: np.ndarray, grid: np.ndarray, near: np.ndarray) -> np.ndarray:
    return _boxed(dense)[near] / _boxed(grid.astype(np.int32))[near]


def _median(dense: np.ndarray, grid: np.ndarray, near: np.ndarray) -> np.ndarray:
    around = np.lib.stride_tricks.sliding_window_view(np.where(grid, dense, np.inf), (3, 3, 3))[near].reshape(-1, 27)
    around = np.sort(around, 1)  # places outside the grid come last
    n, rows = _boxed(grid.astype(np.int32))[near], np.arange(len(around))
    return (around[rows, (n - 1) // 2] + around[rows, n // 2]) / 2


def mean_filter(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """27-neighbourhood mean; absent voxels of the grid count as 0."""
    return _stencil(voxels, shape, _mean)


def median_filter(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """27-neighbourhood median, the middle two averaged; absent voxels of the grid count as 0."""
    return _stencil(voxels, shape, _median)


def to_image(streamlines: DataFrame, scores: DataFrame, voxel_size: float | tuple[float, float, float] = 1.0, least: float = 0.0, weights: DataFrame | None = None, median: bool = False, mean: bool = False, origin=None, shape=None, key: str = "sid", affine: np.ndarray | None = None) -> DataFrame:
    """Scores to an image: threshold, weights, voxels, then the median and the mean filter. ``affine`` stands for size and origin, and needs the shape."""
    from fascicle.operators.geometry import bounding_box

    require_match(streamlines, scores, "scores", key)
    scores = threshold(scores, least)
    if weights is not None:
        require_match(streamlines, weights, "weights", key)
        scores = weighted(scores, weights, key)
    if origin is None and affine is None:
        box = bounding_box(streamlines).first()
        origin = tuple(float(box[f"min_{c}"]) for c in "xyz")
        shape = tuple(int((box[f"max_{c}"] - box[f"min_{c}"]) // s) + 1 for c, s in zip("xyz", np.broadcast_to(voxel_size, 3)))
    out = image(voxelise(streamlines.join(scores, key), voxel_size, origin or (0.0, 0.0, 0.0), affine))
    out = median_filter(out, shape) if median else out
    return mean_filter(out, shape) if mean else out
