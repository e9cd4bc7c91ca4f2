"""Streamline geometry: resampling, reversal, layout, lengths, boxes and distances.

Resampling takes equal steps of arc length, both end points included. A streamline
of one point or of no length repeats its first point; one without points stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.schema import POINT

_POINT_TYPE = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])


def flat_points(points: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates of all points, offsets from 0) of an Arrow array of point lists."""
    offsets = points.offsets.to_numpy().astype(np.int64)
    inner = points.flatten()
    return np.stack([inner.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], 1).reshape(-1, 3), offsets - offsets[0]


def point_lists(xyz: np.ndarray, offsets: np.ndarray) -> pa.Array:
    inner = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xyz[:, i])) for i in range(3)], fields=list(_POINT_TYPE))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), inner)


def resample_points(xyz: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All streamlines at once: each target arc length is looked up in one ascending key of all points, the streamline and how far along it a point lies."""
    size = np.diff(offsets)
    full = np.flatnonzero(size > 0)
    out_offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, n, 0))])
    if not len(full):
        return np.zeros((0, 3)), out_offsets
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    step = np.zeros(len(xyz))
    step[1:] = np.sqrt(((xyz[1:] - xyz[:-1]) ** 2).sum(1))
    step[first] = 0
    run = _runs(step, size[full])
    total = run[last]
    at = np.arange(n) * (total / max(n - 1, 1))[:, None]
    at[:, -1] = np.where(n > 1, total, 0.0)
    # Points that go on; of those at one arc length the first.
    grows = step > 0
    grows[first] = True
    kept = np.flatnonzero(grows)
    owner = np.repeat(np.arange(len(full)), size[full])
    # One ascending key for all: the streamline, and half of the way along it. Rounding can only
    # take a target to the neighbouring piece where the two meet.
    whole = np.where(total > 0, total, 1)
    left = np.searchsorted(owner[kept] + run[kept] / whole[owner[kept]] / 2, (np.arange(len(full))[:, None] + at / whole[:, None] / 2).ravel(), "right") - 1
    end = np.searchsorted(owner[kept], np.arange(len(full)), "right") - 1
    left = np.minimum(left, np.repeat(np.maximum(end - 1, np.searchsorted(owner[kept], np.arange(len(full)))), n))
    right = np.minimum(left + 1, np.repeat(end, n))
    a, b = kept[left], kept[right]
    gap = run[b] - run[a]
    share = np.clip(np.where(gap > 0, (at.ravel() - run[a]) / np.where(gap > 0, gap, 1), 0), 0, 1)
    out = xyz[a] + (xyz[b] - xyz[a]) * share[:, None]
    ends = np.arange(1, len(full) + 1) * n - 1
    out[ends] = np.where((total > 0)[:, None], xyz[last], xyz[first])
    return out, out_offsets


def _runs(step: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with each streamline, exactly as if each were summed alone: those of equal size go side by side."""
    out = np.empty(len(step))
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for n in np.unique(sizes):
        rows = begin[sizes == n][:, None] + np.arange(n)
        out[rows] = np.cumsum(step[rows], 1)
    return out


#: Points, as they come or as they are resampled, that a task works on at a time.
PIECE = 1 << 16


def pieces(points: pa.Array, n: int) -> Iterator[slice]:
    """The rows of a batch by runs that hold, at ``n`` points a row or as they are, about ``PIECE`` points; a longer streamline is alone."""
    size = np.maximum(np.diff(points.offsets.to_numpy().astype(np.int64)), max(n, 1))
    begin, held = 0, np.cumsum(size)
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(held, PIECE + (held[begin - 1] if begin else 0), "right")))
        yield slice(begin, end)
        begin = end


def typed(df: DataFrame, *others: str, points: str = "points") -> DataFrame:
    """``others`` and the streamlines as they are resampled; null has no points."""
    return df.select(*others, F.coalesce(F.col(points), F.array()).cast(f"array<{POINT}>").alias(points))


def even_points(points: pa.Array, n: int, resampled: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(indices, (rows, n, 3)) of the streamlines with points, resampled to ``n`` in the task; or, ``resampled``, of those that have ``n``."""
    xyz, offsets = flat_points(points)
    whole = np.flatnonzero(np.diff(offsets) == n if resampled else np.diff(offsets) > 0)
    if resampled:
        return whole, (xyz if len(whole) * n == len(xyz) else xyz[(offsets[whole][:, None] + np.arange(n)).ravel()]).reshape(len(whole), n, 3)
    return whole, resample_points(xyz, offsets, n)[0].reshape(len(whole), n, 3)


def resample(df: DataFrame, n: int, points: str = "points") -> DataFrame:
    """``df`` with each streamline at ``n`` points."""
    others = [c for c in df.columns if c != points]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(len(others)).fill_null([]) if b.column(len(others)).null_count else b.column(len(others))
            for s in pieces(column, n):
                new = point_lists(*resample_points(*flat_points(column[s]), n))
                yield pa.RecordBatch.from_arrays([*(c[s] for c in b.columns[: len(others)]), new], [*others, points])

    rows = typed(df, *others, points=points)
    return rows.mapInArrow(run, rows.schema)


def flip(points: Column) -> Column:
    return F.reverse(points)


def _axis(c: str):
    return lambda p: p[c]


def flatten(points: Column) -> Column:
    """All x, then all y, then all z."""
    return F.concat(*[F.transform(points, _axis(c)) for c in "xyz"])


def norm2(a: Column, b: Column) -> Column:
    return sum((F.pow(a[c] - b[c], F.lit(2.0)) for c in "xyz"), F.lit(0.0))


def length(points: Column) -> Column:
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.sqrt(norm2(a, b)))
    return F.when(F.size(points) > 1, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def bounding_box(df: DataFrame, points: str = "points") -> DataFrame:
    """One row with the least and greatest coordinates; partial per task."""
    inner = lambda c: F.transform(points, _axis(c))
    return df.agg(*[f(g(inner(c))).alias(f"{n}_{c}") for c in "xyz" for n, f, g in (("min", F.min, F.array_min), ("max", F.max, F.array_max))])


def mdf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum average direct-flip distance of streamlines (rows, points, 3) with equal point counts."""
    direct = np.sqrt(((a - b) ** 2).sum(2)).mean(1)
    return np.minimum(direct, np.sqrt(((a - b[:, ::-1]) ** 2).sum(2)).mean(1))


def hausdorff(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two-sided Hausdorff distance over the points. Rows go side by side, in strips that stay in the cache; roots are taken at the end."""
    out, step = np.zeros(len(a)), max(1, CACHED // max(1, a.shape[1] * b.shape[1]))
    for s in range(0, len(a), step):
        x, y = (np.ascontiguousarray(v[s : s + step].transpose(2, 1, 0)) for v in (a, b))
        d = np.square(x[0][:, None] - y[0])
        for c in (1, 2):
            gap = x[c][:, None] - y[c]
            d += np.square(gap, out=gap)
        out[s : s + step] = np.sqrt(np.maximum(d.min(1).max(0), d.min(0).max(0)))
    return out


#: Squared distances below this share of the coordinates' squares are measured from differences; numbers of a table of points.
CLOSE, CACHED = 1e-6, 1 << 18


def all_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Hausdorff, MDF), each (rows of a, rows of b), of streamlines with equal point counts.

    Squared distances of points come from products of matrices around the points' middle,
    a strip of ``b`` at a time that stays in the cache. Pairs with points so close that
    rounding could be seen, or without finite points, are measured from differences.
    """
    (n, p, _), m = a.shape, len(b)
    far, mean = np.zeros((n, m)), np.zeros((n, m))
    if not (n and m and p):
        return far, mean
    flat = b.reshape(-1, 3)
    fine = flat[np.isfinite(flat).all(1)]
    middle = fine.mean(0) if len(fine) else np.zeros(3)
    x, y = a - middle, b - middle
    x2, y2 = (x * x).sum(2), (y * y).sum(2)
    # One product gives |x|^2 - 2 xy + |y|^2.
    left = np.concatenate([-2 * x, np.ones((n, p, 1)), x2[:, :, None]], 2)
    right = np.concatenate([y, y2[:, :, None], np.ones((m, p, 1))], 2)
    strip = min(m, max(16, CACHED // (p * p)))
    for t in range(0, m, strip):
        w = min(strip, m - t)
        side = np.ascontiguousarray(right[t : t + w].transpose(2, 1, 0)).reshape(5, -1)
        table, most = np.empty((p, p * w)), y2[t : t + w].max(1)
        d, flat = table.reshape(p, p, w), table.reshape(p * p, w)
        # What every row of ``a`` fills anew; points met in order, and in reverse.
        own, other, ways = np.empty((p, w)), np.empty((p, w)), np.empty((2, p, w))
        order, reverse = flat[:: p + 1], flat[p - 1 : p * p - (p > 1) : max(p - 1, 1)]
        close = np.zeros((n, w), bool)
        with np.errstate(invalid="ignore"):
            for i in range(n):
                np.matmul(left[i], side, out=table)
                np.minimum.reduce(d, 1, out=own)
                np.minimum.reduce(d, 0, out=other)
                close[i] = ~(own.min(0) > CLOSE * (x2[i].max() + most))
                np.maximum(own.max(0), other.max(0), out=far[i, t : t + w])
                np.sqrt(order, out=ways[0])
                np.sqrt(reverse, out=ways[1])
                ways.sum(1).min(0, out=mean[i, t : t + w])
            far[:, t : t + w] = np.sqrt(far[:, t : t + w])
            mean[:, t : t + w] /= p
        rows, columns = np.nonzero(close)
        for s in range(0, len(rows), 1 << 12):
            i, j = rows[s : s + (1 << 12)], columns[s : s + (1 << 12)] + t
            far[i, j], mean[i, j] = hausdorff(a[i], b[j]), mdf(a[i], b[j])
    return far, mean
