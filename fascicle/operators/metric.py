"""Points in cells of a metric space: nearest points and points within a radius, as joins.

Pivots are drawn from the points by hash. A point belongs to its nearest pivot, and the
points of a pivot are cut by their distance from it into units of up to ``UNIT`` points.
A unit is described by its pivot and the least and largest distance from it, which by
the triangle inequality bound how near its points can be to a query. These descriptions
are the :class:`Cells`, one line for ``UNIT`` points; the points themselves stay a table.

A query goes to the units that its bounds do not rule out and meets their points in the
task; units with many queries are met in several tasks, each with its own copy of the
unit. A nearest-point join takes two rounds: every query meets its most promising unit,
and then the rooms, each of many consecutive units, that hold a unit which what it found
still reaches. It is sent to a room once, however many units it meets there; bounds rule
units out again in the task, and the others are met by products of matrices. So even
where bounds spare nothing a query is shuffled once for each room, of ``ROOM`` numbers.
Neither the driver nor any worker holds all points.

Distances are squared for ``l2``, sums of absolute differences for ``l1``; ``so2`` is
the absolute difference of the last numbers as angles, the shorter way round. Ties go
to the lower number. Points and queries that are null or hold null or non-finite
numbers match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fascicle.plans.durable import materialise, ranked

#: Points of a unit, pivots at most, queries that a task meets with one unit, distances that are held at a time.
UNIT, PIVOTS, QUERIES, TABLE = 1024, 1024, 1 << 16, 2_000_000
#: Numbers of a room's points, queries that a task meets with one room, points that are met in one product.
ROOM, GUESTS, STRIP = 1 << 20, 1 << 15, 2048
#: Rows of a box that are met with the points near it.
BOX = 256
EPS = float(np.finfo(float).eps)
POINT = "id long, tag long, z array<double>"


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of equal length as rows; a null list is a row of NaN. A list of another length than ``width`` raises."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if not column.null_count:
        if len(column) and width is not None and len(flat) != len(column) * width:
            raise ValueError(f"rows of {len(flat) // len(column)} numbers meet points of {width}")
        return flat.reshape(len(column), -1) if len(column) and len(flat) else flat.reshape(len(column), 0)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    width = len(flat) // max(1, there.sum()) if width is None else width
    out = np.full((len(column), width), np.nan)
    out[there] = flat.reshape(-1, width) if len(flat) else np.nan
    return out


def finite(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x).all(1)


def distances(x: np.ndarray, points: np.ndarray, metric: str = "l2") -> np.ndarray:
    """(rows, points), summed number by number so that only one such table is held."""
    if metric == "so2":
        turn = np.abs(x[:, -1:] - points[None, :, -1])
        return np.where(turn > np.pi, np.abs(turn - 2 * np.pi), turn)
    out = np.zeros((len(x), len(points)))
    for t in range(points.shape[1]):
        gap = x[:, t : t + 1] - points[None, :, t]
        out += gap * gap if metric == "l2" else np.abs(gap)
    return out


def _rough(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a product of matrices around the points' middle, and how far each row's may be off."""
    middle = points.mean(0)
    a, b = x - middle, points - middle
    a2, b2 = (a * a).sum(1), (b * b).sum(1)
    off = 8 * (x.shape[1] + 8) * EPS * (np.sqrt(a2) + np.sqrt(b2.max(initial=0))) ** 2
    return a2[:, None] - 2 * a @ b.T + b2[None, :], off


def exact(x: np.ndarray, points: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, from differences."""
    out = np.empty(len(rows))
    step = max(1, TABLE // max(1, x.shape[1]))
    for s in range(0, len(rows), step):
        gap = x[rows[s : s + step]] - points[columns[s : s + step]]
        out[s : s + step] = (gap * gap).sum(1)
    return out


def nearest(x: np.ndarray, points: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, index) of each row's nearest point, the lowest index of equally near ones; (inf, -1) without any.

    The product of matrices only narrows the choice: all points that its rounding leaves
    open are measured from differences.
    """
    best, which = np.full(len(x), np.inf), np.full(len(x), -1)
    able, fine = np.flatnonzero(finite(x)), np.flatnonzero(finite(points))
    for s in range(0, len(fine), block):
        of = fine[s : s + block]
        c = points[of]
        step = max(1, TABLE // len(of))
        for t in range(0, len(able), step):
            own = able[t : t + step]
            d, off = _rough(x[own], c)
            rows, columns = np.nonzero(d <= (d.min(1) + 2 * off)[:, None])
            far = exact(x[own], c, rows, columns)
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            least = np.minimum.reduceat(far, starts)
            # Columns ascend within a row: the first that is as near as any.
            hits = np.flatnonzero(far == np.repeat(least, np.diff(np.append(starts, len(rows)))))
            first = hits[np.diff(rows[hits], prepend=-1) > 0]
            better = least < best[own]
            best[own[better]], which[own[better]] = least[better], of[columns[first[better]]]
    return best, which


def within(x: np.ndarray, points: np.ndarray, limit2: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, indices) of all pairs strictly nearer than the limit."""
    able, fine = np.flatnonzero(finite(x)), np.flatnonzero(finite(points))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, TABLE // max(1, len(fine)))
    for t in range(0, len(able) if len(fine) else 0, step):
        own = able[t : t + step]
        d, off = _rough(x[own], points[fine])
        rows, columns = np.nonzero(d < limit2 + off[:, None])
        doubtful = np.flatnonzero(d[rows, columns] >= limit2 - off[rows])
        near = np.ones(len(rows), bool)
        near[doubtful] = exact(x[own], points[fine], rows[doubtful], columns[doubtful]) < limit2
        found.append((own[rows[near]], fine[columns[near]]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def touched(x: np.ndarray, points: np.ndarray, limit2: float) -> np.ndarray:
    """Whether some point is strictly nearer to the row than the limit, as measured from differences.

    Rows are halved along their widest axis while that leaves fewer points near their box;
    products of matrices then meet a box's rows with the points near it.
    """
    out, fine = np.zeros(len(x), bool), np.flatnonzero(finite(points))
    todo = [(np.flatnonzero(finite(x)), fine, 0)]
    while todo:
        rows, near, idle = todo.pop()
        if not (len(rows) and len(near)):
            continue
        low, high = x[rows].min(0), x[rows].max(0)
        z = points[near]
        gap = np.maximum(np.maximum(low - z, z - high), 0)
        left = near[(gap * gap).sum(1) <= limit2 * (1 + 1e-9)]
        # Where boxes rule out next to nothing, as with many numbers to a point, halving ends.
        idle = idle + 1 if len(left) > 0.9 * len(near) else 0
        if len(rows) > BOX and len(left) > 32 and idle < 4:
            at = x[rows, (high - low).argmax()]
            half = np.argpartition(at, len(rows) // 2)
            todo += [(rows[half[: len(rows) // 2]], left, idle), (rows[half[len(rows) // 2 :]], left, idle)]
            continue
        step = max(1, TABLE // max(1, len(left)))
        for s in range(0, len(rows) if len(left) else 0, step):
            own = rows[s : s + step]
            d, off = _rough(x[own], points[left])
            least = d.min(1)
            out[own] = least < limit2 - off
            open_ = np.flatnonzero((least >= limit2 - off) & (least < limit2 + off))
            r, c = np.nonzero(d[open_] < (limit2 + off[open_])[:, None])
            out[own[open_[r[exact(x[own[open_]], points[left], r, c) < limit2]]]] = True
    return out


def _to_bound(d: np.ndarray, metric: str) -> np.ndarray:
    """What obeys the triangle inequality."""
    return np.sqrt(np.maximum(d, 0)) if metric == "l2" else d


@dataclass(frozen=True)
class Cells:
    """A line for each unit: its pivot, the least and largest distance of its points from it, their count and lowest number."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    first: np.ndarray
    metric: str = "l2"

    def reach(self, x: np.ndarray) -> np.ndarray:
        """(rows, units): no point of the unit is nearer than this; with room for rounding."""
        if not len(self.pivots):
            return np.zeros((len(x), len(self.first)))
        if self.metric == "l2":
            d, off = _rough(x, self.pivots)
            # The root of a squared distance near zero magnifies its rounding.
            d, off = np.sqrt(np.maximum(d, 0)), np.sqrt(off)[:, None]
        else:
            d = distances(x, self.pivots, self.metric)
            off = 1e-12 * (1 + np.abs(x).sum(1) + np.abs(self.pivots).sum(1).max(initial=0))[:, None]
        d = d[:, self.pivot]
        reach = np.maximum(d - self.high, self.low - d) * (1 - 1e-12) - off
        if self.metric == "so2":  # a metric among angles only
            reach[np.abs(x[:, -1]) > np.pi] = 0
        return reach


    def rooms(self) -> np.ndarray:
        """The room of each unit: consecutive units with about ``ROOM`` numbers."""
        begins = np.cumsum(self.size) - self.size
        return np.unique(begins // max(1, ROOM // max(1, self.pivots.shape[1])), return_inverse=True)[1].astype(np.int32)

    def part(self, units: np.ndarray) -> Cells:
        return Cells(self.pivots, *(c[units] for c in (self.pivot, self.low, self.high, self.size, self.first)), self.metric)


def build(points: DataFrame, metric: str = "l2", unit: int | None = None) -> tuple[Cells, DataFrame]:
    """The cells of ``points`` (id, tag, z), and the points with their ``unit``, written in its order. Points that match nothing are left out."""
    spark, unit = points.sparkSession, unit or UNIT
    fine = F.col("z").isNotNull() & F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    points = points.where(fine).select("id", "tag", "z")
    total = points.count()
    some = points.select("z").orderBy(F.xxhash64("id", "tag"), "z").limit(min(PIVOTS, max(1, -(-2 * total // unit)))).collect()
    pivots = np.unique(np.array([r[0] for r in some], float), axis=0) if some else np.zeros((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("z"), pivots.shape[1])
                if metric == "l2":
                    far, own = nearest(x, pivots)
                else:
                    d = distances(x, pivots, metric)
                    own = d.argmin(1)
                    far = d[np.arange(len(x)), own]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(_to_bound(far, metric))], ["id", "tag", "z", "pivot", "far"])

    near = points.mapInArrow(assign, f"{POINT}, pivot int, far double")
    # Equal points part by the hash of their number, so that no range is one vector's.
    placed, _ = ranked(near.withColumn("tie", F.xxhash64("id", "tag")), "pivot", "far", "tie")
    counts = sorted((r[0], r[1]) for r in placed.groupBy("pivot").count().collect())
    rows, begin, first = [], 0, 0
    for pivot, n in counts:
        rows.append((pivot, begin, first))
        begin, first = begin + n, first + -(-n // unit)
    starts = spark.createDataFrame(rows, "pivot int, begin long, first int")
    number = (F.col("first") + F.floor((F.col("rank") - F.col("begin")) / unit)).cast("int")
    done = materialise(placed.join(F.broadcast(starts), "pivot").select(number.alias("unit"), "id", "tag", "z", "pivot", "far").sortWithinPartitions("unit"))
    lines = sorted(done.groupBy("unit").agg(F.first("pivot"), F.min("far"), F.max("far"), F.count("*"), F.min("id")).collect())
    columns = [np.array([line[i] for line in lines]) for i in range(1, 6)] if lines else [np.zeros(0, int)] * 5
    if metric == "so2" and lines and done.agg(F.max(F.abs(F.element_at("z", -1)))).first()[0] > np.pi:
        columns[1], columns[2] = np.zeros(len(lines)), np.full(len(lines), np.inf)
    return Cells(pivots, *columns, metric), done.select("unit", "id", "tag", "z")


def blocks(points: DataFrame, begin: int, end: int, unit: int | None = None) -> tuple[Cells, DataFrame]:
    """Few points (id, tag, z) with ids from ``begin`` to ``end``: units of consecutive ids, without pivots or bounds, and without a job."""
    unit = unit or UNIT
    first = np.arange(begin, max(end, begin + 1), unit)
    none = np.zeros(0)
    return Cells(np.zeros((0, 0)), none, none, none, none, first), points.select(F.floor((F.col("id") - begin) / unit).cast("int").alias("unit"), "id", "tag", "z")


#: (number of the query, its tag, number of the point, its tag) to whether they may match.
Rule = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _route(queries: DataFrame, cells: Cells, bound: float | None, home: bool, earlier: bool = False) -> DataFrame:
    """Queries with each ``unit`` that they must meet: the most promising, or all within ``bound``; with ``earlier`` only units that hold a lower number."""
    own = queries.columns
    width = cells.pivots.shape[1] if len(cells.pivots) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(own.index("z")), width)
            able = np.flatnonzero(finite(x))
            step = max(1, TABLE // max(1, len(cells.first)))
            for s in range(0, len(able), step):
                mine = able[s : s + step]
                reach = cells.reach(x[mine])
                if home:
                    rows, units = np.arange(len(mine)), reach.argmin(1)
                else:
                    need = reach <= bound * (1 + 1e-12)
                    if earlier:
                        need &= cells.first < b.column(own.index("id")).to_numpy()[mine][:, None]
                    rows, units = np.nonzero(need)
                out = b.take(pa.array(mine[rows])).select(["id", "tag", "z"])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(units.astype(np.int32))], ["id", "tag", "z", "unit"])

    return queries.mapInArrow(run, f"{POINT}, unit int")


def _meet(routed: DataFrame, points: DataFrame, work: Callable, schema: str, queries: int | None = None, folder: int | None = None) -> DataFrame:
    """``work`` on each batch of queries and the points of its unit. The queries of a unit are dealt to as many tasks as they are many, each with the unit's points."""
    if folder:
        # Stored points lie in folders of so many units: a line for each that is met, and no other is read.
        met = [r[0] for r in routed.select(F.floor(F.col("unit") / folder).cast("int")).distinct().collect()]
        points = points.where(F.col("part").isin(met))
    # The counts are looked up, one for each unit; rows of a hot unit are not shuffled for it.
    counts = routed.groupBy("unit").agg(F.ceil(F.count("*") / (queries or QUERIES)).cast("int").alias("salts"))
    met = points.join(counts, "unit").select("unit", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), "id", "tag", "z")
    asked = routed.join(counts, "unit").select("unit", F.pmod(F.xxhash64("id", "tag"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"), "id", "tag", "z")
    dealt = met.unionByName(asked).repartition("unit", "salt").sortWithinPartitions("unit", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, there = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("unit", "salt", "side")], 1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(keys)]):
                part, key = b.slice(s, e - s), tuple(keys[s, :2])
                if key != at:
                    at, held, there = key, [], None
                if keys[s, 2] == 0:
                    held.append(part)
                    continue
                if there is None and held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    there = (t.column("id").to_numpy(), t.column("tag").to_numpy(), matrix(t.column("z").chunk(0)))
                if there is not None:
                    yield from work(part, *there)

    return dealt.mapInArrow(run, schema)


def pairs(queries: DataFrame, cells: Cells, points: DataFrame, limit: float, rule: Rule | None = None, earlier: bool = False, kinds: bool = False) -> DataFrame:
    """(id, other) of queries and points that are strictly nearer than ``limit`` and that the rule allows, with ``earlier`` only points of a lower number. ``limit`` is a plain distance; only ``l2``.

    With ``kinds`` also ``kind``: the last bit of the query's tag, and twice that of the point's.
    """
    routed = _route(queries, cells, limit, False, earlier)
    if len(cells.pivots):
        routed = materialise(routed)

    def work(part: pa.RecordBatch, ids: np.ndarray, tags: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, tag = part.column("id").to_numpy(), part.column("tag").to_numpy()
        rows, columns = within(matrix(part.column("z"), z.shape[1]), z, limit * limit)
        fine = ids[columns] < own[rows] if earlier else np.ones(len(rows), bool)
        if rule is not None:
            fine &= rule(own[rows], tag[rows], ids[columns], tags[columns])
        rows, columns = rows[fine], columns[fine]
        kind = [pa.array(((tag[rows] & 1) + 2 * (tags[columns] & 1)).astype(np.int32))] if kinds else []
        yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(ids[columns]), *kind], ["id", "other", *(["kind"] if kinds else [])])

    return _meet(routed, points, work, "id long, other long" + (", kind int" if kinds else ""))


def _best(d: np.ndarray, ids: np.ndarray, k: int | None, radius: float | None) -> list[np.ndarray]:
    """The columns of each row's ``k`` nearest, by distance and number, within the radius if there is one."""
    out = []
    for row in d:
        near = np.flatnonzero(row < radius) if radius is not None else np.arange(len(row))
        if k is not None and len(near) > k:
            # All that tie with the k-th stay until numbers decide.
            least = np.partition(row[near], k - 1)[k - 1]
            near = near[row[near] <= least]
        near = near[np.lexsort((ids[near], row[near]))]
        out.append(near if k is None else near[:k])
    return out


def find(x: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int | None, radius: float | None, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, numbers, distances) of each row's matches in order."""
    able = finite(x)
    ids, points = ids[finite(points)], points[finite(points)]
    sizes, names, far = np.zeros(len(x), np.int64), [np.zeros(0, np.int64)], [np.zeros(0)]
    step = max(1, TABLE // max(1, len(points)))
    for s in range(0, len(x) if len(points) else 0, step):
        rows = np.flatnonzero(able[s : s + step]) + s
        if metric == "l2" and k == 1 and radius is None:
            order = np.argsort(ids, kind="stable")
            d, at = nearest(x[rows], points[order])
            sizes[rows] = 1
            names.append(ids[order][at])
            far.append(d)
            continue
        d = distances(x[rows], points, metric)
        for i, row, best in zip(rows, d, _best(d, ids, k, radius)):
            sizes[i] = len(best)
            names.append(ids[best])
            far.append(row[best])
    return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(names), np.concatenate(far)


def _reached(cells: Cells) -> Callable:
    """Of a batch (id, tag, z, unit, d), strip by strip, the rows and whether each unit but the home one lies within what they found."""

    def run(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x = matrix(b.column("z"), cells.pivots.shape[1])
        home, far = b.column("unit").to_numpy(), _to_bound(b.column("d").to_numpy(zero_copy_only=False), cells.metric)
        step = max(1, TABLE // max(1, len(cells.first)))
        for s in range(0, len(x), step):
            need = cells.reach(x[s : s + step]) <= far[s : s + step, None] * (1 + 1e-12)
            need[np.arange(len(need)), home[s : s + step]] = False
            yield np.arange(s, s + len(need)), need

    return run


class _Room:
    """The points of a room as arrays, by strips of units."""

    def __init__(self, parts: list[pa.RecordBatch], cells: Cells):
        t = pa.Table.from_batches(parts).combine_chunks()
        unit = t.column("unit").to_numpy()
        order = np.lexsort((t.column("id").to_numpy(), unit))
        self.unit, self.ids, self.z = unit[order], t.column("id").to_numpy()[order], matrix(t.column("z").chunk(0))[order]
        self.units, starts = np.unique(self.unit, return_index=True)
        self.cells = cells.part(self.units)
        ends = [*starts[1:], len(unit)]
        self.strips, begin = [], 0
        for i, end in enumerate(ends):
            if end - starts[begin] >= STRIP or i == len(ends) - 1:
                self.strips.append((begin, i + 1, int(starts[begin]), int(end)))
                begin = i + 1
        self._sides: dict[int, tuple] = {}

    def _side(self, p: int, q: int) -> tuple:
        if p not in self._sides:
            middle = self.z[p:q].mean(0)
            b = self.z[p:q] - middle
            b2 = (b * b).sum(1)
            self._sides[p] = middle, np.concatenate([b, b2[:, None]], 1).T, np.sqrt(b2.max(initial=0))
        return self._sides[p]

    def near(self, x: np.ndarray, p: int, q: int, bound: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, points, distances) of at least all pairs within the bounds, or of each row's nearest where there is none."""
        if self.cells.metric != "l2":
            d = distances(x, self.z[p:q], self.cells.metric)
            rows, columns = np.nonzero(d <= bound[:, None])
            return rows, columns + p, d[rows, columns]
        middle, side, most = self._side(p, q)
        a = x - middle
        a2 = (a * a).sum(1)
        off = 16 * (x.shape[1] + 8) * EPS * (np.sqrt(a2) + most) ** 2
        # 2ab - |b|^2 is large where the distance is small.
        g = np.concatenate([2 * a, np.full((len(a), 1), -1.0)], 1) @ side
        least = a2 - bound - off
        free = np.flatnonzero(~np.isfinite(bound))
        if len(free) and k is not None and 2 * k < q - p:
            # Fewer than k were found in the home unit, which may lie here again.
            least[free] = np.partition(g[free], -2 * k, 1)[:, -2 * k] - 2 * off[free]
        rows, columns = np.nonzero(g >= least[:, None])
        return rows, columns + p, exact(x, self.z, rows, columns + p)

    def meet(self, x: np.ndarray, home: np.ndarray, bound: np.ndarray, k: int | None, radius: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, numbers, distances) of what is nearer than the bounds, ``k`` at most for each row, by row, distance and number."""
        bound, reach = bound.copy(), self.cells.reach(x)
        rows, names, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for begin, end, p, q in self.strips:
            need = (reach[:, begin:end] <= _to_bound(bound, self.cells.metric)[:, None] * (1 + 1e-12)) & (self.units[begin:end] != home[:, None])
            asked, fresh = np.flatnonzero(need.any(1)), []
            step = max(1, TABLE // (q - p))
            for s in range(0, len(asked), step):
                own = asked[s : s + step]
                r, c, d = self.near(x[own], p, q, bound[own], k)
                r = own[r]
                fine = (self.unit[c] != home[r]) & (d <= bound[r])
                if radius is not None:
                    fine &= d < radius
                fresh.append((r[fine], self.ids[c[fine]], d[fine]))
            if not any(len(f[0]) for f in fresh):
                continue
            rows, names, far = (np.concatenate([old, *(f[i] for f in fresh)]) for i, old in enumerate((rows, names, far)))
            order = np.lexsort((names, far, rows))
            rows, names, far = rows[order], names[order], far[order]
            if k is not None:
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                nth = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
                last = nth == k - 1
                bound[rows[last]] = np.minimum(bound[rows[last]], far[last])
                rows, names, far = rows[nth < k], names[nth < k], far[nth < k]
        return rows, names, far


def _in_rooms(first: DataFrame, cells: Cells, points: DataFrame, k: int | None, radius: float | None) -> DataFrame:
    """(id, names, far) of what the queries of ``first`` (id, tag, z, unit, d) find outside their home unit."""
    spark, room = first.sparkSession, cells.rooms()
    starts, reached = np.flatnonzero(np.diff(room, prepend=-1)), _reached(cells)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, need in reached(b) if b.num_rows else ():
                rows, where = np.nonzero(np.logical_or.reduceat(need, starts, 1))
                out = b.take(pa.array(own[rows]))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(where.astype(np.int32))], [*out.schema.names, "room"])

    routed = materialise(first.select("id", "z", "unit", "d").mapInArrow(route, "id long, z array<double>, unit int, d double, room int"))
    # A line for each room.
    lines, begin = [], 0
    for where, n in sorted((r[0], r[1]) for r in routed.groupBy("room").count().collect()):
        lines.append((where, begin, -(-n // GUESTS)))
        begin += lines[-1][2]
    dealt = F.broadcast(spark.createDataFrame(lines, "room int, begin int, salts int"))
    units = F.broadcast(spark.createDataFrame([(i, int(r)) for i, r in enumerate(room)], "unit int, room int"))
    met = points.select("unit", "id", "z").join(units, "unit").join(dealt, "room").select(F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("salts") - 1)).alias("task"), F.lit(0).alias("side"), "id", "z", "unit", F.lit(0.0).alias("d"))
    asked = routed.join(dealt, "room").select((F.col("begin") + F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int").alias("task"), F.lit(1).alias("side"), "id", "z", "unit", "d")
    together = met.unionByName(asked).repartitionById(max(1, min(begin, 10_000)), F.col("task")).sortWithinPartitions("task", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, there = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("task", "side")], 1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(keys)]):
                part = b.slice(s, e - s)
                if keys[s, 0] != at:
                    at, held, there = keys[s, 0], [], None
                if keys[s, 1] == 0:
                    held.append(part)
                    continue
                if there is None and held:
                    there, held = _Room(held, cells), []
                if there is not None:
                    x = matrix(part.column("z"), there.z.shape[1])
                    rows, names, far = there.meet(x, part.column("unit").to_numpy(), part.column("d").to_numpy(), k, radius)
                    found, sizes = np.unique(rows, return_counts=True)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(found)), *(pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (names, far))], ["id", "names", "far"])

    return together.mapInArrow(run, "id long, names array<long>, far array<double>")


def _counts(first: DataFrame, cells: Cells) -> dict[int, int]:
    """How many queries reach each unit beside their own; a line for each unit."""
    reached = _reached(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cells.first), np.int64)
        for b in batches:
            for _, need in reached(b) if b.num_rows else ():
                total += need.sum(0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["unit", "n"])

    every = first.select("id", "z", "unit", "d").mapInArrow(run, "unit int, n long").groupBy("unit").agg(F.sum("n"))
    return {r[0]: r[1] for r in every.collect()}


def search(queries: DataFrame, cells: Cells, points: DataFrame, k: int | None = 1, radius: float | None = None, report: dict | None = None, folder: int | None = None) -> DataFrame:
    """(id, nth, label, d) of each query's ``k`` nearest points, or of all within a radius, or both; ``queries`` have ids that are unique.

    Meeting the most promising unit bounds the rest; ``report`` gets the share of
    distances that the bounds spared.
    """
    metric = cells.metric
    if not len(cells.first):
        return queries.sparkSession.createDataFrame([], "id long, nth int, label int, d double")

    def work(part: pa.RecordBatch, ids: np.ndarray, tags: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = matrix(part.column("z"), z.shape[1])
        offsets, names, far = find(x, ids, z, k, radius, metric)
        unit = pa.array(np.full(len(x), part.column("unit")[0].as_py(), np.int32))
        # The bound for further units: the k-th match, or all that is within the radius.
        sizes = np.diff(offsets)
        last = np.full(len(x), np.inf if radius is None else radius)
        if k is not None and len(far):
            last = np.where(sizes >= k, far[np.maximum(offsets[1:] - 1, 0)], last)
        lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v)) for v in (names, far)]
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tag"), part.column("z"), unit, pa.array(last), *lists], ["id", "tag", "z", "unit", "d", "names", "far"])

    schema = f"{POINT}, unit int, d double, names array<long>, far array<double>"
    first = materialise(_meet(materialise(_route(queries, cells, None, True)), points, work, schema, None, folder))
    if report is not None or folder:
        beside = _counts(first, cells)
    if folder:
        # Stored points lie in folders of so many units; no other folder is read.
        points = points.where(F.col("part").isin(sorted({u // folder for u in beside})))
    second = _in_rooms(first, cells, points, k, radius)
    if report is not None:
        own = {r[0]: r[1] for r in first.groupBy("unit").count().collect()}
        done = sum(int(cells.size[u]) * n for part in (own, beside) for u, n in part.items())
        every = first.count() * int(cells.size.sum())
        report.update(distances=done, possible=every, spared=1 - done / every if every else 0.0)
    both = first.select("id", "names", "far").unionByName(second.select("id", "names", "far"))
    if k == 1:
        best = both.where(F.size("names") > 0).groupBy("id").agg(F.min(F.struct(F.get("far", F.lit(0)).alias("d"), F.get("names", F.lit(0)).alias("label"))).alias("b"))
        return best.select("id", F.lit(1).alias("nth"), F.col("b.label").cast("int").alias("label"), F.col("b.d").alias("d"))
    every = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("far").alias("far"), F.col("names").alias("names")))))
    found = both.groupBy("id").agg((F.slice(every, 1, k) if k is not None else every).alias("b"))
    return found.select("id", F.posexplode("b").alias("nth", "p")).select("id", (F.col("nth") + 1).alias("nth"), F.col("p.names").cast("int").alias("label"), F.col("p.far").alias("d"))
