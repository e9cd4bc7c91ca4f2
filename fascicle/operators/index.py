"""Searches over points that are kept: an index on disk, and one that points come to and go from.

A stored index is the cells of :mod:`fascicle.operators.metric` as tables: the points in
folders of ``UNITS`` units each, in order, and a line for each unit and pivot. A search
reads the lines, and of the points only the folders whose units its bounds do not rule
out.

A dynamic index is made of stored ones by the logarithmic method. Level i holds up to
``base * 2**i`` points. New points are merged with the levels below the first one that
holds them all, so that a point is rewritten once for each level it rises. Removed
labels are noted, and their points left out of searches until a merge drops them; when
half of all points are noted, everything is merged. A search asks each level and keeps
the best. Changes are a new manifest, written last.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.operators import metric as cells_of
from fascicle.operators.metric import Cells
from fascicle.operators.search import checked
from fascicle.plans.durable import discard, materialise

#: Units of a folder.
UNITS = 8
_CELLS = "unit int, pivot int, low double, high double, size long, first long"


def save(points: DataFrame, path: str, metric: str = "l2", unit: int | None = None) -> None:
    """Points (label, z_fwd) as an index at ``path``."""
    spark = points.sparkSession
    named = points.select(F.col("label").cast("long").alias("id"), F.lit(0).cast("long").alias("tag"), F.col("z_fwd").cast("array<double>").alias("z"))
    cells, placed = cells_of.build(named, metric, unit)
    placed.withColumn("part", F.floor(F.col("unit") / UNITS).cast("int")).repartition("part").sortWithinPartitions("unit").write.partitionBy("part").parquet(f"{path}/points")
    lines = [(i, int(p), float(low), float(high), int(n), int(f)) for i, (p, low, high, n, f) in enumerate(zip(cells.pivot, cells.low, cells.high, cells.size, cells.first))]
    spark.createDataFrame(lines, _CELLS).coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(i, p.tolist(), metric) for i, p in enumerate(cells.pivots)], "pivot int, z array<double>, metric string").coalesce(1).write.parquet(f"{path}/pivots")
    discard(placed)


def load(spark: SparkSession, path: str) -> tuple[Cells, DataFrame]:
    """The cells of a stored index, and its points as they lie."""
    pivots = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()
    lines = spark.read.parquet(f"{path}/cells").orderBy("unit").collect()
    column = lambda c: np.array([r[c] for r in lines])
    cells = Cells(np.array([p["z"] for p in pivots], float), *(column(c) for c in ("pivot", "low", "high", "size", "first")), pivots[0]["metric"] if pivots else "l2")
    return cells, spark.read.schema(f"unit int, {cells_of.POINT}, part int").parquet(f"{path}/points")


def _asked(rows: DataFrame, key: str) -> DataFrame:
    return materialise(rows.select(F.col(key).alias("key"), F.col("z_fwd").cast("array<double>").alias("z")).withColumn("id", F.monotonically_increasing_id()))


def _queries(asked: DataFrame) -> DataFrame:
    return asked.select("id", F.lit(0).cast("long").alias("tag"), "z")


def search(rows: DataFrame, path: str, k: int | None = 1, radius: float | None = None, key: str = "sid", report: dict | None = None) -> DataFrame:
    """(``key``, nth, label, distance) as :func:`fascicle.operators.search.neighbours` gives it, from a stored index."""
    checked(k, radius)
    asked = _asked(rows, key)
    cells, points = load(rows.sparkSession, path)
    found = cells_of.search(_queries(asked), cells, points, k, radius, report, UNITS)
    return asked.select("id", "key").join(found, "id").select(F.col("key").alias(key), "nth", "label", F.col("d").alias("distance"))


@dataclass
class Level:
    path: str
    size: int


@dataclass
class DynamicIndex:
    """An index in ``folder``; ``moved`` counts the points that additions have written, for themselves and for merges."""

    spark: SparkSession
    folder: str
    metric: str = "l2"
    base: int = 1024
    levels: dict[int, Level] = field(default_factory=dict)
    gone: str | None = None
    noted: int = 0
    moved: int = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> DynamicIndex:
        """As the last manifest has it."""
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        names = [f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
        last = max(n for n in names if n.startswith("manifest-"))
        out = None
        for r in spark.read.parquet(f"{folder}/{last}").collect():
            out = out or cls(spark, folder, r["metric"], r["base"], {}, r["gone"], r["noted"], r["moved"])
            if r["path"]:
                out.levels[r["level"]] = Level(r["path"], r["size"])
        out._version = int(last.removeprefix("manifest-"))
        return out

    def __post_init__(self) -> None:
        self._version = 0

    def _publish(self) -> None:
        self._version += 1
        common = (self.metric, self.base, self.gone, self.noted, self.moved)
        lines = [(i, v.path, v.size, *common) for i, v in self.levels.items()] or [(0, None, 0, *common)]
        self.spark.createDataFrame(lines, "level int, path string, size long, metric string, base long, gone string, noted long, moved long").coalesce(1).write.parquet(f"{self.folder}/manifest-{self._version:010d}")

    def _live(self, level: Level) -> DataFrame:
        points = self.spark.read.schema(f"unit int, {cells_of.POINT}, part int").parquet(f"{level.path}/points")
        return points.join(self.spark.read.parquet(self.gone), "id", "left_anti") if self.gone else points

    def points(self) -> DataFrame:
        """(label, z_fwd) of all points that have not gone."""
        every = [self._live(v).select(F.col("id").cast("int").alias("label"), F.col("z").alias("z_fwd")) for v in self.levels.values()]
        return reduce(DataFrame.unionByName, every) if every else self.spark.createDataFrame([], "label int, z_fwd array<double>")

    def _merge(self, fresh: list[DataFrame], n: int, below: list[int]) -> None:
        """One level of the fresh points and what lives in the levels named, where it has room."""
        held = [self._live(self.levels[i]).select(F.col("id").alias("label"), F.col("z").alias("z_fwd")) for i in below]
        every = fresh + held
        path = f"{self.folder}/level-{uuid.uuid4().hex}"
        save(reduce(DataFrame.unionByName, every), path, self.metric)
        size = int(self.spark.read.parquet(f"{path}/cells").agg(F.sum("size")).first()[0] or 0)
        for i in below:
            del self.levels[i]
        at = 0
        while self.base << at < size or at in self.levels:
            at += 1
        self.levels[at] = Level(path, size)
        self.moved += size
        self._note(None)

    def _note(self, more: DataFrame | None) -> None:
        """The labels that have gone and still lie in a level."""
        parts = [self.spark.read.parquet(self.gone)] if self.gone else []
        parts += [more] if more is not None else []
        if not parts:
            return
        there = [self.spark.read.parquet(f"{v.path}/points").select("id") for v in self.levels.values()]
        lying = reduce(DataFrame.unionByName, there) if there else self.spark.createDataFrame([], "id long")
        path = f"{self.folder}/gone-{uuid.uuid4().hex}"
        reduce(DataFrame.unionByName, parts).distinct().join(lying, "id", "left_semi").write.parquet(path)
        self.gone, self.noted = path, self.spark.read.parquet(path).count()

    def add(self, points: DataFrame) -> None:
        """Further points, whose labels must be new."""
        fresh = materialise(points.select(F.col("label").cast("long").alias("label"), F.col("z_fwd").cast("array<double>").alias("z_fwd")))
        n = fresh.count()
        twice = fresh.unionByName(self.points().select(F.col("label").cast("long").alias("label"), "z_fwd")).groupBy("label").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"two points of label {twice[0][0]}")
        if self.gone and not fresh.join(self.spark.read.parquet(self.gone).select(F.col("id").alias("label")), "label", "left_semi").isEmpty():
            # A label that comes back: what lies of it has to go first.
            self._merge([], 0, list(self.levels))
        at, below = 0, []
        while True:
            below = [i for i in self.levels if i <= at]
            if n + sum(self.levels[i].size for i in below) <= self.base << at:
                break
            at += 1
        self._merge([fresh], n, below)
        discard(fresh)
        self._publish()

    def remove(self, labels: DataFrame) -> None:
        """Points of these labels go; labels that are not there do no harm."""
        self._note(labels.select(F.col("label").cast("long").alias("id")))
        if self.levels and 2 * self.noted > sum(v.size for v in self.levels.values()):
            self._merge([], 0, list(self.levels))
        self._publish()

    def search(self, rows: DataFrame, k: int | None = 1, radius: float | None = None, key: str = "sid") -> DataFrame:
        """(``key``, nth, label, distance) over all levels."""
        checked(k, radius)
        asked = _asked(rows, key)
        found = []
        for level in self.levels.values():
            cells, _ = load(self.spark, level.path)
            found.append(cells_of.search(_queries(asked), cells, self._live(level), k, radius, None, UNITS))
        if not found:
            return asked.select(F.col("key").alias(key), F.lit(0).alias("nth"), F.lit(0).alias("label"), F.lit(0.0).alias("distance")).where("false")
        best = F.array_sort(F.collect_list(F.struct("d", "label")))
        every = reduce(DataFrame.unionByName, found).groupBy("id").agg((best if k is None else F.slice(best, 1, k)).alias("b"))
        out = asked.select("id", "key").join(every, "id").select("key", F.posexplode("b").alias("nth", "p"))
        return out.select(F.col("key").alias(key), (F.col("nth") + 1).alias("nth"), F.col("p.label").alias("label"), F.col("p.d").alias("distance"))
