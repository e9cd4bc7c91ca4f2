"""Fixed-stride binary files: latents, centres, scores, labels and weights.

The files have no header; a row count is the size divided by the stride, and a
partial row at the end is ignored. Rows are identified by their position. A Python
data source cuts each file into row ranges, so one large file is read by many tasks;
files are opened through Arrow's file systems.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fascicle.plans.durable import discard, ranked
from fascicle.schema import ModelSpec
from fascicle.sources.sink import filesystem, ranges, refuse, write

#: Rows of one read.
CHUNK = 1 << 16


def listed(path: str, patterns: list[str]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's files by pattern: all of the first pattern in name order, then of the next."""
    fs, inner = filesystem(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    files = [f for f in fs.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File]
    found = []
    for pattern in patterns:
        found += sorted((prefix + f.path, f.size) for f in files if fnmatch.fnmatch(f.base_name.lower(), pattern))
    return found


@dataclass
class RowRange(InputPartition):
    path: str
    start: int
    count: int


class FixedStrideReader(DataSourceReader):
    def __init__(self, options):
        self.width, self.kind = int(options["width"]), np.dtype(options["dtype"])
        self.rows = max(1, int(options.get("rowsPerPartition", 1 << 20)))
        self.files = listed(options["path"], options.get("patterns", "*").split(","))

    def partitions(self):
        out = []
        for path, size in self.files:
            n = size // (self.width * self.kind.itemsize)
            out += [RowRange(path, s, min(self.rows, n - s)) for s in range(0, n, self.rows)]
        return out or [RowRange("", 0, 0)]

    def read(self, partition):
        if not partition.count:
            return
        fs, inner = filesystem(partition.path)
        stride = self.width * self.kind.itemsize
        with fs.open_input_file(inner) as f:
            for s in range(partition.start, partition.start + partition.count, CHUNK):
                n = min(CHUNK, partition.start + partition.count - s)
                values = np.frombuffer(f.read_at(n * stride, s * stride), self.kind).astype(float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.width), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(np.arange(s, s + n)), lists], ["src", "sid", "values"])


class FixedStride(DataSource):
    """``format("fixed_stride")`` with options ``path``, ``width``, ``dtype``, and ``patterns`` for folders."""

    @classmethod
    def name(cls):
        return "fixed_stride"

    def schema(self):
        return "src string, sid long, values array<double>"

    def reader(self, schema):
        return FixedStrideReader(self.options)


def _load(spark: SparkSession, path: str, width: int, dtype: str, patterns: str = "*") -> DataFrame:
    spark.dataSource.register(FixedStride)
    return spark.read.format("fixed_stride").option("width", width).option("dtype", dtype).option("patterns", patterns).load(path)


def read_latents(spark: SparkSession, path: str, spec: ModelSpec, centres_too: bool = False) -> DataFrame:
    """(src, sid, z_fwd, z_rev) of a ``.bin`` or ``.clc`` file, or of a folder's ``.bin`` and, if asked, ``.clc`` files. The declared type always applies."""
    n = spec.latent_dim
    raw = _load(spark, path, 2 * n, spec.numpy_type, "*.bin,*.clc" if centres_too else "*.bin")
    return raw.select("src", "sid", F.slice("values", 1, n).alias("z_fwd"), F.slice("values", n + 1, n).alias("z_rev"))


def read_centres(spark: SparkSession, path: str, spec: ModelSpec) -> DataFrame:
    n = spec.latent_dim
    raw = _load(spark, path, 2 * n, "<f4")
    return raw.select((F.col("sid") + 1).cast("int").alias("label"), F.slice("values", 1, n).alias("z_fwd"), F.slice("values", n + 1, n).alias("z_rev"))


def read_scores(spark: SparkSession, path: str, name: str = "score") -> DataFrame:
    """(sid, score) of an ``.ano`` or weight file."""
    return _load(spark, path, 1, "<f4").select("sid", F.get("values", F.lit(0)).cast("float").alias(name))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, 1, "<i4").select("sid", F.get("values", F.lit(0)).cast("int").alias("label"))


def write_fixed(df: DataFrame, path: str, order: str, columns: list[str], dtype: str, force: bool = False, width: int | None = None) -> None:
    """Rows in order (of their source first, if they have one) as one file. Each task writes its rows where their rank says.

    Rows of another number of values than ``width``, or than the others, are refused: the file does not come about.
    """
    refuse(path, force)
    kind = np.dtype(dtype)
    keys = ["src", order] if "src" in df.columns else [order]
    values = F.concat(*[F.col(c) if df.schema[c].dataType.simpleString().startswith("array") else F.array(F.col(c)) for c in columns])
    rows, n = ranked(df.select(*keys, values.alias("values")), *keys)
    least, most = rows.agg(F.min(F.size("values")), F.max(F.size("values"))).first()
    width = (most or 0) if width is None else width
    for found in (least, most):
        if found not in (None, width):
            discard(rows)
            raise ValueError(f"a row of {found} numbers, but the model's rows have {width}")
    stride = width * kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                data = b.column("values").flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
                yield ranges(b.column("rank").to_numpy() * stride, np.full(b.num_rows, stride), data)

    write(rows.select("rank", "values").mapInArrow(run, "at long, data binary"), path, n * stride, [])
    discard(rows)


def write_latents(df: DataFrame, path: str, spec: ModelSpec, force: bool = False) -> None:
    write_fixed(df, path, "sid", ["z_fwd", "z_rev"], spec.numpy_type, force, 2 * spec.latent_dim)


def write_centres(df: DataFrame, path: str, force: bool = False) -> None:
    write_fixed(df, path, "label", ["z_fwd", "z_rev"], "<f4", force)


def write_scores(df: DataFrame, path: str, force: bool = False) -> None:
    write_fixed(df, path, "sid", ["score"], "<f4", force)


def write_labels(df: DataFrame, path: str, force: bool = False) -> None:
    write_fixed(df, path, "sid", ["label"], "<i4", force)


def pending(spark: SparkSession, inputs: list[str], outputs: list[str], skip: bool, force: bool) -> list[tuple[str, str]]:
    """The (input, output) pairs that are still to be made: existing outputs are left out with ``skip``, remade with ``force``, else an error."""
    out = []
    for i, o in zip(inputs, outputs):
        fs, inner = filesystem(o)
        if fs.get_file_info(inner).type != pafs.FileType.NotFound and not force:
            if not skip:
                raise FileExistsError(o)
            continue
        out.append((i, o))
    return out
