"""One file written by many tasks, each its own byte ranges.

A table of (at, data) says which bytes go where. On a file system with positions each
task writes its ranges straight into the file under a temporary name, as long as it
will be; elsewhere a task's runs are objects beside it, which are strung together when
all are there. Only when every task has succeeded does the file get its name; when one
fails for good nothing is left. No row passes the driver.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from fascicle.plans.durable import materialise

#: Bytes of an object, where there are no positions, and of a copy.
RUN = 16 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Wrote(WriterCommitMessage):
    bytes: int


class RangeWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.held = options["path"], options["temporary"]
        self.size, self.fixed = int(options["size"]), [(at, bytes.fromhex(data)) for at, data in json.loads(options["fixed"])]
        self.positions = options["positions"] == "true"

    def write(self, iterator):
        done = 0
        if self.positions:
            f = os.open(filesystem(self.held)[1], os.O_WRONLY)
            try:
                for b in iterator:
                    for at, data in zip(b.column("at").to_pylist(), b.column("data").to_pylist()):
                        os.pwrite(f, data, at)
                        done += len(data)
            finally:
                os.close(f)
            return Wrote(done)
        fs, inner = filesystem(self.held)
        run, begin = bytearray(), 0

        def flush() -> None:
            if run:
                # A task that is run twice writes the same ranges; a name for each attempt would double them.
                with fs.open_output_stream(f"{inner}/{begin:020d}") as out:
                    out.write(bytes(run))

        for b in iterator:
            for at, data in zip(b.column("at").to_pylist(), b.column("data").to_pylist()):
                if run and (at != begin + len(run) or len(run) >= RUN):
                    flush()
                    run = bytearray()
                begin = begin if run else at
                run += data
                done += len(data)
        flush()
        return Wrote(done)

    def commit(self, messages):
        fs, inner = filesystem(self.held)
        if not self.positions:
            objects = sorted((int(f.base_name), f.path) for f in fs.get_file_info(pafs.FileSelector(inner)))
            pieces = sorted([(at, data) for at, data in self.fixed] + objects, key=lambda p: p[0])
            with fs.open_output_stream(inner + ".whole", compression=None) as out:
                at = 0
                for begin, piece in pieces:
                    out.write(b"\0" * (begin - at))
                    if isinstance(piece, bytes):
                        out.write(piece)
                        at = begin + len(piece)
                        continue
                    at = begin
                    with fs.open_input_stream(piece, compression=None) as source:
                        while chunk := source.read(RUN):
                            out.write(chunk)
                            at += len(chunk)
                out.write(b"\0" * (self.size - at))
            fs.delete_dir(inner)
            inner += ".whole"
        fs.move(inner, filesystem(self.path)[1])

    def abort(self, messages):
        fs, inner = filesystem(self.held)
        kind = fs.get_file_info(inner).type
        if kind == pafs.FileType.Directory:
            fs.delete_dir(inner)
        elif kind == pafs.FileType.File:
            fs.delete_file(inner)


class ByteRanges(DataSource):
    """``format("byte_ranges")``, written only; :func:`write` gives its options."""

    @classmethod
    def name(cls):
        return "byte_ranges"

    def schema(self):
        return "at long, data binary"

    def writer(self, schema, overwrite):
        return RangeWriter(self.options)


def refuse(path: str, force: bool) -> None:
    fs, inner = filesystem(path)
    if fs.get_file_info(inner).type != pafs.FileType.NotFound and not force:
        raise FileExistsError(path)


def write(pieces: DataFrame, path: str, size: int, fixed: list[tuple[int, bytes]], positions: bool | None = None) -> None:
    """``path`` of ``size`` bytes from ``pieces`` (at, data) and a few ``fixed`` ones; what nobody writes is 0."""
    fs, inner = filesystem(path)
    positions = isinstance(fs, pafs.LocalFileSystem) if positions is None else positions
    mark = f".{uuid.uuid4().hex}.tmp"
    if positions:
        with open(inner + mark, "wb") as f:
            f.truncate(size)
            for at, data in fixed:
                f.seek(at)
                f.write(data)
    else:
        fs.create_dir(inner + mark)
    pieces.sparkSession.dataSource.register(ByteRanges)
    options = {"path": path, "temporary": path + mark, "size": str(size), "fixed": json.dumps([(at, data.hex()) for at, data in fixed]), "positions": str(positions).lower()}
    pieces.select("at", "data").write.format("byte_ranges").options(**options).mode("append").save()


def positions(df: DataFrame, size: F.Column, *order: str) -> tuple[DataFrame, int, int]:
    """``df`` with its 0-based ``rank`` by ``order`` and the sum of ``size`` ``before`` it, how many rows there are, and their whole size.

    Parts are sorted side by side and summed as they stream; the driver sees one line for each.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumn("__size", size.cast("long")).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for b in batches:
            ends = np.cumsum(b.column("__size").to_numpy()) + total
            before = np.concatenate([[total], ends[:-1]])[: b.num_rows]
            names = [*b.schema.names, "__at", "__before"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows)), pa.array(before.astype(np.int64))], names)
            n, total = n + b.num_rows, int(ends[-1]) if b.num_rows else total

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields]
    placed = materialise(own.mapInArrow(run, ", ".join([*fields, "__at long", "__before long"])))
    lines, n, total = [], 0, 0
    for part, rows, bytes_ in sorted(tuple(r) for r in placed.groupBy("__part").agg(F.count("*"), F.sum("__size")).collect()):
        lines.append((part, n, total))
        n, total = n + rows, total + bytes_
    base = spark.createDataFrame(lines, "__part int, __n long, __total long")
    out = placed.join(F.broadcast(base), "__part").withColumn("rank", F.col("__n") + F.col("__at")).withColumn("before", F.col("__total") + F.col("__before"))
    out = out.drop("__part", "__at", "__before", "__n", "__total", "__size")
    out.table_path = placed.table_path
    return out, n, total


def runs(places: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """(first, past the last) of the stretches in which each place begins where the one before it ends."""
    if not len(places):
        return []
    cuts = np.flatnonzero(places[1:] != places[:-1] + sizes[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]))


def ranges(places: np.ndarray, sizes: np.ndarray, data: bytes) -> pa.RecordBatch:
    """(at, data) of consecutive chunks of ``data`` with their places, stretches together."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    found = runs(places, sizes)
    return pa.RecordBatch.from_arrays([pa.array([int(places[s]) for s, _ in found], pa.int64()), pa.array([data[ends[s] : ends[e]] for s, e in found], pa.binary())], ["at", "data"])
