"""Voxel images as NIfTI-1 files: a header, then the grid, first axis fastest."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fascicle.plans.durable import discard

from fascicle.sources.sink import filesystem, positions, ranges, refuse, write


def read_affine(path: str) -> tuple[tuple[int, int, int], np.ndarray]:
    """(shape, affine) from a template's header: 3 x 4, from voxel indices to the world, of whatever orientation. A singular one is refused."""
    fs, inner = filesystem(path)
    with fs.open_input_stream(inner, compression="gzip" if path.endswith(".gz") else None) as f:
        head = f.read(348)
    order = "<" if struct.unpack_from("<i", head, 0)[0] == 348 else ">"
    dims = struct.unpack_from(f"{order}8h", head, 40)
    pixel = np.array(struct.unpack_from(f"{order}8f", head, 76), float)
    quatern, straight = struct.unpack_from(f"{order}2h", head, 252)
    if straight > 0:
        affine = np.array([struct.unpack_from(f"{order}4f", head, 280 + 16 * i) for i in range(3)], float)
    elif quatern > 0:
        # The format's quaternion: its real part follows from the other three.
        b, c, d, *shift = struct.unpack_from(f"{order}6f", head, 256)
        a = max(0.0, 1.0 - b * b - c * c - d * d) ** 0.5
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine = np.concatenate([turn * pixel[1:4] * [1, 1, -1.0 if pixel[0] < 0 else 1.0], np.array(shift, float)[:, None]], 1)
    else:
        affine = np.concatenate([np.diag(pixel[1:4]), np.zeros((3, 1))], 1)
    if not np.isfinite(affine).all() or abs(np.linalg.det(affine[:, :3])) < 1e-12:
        raise ValueError(f"{path}: its axes don't span the space")
    return tuple(int(d) for d in dims[1:4]), affine


def read_grid(path: str) -> tuple[tuple[int, int, int], tuple[float, float, float], tuple[float, float, float]]:
    """(shape, voxel sizes, origin) of a template that runs along x, y and z; another one has an affine only."""
    shape, affine = read_affine(path)
    sizes = np.diag(affine[:, :3])
    if (np.abs(affine[:, :3] - np.diag(sizes)) > 1e-4 * np.abs(sizes).max()).any() or (sizes <= 0).any():
        raise ValueError(f"{path}: its axes are turned or flipped; take its affine")
    return shape, tuple(sizes.tolist()), tuple((affine[:, 3] - sizes / 2).tolist())


#: Voxels of a slab, which is compressed by itself.
SLAB = 1 << 20


def _head(shape: tuple[int, int, int], rows: np.ndarray, sizes: tuple[float, float, float]) -> bytes:
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *sizes, 1, 1, 1, 1)
    struct.pack_into("<f", head, 108, 352.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    for i in range(3):
        struct.pack_into("<4f", head, 280 + 16 * i, *rows[i])
    head[344:348] = b"n+1\0"
    return bytes(head)


def write_nifti(voxels: DataFrame, path: str, shape: tuple[int, int, int], size: float | tuple[float, float, float], origin: tuple[float, float, float], force: bool = False, affine: np.ndarray | None = None) -> None:
    """Sparse voxels as a dense image. Each task writes its voxels where they belong; for ``.nii.gz`` it compresses slabs, which follow each other in the file.

    ``affine`` (3 x 4, from voxel indices to the world) stands for ``size`` and ``origin`` where axes are turned.
    """
    refuse(path, force)
    if affine is None:
        sizes = tuple(float(s) for s in np.broadcast_to(size, 3))
        affine = np.concatenate([np.diag(sizes), (np.array(origin) + np.array(sizes) / 2)[:, None]], 1)
    head = _head(shape, affine, tuple(np.sqrt((affine[:, :3] ** 2).sum(0)).tolist()))
    inside = voxels.select("i", "j", "k", F.col("value").cast("float").alias("value"))
    for c, n in zip("ijk", shape):
        inside = inside.where((F.col(c) >= 0) & (F.col(c) < n))
    at = F.col("i") + F.lit(shape[0]).cast("long") * (F.col("j") + F.lit(shape[1]).cast("long") * F.col("k"))
    flat = inside.select(at.alias("at"), "value")
    total = int(np.prod(shape, dtype=np.int64))
    if not path.endswith(".gz"):
        parts = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                place = b.column("at").to_numpy()
                yield ranges(352 + 4 * place, np.full(len(place), 4), b.column("value").to_numpy(zero_copy_only=False).astype("<f4").tobytes())

        write(flat.repartitionByRange(parts, "at").sortWithinPartitions("at").mapInArrow(run, "at long, data binary"), path, 352 + 4 * total, [(0, head)])
        return
    # As many slabs as the grid has, empty ones too; a slab's voxels are one task's.
    slabs = voxels.sparkSession.range(-(-total // SLAB)).select(F.col("id").alias("slab"))
    held = flat.groupBy(F.floor(F.col("at") / SLAB).alias("slab")).agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("value"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for slab, place, value in zip(b.column("slab").to_pylist(), b.column("at"), b.column("value")):
                dense = np.zeros(min(SLAB, total - slab * SLAB), "<f4")
                if place.is_valid:
                    dense[place.values.to_numpy() - slab * SLAB] = value.values.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([slab]), pa.array([gzip.compress(dense.tobytes(), mtime=0)], pa.binary())], ["slab", "data"])

    packed, _, size_ = positions(slabs.join(held, "slab", "left").mapInArrow(pack, "slab long, data binary"), F.length("data"), "slab")
    first = gzip.compress(head, mtime=0)
    write(packed.select((F.col("before") + len(first)).alias("at"), "data"), path, len(first) + size_, [(0, first)])
    discard(packed)
