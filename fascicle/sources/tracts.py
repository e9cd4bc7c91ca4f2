"""Tractograms: ``.tck`` and legacy ``.vtk`` polylines.

A file is read by many tasks, each a range of its bytes. Where streamlines begin is
found range by range: in ``.tck`` after a triplet of NaN, in a binary ``.vtk`` whose
points are listed in order, as they are usually written, where an index is skipped;
that chain of counts is checked from one end to the other. Counts of the ranges before
give the rows' numbers. A ``.vtk`` in text, or with points in another order, is read
whole by one task.

Files are written by many tasks too (:mod:`fascicle.sources.sink`): each row's place
follows from the points before it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.operators.geometry import flat_points, point_lists
from fascicle.plans.durable import discard
from fascicle.schema import POINT
from fascicle.sources.binary import listed
from fascicle.sources.sink import filesystem, positions, ranges, refuse, write

TRACTOGRAM = f"src string, sid long, points array<{POINT}>"


def is_tractogram(path: str) -> bool:
    return path.lower().endswith((".vtk", ".tck"))


def parse_tck(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, offsets): a text header, then triplets parted by NaN and ended by infinity."""
    head, _, _ = data.partition(b"END")
    fields = dict(line.split(":", 1) for line in head.decode("latin-1").splitlines() if ":" in line)
    start = int(fields["file"].split()[-1])
    kind = {"Float32LE": "<f4", "Float32BE": ">f4", "Float64LE": "<f8", "Float64BE": ">f8"}[fields.get("datatype", "Float32LE").strip()]
    body = np.frombuffer(data[start:], kind, (len(data) - start) // (3 * np.dtype(kind).itemsize) * 3).reshape(-1, 3).astype(float)
    stop = np.flatnonzero(np.isinf(body).all(1))
    body = body[: stop[0]] if len(stop) else body
    gap = np.isnan(body).all(1)
    ends = np.flatnonzero(gap)
    sizes = np.diff(np.concatenate([[-1], ends])) - 1
    return body[~gap], np.concatenate([[0], np.cumsum(sizes)])


def parse_vtk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, offsets) of the POLYDATA lines of a legacy file, text or binary."""
    f = io.BytesIO(data)
    f.readline(), f.readline()
    binary = f.readline().strip().upper() == b"BINARY"
    points = np.zeros((0, 3))
    order, sizes = [], []
    types = {"float": ">f4", "double": ">f8"}

    def values(n: int, kind: str) -> np.ndarray:
        if binary:
            return np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind)
        got: list[bytes] = []
        while len(got) < n:
            line = f.readline()
            if not line:
                break
            got += line.split()
        return np.array(got[:n], float)

    while line := f.readline():
        words = line.decode("latin-1").split()
        if not words:
            continue
        if words[0] == "POINTS":
            points = values(3 * int(words[1]), types[words[2].lower()]).reshape(-1, 3).astype(float)
        elif words[0] == "LINES":
            n, total = int(words[1]), int(words[2])
            cells = values(total, ">i4").astype(np.int64)
            at = 0
            for _ in range(n):
                order.append(cells[at + 1 : at + 1 + cells[at]])
                sizes.append(int(cells[at]))
                at += int(cells[at]) + 1
            break
    picked = points[np.concatenate(order)] if order else np.zeros((0, 3))
    return picked, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


#: Bytes of a file that a task reads at a time.
RANGE = 32 << 20
_KINDS = {"Float32LE": "<f4", "Float32BE": ">f4", "Float64LE": "<f8", "Float64BE": ">f8"}


@dataclass(frozen=True)
class Layout:
    """Where a file's records lie: the body's first byte and past its last, the type of its numbers; for ``.vtk`` the lines' first byte and count of numbers too."""

    src: str
    kind: str
    begin: int
    end: int
    cells: int = 0
    total: int = 0

    @property
    def size(self) -> int:
        return np.dtype(self.kind).itemsize


def layout(src: str, size: int) -> Layout | None:
    """From a file's head; None for one that has to be read whole."""
    fs, inner = filesystem(src)
    with fs.open_input_file(inner) as f:
        if src.lower().endswith(".tck"):
            head = f.read(1 << 16).partition(b"END")[0]
            fields = dict(line.split(":", 1) for line in head.decode("latin-1").splitlines() if ":" in line)
            return Layout(src, _KINDS[fields.get("datatype", "Float32LE").strip()], int(fields["file"].split()[-1]), size)
        head = f.read(4096)
        lines = head.split(b"\n", 5)
        at = sum(len(x) + 1 for x in lines[:5])
        if len(lines) < 6 or lines[2].strip().upper() != b"BINARY" or lines[4].split()[:1] != [b"POINTS"]:
            return None
        _, n, kind = lines[4].decode().split()
        kind = {"float": ">f4", "double": ">f8"}.get(kind.lower())
        end = at + 3 * int(n) * np.dtype(kind).itemsize if kind else size
        rest = f.read_at(256, end) if kind and end < size else b""
        words = rest.lstrip().split(b"\n", 1)
        if len(words) < 2 or words[0].split()[:1] != [b"LINES"]:
            return None
        return Layout(src, kind, at, end, end + len(rest) - len(words[1]), int(words[0].split()[2]))


def _triplets(f, of: Layout, a: int, b: int) -> np.ndarray:
    n = (of.end - of.begin) // (3 * of.size)
    a, b = max(0, a), min(b, n)
    return np.frombuffer(f.read_at((b - a) * 3 * of.size, of.begin + a * 3 * of.size), of.kind).reshape(-1, 3) if b > a else np.zeros((0, 3))


def _scan_tck(f, of: Layout, a: int, b: int) -> tuple[int, int, int, int]:
    """(records ended before the last triplet that a range's records may begin after, first infinite triplet or -1, 0, 0)."""
    body = _triplets(f, of, a - 1, b - 1)
    stop = np.flatnonzero(np.isinf(_triplets(f, of, a, b)).all(1))
    return int(np.isnan(body).all(1).sum()), a + int(stop[0]) if len(stop) else -1, 0, 0


def _read_tck(f, of: Layout, a: int, b: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, offsets) of the records that begin in a range, to their end wherever it is."""
    body = _triplets(f, of, a - 1, min(b, stop))
    gap = np.isnan(body).all(1)
    # One more triplet before: a record begins after a gap.
    lead = 1 if a > 0 else 0
    begins = np.flatnonzero(gap[: len(body) - 1]) + 1 if len(body) else np.zeros(0, int)
    begins = begins if lead else np.concatenate([[0], begins])[: len(body)]
    begins = begins[begins >= lead] if lead else begins
    if not len(begins):
        return np.zeros((0, 3)), np.zeros(1, np.int64)
    body, gap = body[begins[0] :], gap[begins[0] :]
    at, pieces = min(b, stop), [body]
    # The last record goes on until its gap.
    while not gap[-1:].any() and at < stop:
        more = _triplets(f, of, at, min(at + 4096, stop))
        if not len(more):
            break
        ends = np.flatnonzero(np.isnan(more).all(1))
        more = more[: ends[0] + 1] if len(ends) else more
        pieces.append(more)
        gap = np.concatenate([gap, np.isnan(more).all(1)])
        at += 4096
    body = np.concatenate(pieces).astype(float)
    ends = np.flatnonzero(gap)
    sizes = np.diff(np.concatenate([[-1], ends])) - 1
    whole = body[: ends[-1] + 1] if len(ends) else body[:0]
    return whole[~gap[: len(whole)]], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _cells(f, of: Layout, a: int, b: int) -> np.ndarray:
    b = min(b, of.total)
    return np.frombuffer(f.read_at(4 * (b - a), of.cells + 4 * a), ">i4").astype(np.int64) if b > a else np.zeros(0, np.int64)


def _heads(f, of: Layout, a: int, b: int) -> np.ndarray | None:
    """Places in a range at which a record's count stands, if its points are in order; None if the range does not say so.

    Indices go up by one along the cells, but for the counts between them: two cells
    around a count differ by one. That shows where a count may be; from the first such
    place that is one, each count leads to the next.
    """
    v = _cells(f, of, max(0, a - 1), b + 1)
    begin, last = a - max(0, a - 1), min(b, of.total) - max(0, a - 1)  # the range in v
    steps = np.diff(v) == 1
    tries = [0] if a == 0 else [p for p in (np.flatnonzero(v[2:] - v[:-2] == 1)[:16] + 1).tolist() if begin <= p < last]
    for p in tries:
        chain = []
        while p < last:
            chain.append(p)
            p += int(v[p]) + 1 if v[p] >= 0 else last
        at, fine = np.array(chain), steps.copy()
        # Between counts everything goes up by one; the cell before the range may be a count itself.
        fine[at[at < len(fine)]] = True
        fine[:begin] = True
        fine[at[at > 0] - 1] = True
        if fine.all() or p == len(v) - 1 and fine[:-1].all():  # what follows the range may be a count
            return at + (a - begin)
    return np.zeros(0, np.int64) if a > 0 and steps[1:-1].all() else None


def _scan_vtk(f, of: Layout, a: int, b: int) -> tuple[int, int, int, int]:
    """(records that begin in a range or -1, first one's place, place after the last, index of the first one's first point)."""
    heads = _heads(f, of, a, b)
    if heads is None:
        return -1, 0, 0, 0
    if not len(heads):
        return 0, -1, -1, -1
    count, first = _cells(f, of, int(heads[-1]), int(heads[-1]) + 1)[0], _cells(f, of, int(heads[0]), int(heads[0]) + 2)
    if not first[0]:
        return -1, 0, 0, 0
    return len(heads), int(heads[0]), int(heads[-1] + count + 1), int(first[1])


def _read_vtk(f, of: Layout, a: int, b: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The same as for ``.tck``; record ``begin`` is the range's first."""
    heads = _heads(f, of, a, b)
    if not len(heads):
        return np.zeros((0, 3)), np.zeros(1, np.int64)
    sizes = _cells(f, of, int(heads[0]), int(heads[-1]) + 1)[heads - heads[0]]
    point = int(heads[0]) - begin  # cells before, without the counts
    n = int(sizes.sum())
    xyz = np.frombuffer(f.read_at(3 * n * of.size, of.begin + 3 * point * of.size), of.kind).reshape(-1, 3).astype(float)
    return xyz, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _ranges(of: Layout, size: int) -> list[tuple[int, int]]:
    """A file's units, triplets or cells, in ranges of about ``size`` bytes."""
    n, step = (of.total, max(2, size // 4)) if of.cells else ((of.end - of.begin) // (3 * of.size), max(2, size // (3 * of.size)))
    return [(a, min(a + step, n)) for a in range(0, n, step)]


def _numbered(of: Layout, lines: list[tuple]) -> list[tuple] | None:
    """(begin, end, first row, end of the body) of each range from the scans in order; None where the chain breaks."""
    out, n = [], 0
    if not of.cells:
        stop = min([s for *_, s, _, _ in lines if s >= 0], default=(of.end - of.begin) // (3 * of.size))
        for a, b, count, *_ in lines:
            n += count
            if a < stop:
                # Records ended before a range: one more has begun when its first one begins.
                out.append((a, b, n - count + (a > 0), stop))
        return out
    at, point = 0, 0
    for a, b, count, first, after, index in lines:
        if count < 0 or count and (first != at or index != point):
            return None
        if count:
            out.append((a, b, n, 0))
            n, at = n + count, after
            point = at - n
    return out if at == of.total else None


def read_tractograms(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(src, sid, points) of a file, or of a folder: its ``.tck`` files, then its ``.vtk`` files."""
    files = listed(path, ["*.tck", "*.vtk"])
    if not files or not all(is_tractogram(p) for p, _ in files):
        raise ValueError(f"{path}: .vtk or .tck is expected")
    layouts = {p: layout(p, size) for p, size in files}
    jobs = [(p, a, b) for p, of in layouts.items() if of for a, b in _ranges(of, range_bytes)]
    dealt = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                of = layouts[r["src"]]
                fs, inner = filesystem(r["src"])
                with fs.open_input_file(inner) as f:
                    found = (_scan_vtk if of.cells else _scan_tck)(f, of, r["a"], r["b"])
                yield pa.RecordBatch.from_pylist([{**r, **dict(zip("nxyz", found))}])

    lines: dict[str, list] = {}
    # A line for each range.
    for src, *line in sorted(tuple(r) for r in dealt(jobs, "src string, a long, b long").mapInArrow(scan, "src string, a long, b long, n long, x long, y long, z long").collect()) if jobs else []:
        lines.setdefault(src, []).append(tuple(line))
    parts, whole = [], [p for p, of in layouts.items() if of is None]
    for src, found in lines.items():
        numbered = _numbered(layouts[src], found)
        if numbered is None:
            whole.append(src)
        parts += [(src, *r) for r in numbered or []]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                of = layouts[r["src"]]
                fs, inner = filesystem(r["src"])
                with fs.open_input_file(inner) as f:
                    xyz, offsets = (_read_vtk(f, of, r["a"], r["b"], r["row"]) if of.cells else _read_tck(f, of, r["a"], r["b"], r["stop"]))
                yield from _batches(r["src"], r["row"], xyz, offsets)

    def read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, inner = filesystem(r["src"])
                with fs.open_input_file(inner) as f:
                    yield from _batches(r["src"], 0, *(parse_tck if r["src"].lower().endswith(".tck") else parse_vtk)(f.read()))

    out = dealt(parts, "src string, a long, b long, row long, stop long").mapInArrow(read, TRACTOGRAM)
    return out.unionByName(dealt([(p,) for p in whole], "src string").mapInArrow(read_whole, TRACTOGRAM)) if whole else out


def _batches(src: str, first: int, xyz: np.ndarray, offsets: np.ndarray, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(offsets) - 1, rows):
        own = offsets[s : s + rows + 1]
        n = len(own) - 1
        yield pa.RecordBatch.from_arrays([pa.array([src] * n), pa.array(np.arange(first + s, first + s + n)), point_lists(xyz[own[0] : own[-1]], own - own[0])], ["src", "sid", "points"])


def write_tck(df: DataFrame, path: str, force: bool = False) -> None:
    refuse(path, force)
    rows, n, total = positions(df.select("sid", "points"), F.size("points"), "sid")
    head, offset = "", 0
    while True:
        head = f"mrtrix tracks\ndatatype: Float32LE\ncount: {n}\nfile: . {offset}\nEND\n"
        if len(head) == offset:
            break
        offset = len(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                xyz, offsets = flat_points(b.column("points"))
                sizes = np.diff(offsets) + 1
                data = np.full((int(sizes.sum()), 3), np.nan, "<f4")
                data[np.arange(len(xyz)) + np.repeat(np.arange(b.num_rows), sizes - 1)] = xyz
                yield ranges(offset + 12 * (b.column("before").to_numpy() + b.column("rank").to_numpy()), 12 * sizes, data.tobytes())

    end = offset + 12 * (total + n)
    write(rows.mapInArrow(run, "at long, data binary"), path, end + 12, [(0, head.encode()), (end, np.full(3, np.inf, "<f4").tobytes())])
    discard(rows)


def write_vtk(df: DataFrame, path: str, fields: dict[str, str] | None = None, force: bool = False) -> None:
    """A binary legacy file with cell fields, such as ``{"score": "float", "label": "int"}``."""
    refuse(path, force)
    fields = fields or {}
    rows, n, total = positions(df.select("sid", "points", *fields), F.size("points"), "sid")
    head = f"# vtk DataFile Version 3.0\ntracks\nBINARY\nDATASET POLYDATA\nPOINTS {total} float\n".encode()
    points = len(head)
    middle = f"\nLINES {n} {n + total}\n".encode()
    cells = points + 12 * total + len(middle)
    fixed, at, places = [(0, head), (points + 12 * total, middle)], cells + 4 * (n + total), {}
    if fields:
        fixed.append((at, f"\nCELL_DATA {n}\n".encode()))
        at += len(fixed[-1][1])
    for name, kind in fields.items():
        fixed.append((at, f"SCALARS {name} {kind} 1\nLOOKUP_TABLE default\n".encode()))
        places[name] = at + len(fixed[-1][1])
        at = places[name] + 4 * n + 1
        fixed.append((at - 1, b"\n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            xyz, offsets = flat_points(b.column("points"))
            sizes, rank, before = np.diff(offsets), b.column("rank").to_numpy(), b.column("before").to_numpy()
            yield ranges(points + 12 * before, 12 * sizes, xyz.astype(">f4").tobytes())
            line = np.zeros(len(xyz) + b.num_rows, ">i4")
            counts = offsets[:-1] + np.arange(b.num_rows)
            line[counts] = sizes
            inner = np.arange(len(xyz)) - np.repeat(offsets[:-1], sizes)
            line[np.arange(len(xyz)) + np.repeat(np.arange(b.num_rows), sizes) + 1] = np.repeat(before, sizes) + inner
            yield ranges(cells + 4 * (before + rank), 4 * (sizes + 1), line.tobytes())
            for name, kind in fields.items():
                value = b.column(name).to_numpy(zero_copy_only=False).astype(">i4" if kind == "int" else ">f4")
                yield ranges(places[name] + 4 * rank, np.full(b.num_rows, 4), value.tobytes())

    write(rows.mapInArrow(run, "at long, data binary"), path, at, fixed)
    discard(rows)
