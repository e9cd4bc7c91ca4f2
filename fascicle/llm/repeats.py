"""Exact removal of repeated byte strings with suffix arrays.

Each string of ``length`` bytes that also starts earlier (smaller id, or the same
document further left) is repeated, and every byte that a repeated string covers
goes. All is judged on the input.

Windows of ``length`` bytes are dealt out by their minimizer, the first of their
``SEED``-byte seeds by an order of all seeds: equal windows have equal minimizers at
equal places. The order puts seeds that are common in the corpus last (counted by hash
in a table of fixed size; any order gives the same result). So a common line is the
minimizer only of windows that lie within common text, which are equal and collapse,
and not of every window that touches it.
Neighbouring windows with one minimizer travel as one stretch. Stretches that are
equal throughout are settled by comparing their places, first within a task, then
by hash; one stretch of each kind goes on, and only where another kind of the same
minimizer can share a window with it: windows that begin near before the minimizer hold
what follows it, the others what precedes it, and 16 bits of either must agree. The texts of the kinds that go on are written out from the minimizer on
to the right, and backwards from it to the left, in blocks of ``BLOCK`` bytes, each with
an end mark, and one suffix array of all sorts both sides. Common prefixes of neighbours
on the right and on the left together give the classes of equal windows, byte by byte;
the first place of each class stays.

Null and empty texts, and texts shorter than ``length``, lose nothing and repeat
nothing. Rows that agree in id and text are one document; null ids come first. Texts
of any length are scanned in overlapping pieces. Hashes of 64 bits stand for seeds
and for whole stretches; rows of one id are told apart by 32 bits of their text's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fascicle.llm.bytescan import BYTE, STEP, STEP_BACK, mix, powers
from fascicle.llm.common import cut, partitions, raw, slices, text_of, trim
from fascicle.llm.frequency import TABLE, counter, levels, packed
from fascicle.llm.suffixes import suffix_array

LENGTH, SEED, BLOCK = 100, 16, 32
PIECE = 1 << 20
_PLACE = 24
_FIELDS = (("h", np.uint64), ("c", np.uint64), ("doc", np.int64), ("row", np.int32), ("start", np.uint32), ("n", np.uint8), ("a", np.uint8), ("after", np.uint16), ("before", np.uint16))


def near_of(length: int) -> int:
    """Windows that begin at most so far before their minimizer hold the ``length - near`` bytes from it on; the others hold the ``near + 1`` before it."""
    return (length - SEED) // 2


def _seeds(data: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of the ``seed`` bytes from each place on, with the running sums and powers that it comes from."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(n, STEP), out=sums[1:])
    back = powers(n, STEP_BACK)
    m = max(0, n - seed + 1)
    return mix((sums[n - m + 1 :] - sums[:m]) * back[:m]), sums, back


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's counts of hashed seeds."""
    total = np.zeros(TABLE, np.int64)
    for b in batches:
        for s, e in slices(b.column(0)):
            data, _ = raw(b.column(0).slice(s, e - s))
            for at in range(0, len(data), PIECE):
                total += np.bincount(counter(_seeds(data[at : at + PIECE + SEED - 1])[0]), minlength=TABLE)
    if total.any():
        yield pa.RecordBatch.from_arrays(list(packed(total)), ["part", "counts"])
    trim()


def stretches(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Of pieces ``data[lo:hi]``, which may overlap but lie in ascending order: (h, c, start, count, anchor, after, before) of each run of windows with one minimizer; the last two are hashes of what all its windows near the minimizer hold, and all others, or 0."""
    n = len(data)
    none = tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint16, np.uint16))
    if n < length:
        return none
    seeds, sums, back = _seeds(data, seed)
    # Five bits of how common a seed is, 35 of its hash, the rest its place.
    keys = (level[counter(seeds)].astype(np.uint64) << np.uint64(59)) | (seeds >> np.uint64(29) << np.uint64(_PLACE)) | np.arange(len(seeds), dtype=np.uint64)
    width, least, have = length - seed + 1, keys, 1
    while have * 2 <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    count = np.maximum(0, hi - lo - length + 1)
    lo, count = lo[count > 0], count[count > 0]
    if not len(lo):
        return none
    window = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    at = anchor[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = at[1:] != at[:-1]
    fresh[np.cumsum(count)[:-1]] = True
    first = np.flatnonzero(fresh)
    many = np.diff(np.append(first, len(window)))
    start, anchors = window[first], at[first]
    whole = mix((sums[start + many + length - 1] - sums[start]) * back[start] + (anchors - start).astype(np.uint64))
    near = near_of(length)

    def context(there: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        begin, end = np.where(there, begin, 0), np.where(there, end, 0)
        return np.where(there, mix((sums[end] - sums[begin]) * back[begin]) >> np.uint64(48), np.uint64(0)).astype(np.uint16)

    after = context(anchors - start - many + 1 <= near, anchors, anchors + length - near)
    before = context(anchors - start > near, anchors - near - 1, anchors + seed)
    return seeds[anchors], whole, start, many, anchors, after, before


def _pieces(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to) of pieces of at most ``PIECE`` windows."""
    size = np.maximum(1, -(-np.maximum(0, np.diff(offsets) - length + 1) // PIECE))
    text = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    lo = offsets[text] + nth * PIECE
    return text, lo, np.minimum(lo + PIECE + length - 1, offsets[text + 1])


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    """Column by column, and of each column all first bytes, then all second ones: high bytes are mostly equal and compress."""
    return b"".join(np.ascontiguousarray(columns[name].astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes() for name, kind in _FIELDS)


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    size = sum(np.dtype(k).itemsize for _, k in _FIELDS)
    out: dict[str, list[np.ndarray]] = {name: [] for name, _ in _FIELDS}
    for blob in blobs:
        n, at = len(blob) // size, 0
        for name, kind in _FIELDS:
            step = n * np.dtype(kind).itemsize
            out[name].append(np.ascontiguousarray(np.frombuffer(blob[at : at + step], np.uint8).reshape(-1, n).T).view(kind).ravel())
            at += step
    return {name: np.concatenate(out[name]) if out[name] else np.zeros(0, kind) for name, kind in _FIELDS}


def _keep_first(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns in order of (h, c, place), and where each (h, c) is first."""
    order = np.lexsort((c["start"], c["row"], c["doc"], c["c"], c["h"]))
    c = {k: v[order] for k, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = (c["h"][1:] != c["h"][:-1]) | (c["c"][1:] != c["c"][:-1])
    # A row that is there twice is one document: the same place counts once.
    other = new.copy()
    other[1:] |= (c["doc"][1:] != c["doc"][:-1]) | (c["row"][1:] != c["row"][:-1]) | (c["start"][1:] != c["start"][:-1])
    return {k: v[other] for k, v in c.items()}, new[other]


_FOUND = "doc long, row int, start int, n int, h long, a int"


def _found(c: dict[str, np.ndarray], known: np.ndarray) -> pa.RecordBatch:
    """Known repeats by their places alone; the others with their minimizer."""
    return pa.RecordBatch.from_arrays(
        [pa.array(c["doc"]), pa.array(c["row"]), pa.array(c["start"].astype(np.int32)), pa.array(c["n"].astype(np.int32)), pa.array(c["h"].view(np.int64), mask=known), pa.array(c["a"].astype(np.int32), mask=known)],
        ["doc", "row", "start", "n", "h", "a"],
    )


def _scan(routes: int, length: int, level: np.ndarray):
    """Texts to packed stretches, one of each kind from each flush; the others are known as repeats at once and travel to no key in particular."""

    def flush(held: list[dict[str, np.ndarray]], turn: int) -> Iterator[pa.RecordBatch]:
        c, first = _keep_first({name: np.concatenate([x[name] for x in held]) for name, _ in _FIELDS})
        route = np.where(first, (c["h"] >> np.uint64(8)) % np.uint64(routes), (np.arange(len(first), dtype=np.uint64) + np.uint64(turn)) % np.uint64(routes)).astype(np.int64) * 2 + ~first
        # Of known repeats only the places matter.
        c |= {k: np.where(first, c[k], 0) for k in ("h", "c", "a", "after", "before")}
        order = np.lexsort((c["start"], c["doc"], route))
        cuts = np.flatnonzero(np.diff(route[order])) + 1
        parts = np.split(order, cuts) if len(order) else []
        keys = [int(route[p[0]]) for p in parts]
        blobs = [_pack({k: v[p] for k, v in c.items()}) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array([k >> 1 for k in keys], pa.int32()), pa.array([bool(k & 1) for k in keys], pa.bool_()), pa.array(blobs, pa.binary())], ["route", "known", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = turn = 0
        for b in batches:
            docs, rows, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            for s, e in slices(texts):
                data, offsets = raw(texts.slice(s, e - s))
                text, lo, hi = _pieces(offsets, length)
                # Pieces are scanned together up to the bits that a place has.
                for x, y in _groups(lo, hi):
                    base = int(lo[x])
                    h, c, start, n, anchor, after, before = stretches(data[base : int(hi[y - 1])], lo[x:y] - base, hi[x:y] - base, level, length)
                    owner = np.searchsorted(offsets, start + base, "right") - 1
                    held.append({"h": h, "c": c, "doc": docs[s + owner], "row": rows[s + owner], "start": start + base - offsets[owner], "n": n, "a": anchor - start, "after": after, "before": before})
                    size += len(h)
                if size >= 1 << 18:
                    turn = int(rows[s]) & 0xFFFF
                    yield from flush(held, turn)
                    held, size = [], 0
        if size:
            yield from flush(held, turn)
        trim()

    return run


def _groups(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(lo):
        end = at + 1
        while end < len(lo) and hi[end] - lo[at] < 1 << (_PLACE - 1):
            end += 1
        yield at, end
        at = end


def _settle(length: int):
    """One task's stretches: repeats of equal stretches, and the first of each kind where another kind of its minimizer may share a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for b in batches:
            for known, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if known:
                    c = _unpack([blob])
                    yield _found(c, np.ones(len(c["h"]), bool))
                else:
                    blobs.append(blob)
        c, first = _keep_first(_unpack(blobs))
        del blobs
        if not len(first):
            return
        # A kind can share a window with another one of its minimizer if what both hold on one side agrees.
        kind, go = np.flatnonzero(first), ~first
        near, far = c["a"][kind].astype(np.int64) - c["n"][kind] + 1 <= near_of(length), c["a"][kind] > near_of(length)
        for some, context in ((kind[near], c["after"]), (kind[far], c["before"])):
            order = some[np.lexsort((context[some], c["h"][some]))]
            same = (c["h"][order[1:]] == c["h"][order[:-1]]) & (context[order[1:]] == context[order[:-1]])
            go[order[1:][same]] = go[order[:-1][same]] = True
        for s in range(0, int(go.sum()), 1 << 18):
            part = np.flatnonzero(go)[s : s + (1 << 18)]
            yield _found({k: v[part] for k, v in c.items()}, ~first[part])
        del c, first, go
        trim()

    return run


def _cut_out(length: int):
    """Texts with their open stretches to a row for each stretch with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2)
            for s, e in slices(texts):
                data, offsets = raw(texts.slice(s, e - s))
                part = b.column(3).slice(s, e - s)
                size = np.diff(part.offsets.to_numpy())
                flat, owner = part.flatten(), pa.array(s + np.repeat(np.arange(e - s), size))
                start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                begin = np.repeat(offsets[:-1], size) + start
                width = n.astype(np.int64) + length - 1
                ends = np.cumsum(width)
                take = np.repeat(begin - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)
                body = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[take])])
                yield pa.RecordBatch.from_arrays([flat.field("h"), *(b.column(k).take(owner) for k in (0, 1)), *(flat.field(k) for k in ("start", "n", "a")), body], ["h", "doc", "row", "start", "n", "a", "body"])
        trim()

    return run


def sorted_sides(sides: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each side, rows of bytes and how many of them count: the rows' order, and the bytes that each has in common with the one before. One suffix array sorts all."""
    m, width = sides[0][0].shape
    steps = -(-width // BLOCK)
    words, used, counts = [], [], []
    for rows, size in sides:
        padded = np.zeros((m, steps * BLOCK), np.uint8)
        padded[:, :width] = rows
        count = -(-size // BLOCK)
        inside = np.arange(steps)[None, :] < count[:, None]
        held = np.minimum(BLOCK, size[:, None] - np.arange(steps)[None, :] * BLOCK)
        # A block: its bytes as big-endian words, then how many of them count; equal blocks share a rank.
        words.append(np.hstack([padded.reshape(-1, BLOCK)[inside.ravel()].view(">u8").astype(np.uint64), held[inside][:, None].astype(np.uint64)]))
        counts.append(count)
    words, count = np.concatenate(words), np.concatenate(counts)
    order = np.lexsort(words.T[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    # Each row's symbols, then 0, which sorts first and parts rows.
    at = np.concatenate([[0], np.cumsum(count + 1)])
    symbols, body = np.zeros(at[-1], np.int64), np.ones(at[-1], bool)
    body[at[1:] - 1] = False
    symbols[body] = rank
    owner = np.full(at[-1], -1, np.int64)
    owner[at[:-1]] = np.arange(len(count))
    found = owner[np.array(suffix_array(symbols), np.int64)]
    out = []
    for k, (rows, size) in enumerate(sides):
        order = found[(found >= k * m) & (found < (k + 1) * m)] - k * m
        common = np.zeros(m, np.int64)
        x, y = order[1:], order[:-1]
        same = rows[x] == rows[y]
        common[1:] = np.minimum(np.where(same.all(1), width, same.argmin(1)), np.minimum(size[x], size[y]))
        out.append((order, common))
    return out


def repeated_windows(h, place, n, a, body, offsets, length: int = LENGTH) -> np.ndarray:
    """Of stretches aligned at their minimizers: a mask, row by stretch and column by distance from window start to minimizer, of windows that are not the first of their class."""
    m, reach = len(h), length - SEED + 1
    grid = np.arange(length)
    # Right of the minimizer up to ``length`` bytes, and backwards left of it.
    right_size, left_size = np.minimum(np.diff(offsets) - a, length).astype(np.int64), a.astype(np.int64)
    right, left = np.zeros((m, length), np.uint8), np.zeros((m, length), np.uint8)
    inside = grid[None, :] < right_size[:, None]
    right[inside] = body[((offsets[:-1] + a)[:, None] + grid[None, :])[inside]]
    inside = grid[None, :] < left_size[:, None]
    left[inside] = body[((offsets[:-1] + a - 1)[:, None] - grid[None, :])[inside]]
    (right_order, right_common), (left_order, left_common) = sorted_sides([(right, right_size), (left, left_size)])
    place_rank = np.empty(m, np.int64)
    place_rank[place] = np.arange(m)
    out = np.zeros((m, reach), bool)
    low = a - n + 1
    runs, ends = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(reach):
        rows = np.flatnonzero((low <= d) & (d <= a))
        if len(rows) < 2:
            continue
        # Equal windows: in one run of the right order down to their last byte, and in one of the left order down to their first.
        runs[right_order] = np.cumsum(right_common < length - d)
        ends[left_order] = np.cumsum(left_common < d)
        rows = rows[np.argsort(place_rank[rows], kind="stable")]
        _, first = np.unique(runs[rows] * (m + 1) + ends[rows], return_index=True)
        again = np.ones(len(rows), bool)
        again[first] = False
        out[rows[again], d] = True
    return out


def _compare(length: int, most: int = 1 << 16):
    """One task's open stretches, minimizer by minimizer in bounded lots, to runs of repeated windows."""

    def solve(lot: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(lot).combine_chunks()
        place = np.lexsort([t.column(k).to_numpy() for k in ("h", "start", "row", "doc")])
        at = [t.column(k).to_numpy()[place] for k in ("h", "start", "row", "doc")]
        twice = np.zeros(len(place), bool)
        twice[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in at])
        if twice.any():  # of a row that is there twice
            t = t.take(pa.array(np.sort(place[~twice]))).combine_chunks()
        col = {k: t.column(k).to_numpy() for k in ("h", "doc", "row", "start", "n", "a")}
        bodies = t.column("body").chunk(0) if t.num_rows else pa.array([], pa.binary())
        body, offsets = raw(bodies)
        n, a = col["n"].astype(np.int64), col["a"].astype(np.int64)
        place = np.lexsort((col["start"] + a, col["row"], col["doc"]))
        hit = repeated_windows(col["h"], place, n, a, body, offsets, length)[:, ::-1]
        # Columns now ascend with the window's start; runs of marks along each row.
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (r, s), (_, e) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        start = col["start"][r] + a[r] - (hit.shape[1] - 1 - s)
        return pa.RecordBatch.from_arrays([pa.array(col["doc"][r]), pa.array(col["row"][r]), pa.array(start.astype(np.int32)), pa.array((e - s).astype(np.int32))], ["doc", "row", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:  # sorted by h
            h = b.column(0).to_numpy()
            at = 0
            while at < len(h):
                if size >= most:
                    last = held[-1].column(0)[-1].as_py()
                    stop = at + int(np.searchsorted(h[at:], last, "right"))
                    if stop < len(h):
                        if stop > at:
                            held.append(b.slice(at, stop - at))
                        yield solve(held)
                        held, size, at = [], 0, stop
                        continue
                    held.append(b.slice(at))
                    size, at = size + len(h) - at, len(h)
                else:
                    step = min(len(h) - at, most - size)
                    held.append(b.slice(at, step))
                    size, at = size + step, at + step
        if held:
            yield solve(held)
        trim()

    return run


def with_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, extra: list[str] | None = None, out: str = "repeats") -> DataFrame:
    """``key``, ``text`` (null as empty), ``extra`` columns, and ``out``: structs of (start, n), runs of n windows that are repeated; null for none."""
    parts = partitions(df)
    rows = df.select(
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.shiftright(F.xxhash64(F.col(key).cast("long"), F.col(text)), 32).cast("int").alias("row"), text_of(text).alias("__text"),
        *(F.col(f"`{c}`").alias(f"__own_{c}") for c in dict.fromkeys([key, *(extra or [])])),
    )
    level = levels(rows.select("__text").mapInArrow(_count, "part int, counts binary"))
    scanned = rows.select("doc", "row", "__text").mapInArrow(_scan(parts, length, level), "route int, known boolean, blob binary")
    found = cut(scanned.repartition(parts, "route").mapInArrow(_settle(length), _FOUND))
    # The texts are dealt out once by row; both joins below read that one exchange.
    texts = rows.repartition(parts, "doc", "row")
    open_ = found.where("h is not null").groupBy("doc", "row").agg(F.collect_list(F.struct("h", "start", "n", "a")).alias("open"))
    bodies = texts.join(open_, ["doc", "row"]).select("doc", "row", "__text", "open").mapInArrow(_cut_out(length), "h long, doc long, row int, start int, n int, a int, body binary")
    compared = bodies.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_compare(length), "doc long, row int, start int, n int")
    spans = found.where("h is null").select("doc", "row", "start", "n").unionByName(compared)
    spans = spans.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("__spans"))
    return texts.join(spans, ["doc", "row"], "left").select(*(F.col(f"`__own_{c}`").alias(c) for c in dict.fromkeys([key, *(extra or [])])), F.col("__text").alias(text), F.col("__spans").alias(out))


def covered(size: int, spans: list[dict], length: int) -> np.ndarray:
    """A mask of the bytes that repeated windows cover."""
    edge = np.zeros(size + 1, np.int32)
    if spans:
        np.add.at(edge, [s["start"] for s in spans], 1)
        np.add.at(edge, [s["start"] + s["n"] + length - 1 for s in spans], -1)
    return np.cumsum(edge[:-1]) > 0


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """For each row: bytes, removed bytes, maximal removed runs, and a digest of what stays."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                if spans:
                    gone = covered(len(t), spans, length)
                    left = np.frombuffer(t, np.uint8)[~gone].tobytes()
                    out.append((len(t), len(t) - len(left), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
                else:
                    out.append((len(t), 0, 0, hashlib.sha256(t).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_repeats(df, key, text, length).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def trimmed(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with the repeated bytes of each text gone; a character cut in two goes whole. Null texts become empty; all rows stay."""
    columns = df.columns
    other = [c for c in columns if c not in (key, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            spans = b.column(b.num_columns - 1).to_pylist()
            kept = [np.frombuffer(t, np.uint8)[~covered(len(t), s, length)].tobytes().decode("utf-8", "ignore") if s else t.decode() for t, s in zip(texts, spans)]
            made = {text: pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else b.column(b.schema.get_field_index(c)) for c in columns], columns)
        trim()

    return with_repeats(df, key, text, length, other, "__repeats").mapInArrow(run, df.schema)
