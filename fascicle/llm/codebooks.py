"""Product codes of vectors: codebooks by Yinyang's form of Lloyd's rounds, in whole numbers.

A component x becomes floor(SCALE * x); a vector is cut into ``PARTS`` equal parts, and
each part position has a codebook whose entries start as that part of the vectors with
the smallest keys. A round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and moves each entry to the floor of its parts' mean;
an entry without parts stays. After the last round parts are assigned once more.

Entries are clustered into groups once. Each part keeps an upper bound of the distance
to its own entry and one lower bound for each group, of the distance to the group's
other entries. When entries move, the bounds drift by as much: a part whose upper bound
stays below all lower bounds keeps its entry without any distance; otherwise the own
distance is taken anew, and only groups whose bound still fails are scanned. Bounds are
single floats rounded outwards; whatever they leave open, ties among it, is settled by
whole-number distances, so the result is that of the plain rounds.

Vectors lie in blocks of up to ``BLOCK`` rows with their codes and bounds. A round is one
pass over the blocks, written to the shared folder without a shuffle; blocks carry their
sums, and the driver gets the sums of each entry only, so nothing on it grows with the
input. The table of the round before goes when a round is written.

Rows whose vector is null, holds null or non-finite components, or is not as long as the
vector of the smallest key, are dropped. That length must be a multiple of ``PARTS``.
Null keys come last. Repeated rows count each time. With fewer vectors than entries,
codebooks have as many entries as vectors. An empty table gives an empty result.
Components of any finite size are exact (beyond doubles' whole numbers by plain scans
of Python's integers); an error or a label's sum beyond 64 bits is null. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import cut, drop, trim

PARTS, ENTRIES, GROUPS, ROUNDS, SCALE = 8, 16, 4, 6, 4096
#: Rows of a block.
BLOCK = 4096
#: Sums travel in limbs of so many bits, so that any number of blocks adds up in a long.
LIMB = 32
EXACT = 1 << 53


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][index]`` is a list of whole numbers; ``scanned`` of ``possible`` distances were computed to find them."""

    entries: list[list[list[int]]]
    scanned: int = 0
    possible: int = 0

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: 64-bit integers, or Python's where those could not hold it."""
    values = values.astype(float)
    if not len(values) or np.abs(values).max(initial=0) < EXACT / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    # A double beyond EXACT is a whole number itself.
    out = [int(np.floor(x * SCALE)) if abs(x) < EXACT / SCALE else int(x) * SCALE if abs(x) >= EXACT else int(np.floor(x)) * SCALE + int(np.floor((x - np.floor(x)) * SCALE)) for x in values.ravel().tolist()]
    return np.array(out, object).reshape(values.shape)


def pack(x: np.ndarray) -> tuple[str, bytes]:
    """The type and bytes of a block of whole numbers, as narrow as they allow."""
    if x.dtype != object:
        most = np.abs(x).max(initial=0)
        kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
        return kind, x.astype(kind).tobytes()
    return "text", ",".join(map(str, x.ravel())).encode()


def unpack(kind: str, data: bytes, rows: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(v) for v in data.split(b",")], object).reshape(rows, -1)
    flat = np.frombuffer(data, kind).astype(np.int64)
    return flat.reshape(rows, -1) if len(flat) else np.zeros((rows, 0), np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole squared distances of each row of ``x`` to each of ``c``."""
    if x.dtype != object and c.dtype != object:
        reach = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
        if x.shape[1] * reach * reach < EXACT // 2:
            # Every partial sum is a whole number that a double holds.
            a, b = x.astype(float), c.astype(float)
            return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
        if x.shape[1] * reach * reach < 1 << 62:
            return sum(((x[:, i, None] - c[None, :, i]) ** 2 for i in range(x.shape[1])), np.zeros((len(x), len(c)), np.int64))
    x, c = x.astype(object), c.astype(object)
    return sum(((x[:, i, None] - c[None, :, i]) ** 2 for i in range(x.shape[1])), np.zeros((len(x), len(c)), object))


def _up(values: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(values, np.float32), np.float32(np.inf))


def _down(values: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(values, np.float32), np.float32(-np.inf))


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group number for each entry: seeds far from each other, then a few rounds of plain means."""
    x = entries.astype(float)
    seeds = [0]
    while len(seeds) < min(groups, len(x)):
        gap = ((x[:, None] - x[None, seeds]) ** 2).sum(2).min(1)
        seeds.append(int(gap.argmax()))
    means = x[seeds]
    for _ in range(5):
        own = ((x[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.array([x[own == g].mean(0) if (own == g).any() else means[g] for g in range(len(means))])
    return own


class Part:
    """One part position's codebook as a round finds it: where its entries are, how far they came, and their groups."""

    def __init__(self, entries: list[list[int]], before: list[list[int]] | None, group: list[int]):
        size = max((abs(v) for e in entries for v in e), default=0)
        self.entries = np.array(entries, object if size >= EXACT else np.int64).reshape(len(entries), -1)
        self.group = np.array(group)
        self.groups = int(self.group.max()) + 1
        moved = [sum((a - b) ** 2 for a, b in zip(e, f)) for e, f in zip(entries, before or entries)]
        self.exact = self.entries.dtype != object and max(moved, default=0) < 1 << 62
        self.drift = _up(np.sqrt(np.array(moved, float))) if self.exact else np.full(len(entries), np.inf, np.float32)
        self.drift[[m == 0 for m in moved]] = 0
        self.group_drift = np.array([self.drift[self.group == g].max(initial=0) for g in range(self.groups)], np.float32)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, upper, lower) of rows that nothing is known of."""
        d = squared(x, self.entries)
        code = d.argmin(1)
        if d.dtype == object:
            return code, np.full(len(x), np.inf, np.float32), np.zeros((len(x), self.groups), np.float32)
        far = np.sqrt(d.astype(float))
        upper = _up(far[np.arange(len(x)), code])
        far[np.arange(len(x)), code] = np.inf
        return code, upper, self._least(far)

    def _least(self, far: np.ndarray) -> np.ndarray:
        return np.stack([_down(far[:, self.group == g].min(1, initial=np.inf)) for g in range(self.groups)], 1)

    def move(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same for rows with bounds of the round before, and how many distances that took."""
        if not self.exact or x.dtype == object:
            return *self.scan(x), len(x) * len(self.entries)
        upper = _up(upper + self.drift[code])
        lower = _down(lower - self.group_drift)
        rows = np.flatnonzero(upper >= lower.min(1))
        own = self.own(x[rows], code[rows])
        if own.dtype == object:
            return *self.scan(x), len(x) * len(self.entries)
        upper[rows] = _up(np.sqrt(own.astype(float)))
        scanned = len(rows)
        open_ = upper[rows] >= lower[rows].min(1)
        rows, own = rows[open_], own[open_]
        if not len(rows):
            return code, upper, lower, scanned
        at, old = np.arange(len(rows)), code[rows]
        d = np.full((len(rows), len(self.entries)), np.iinfo(np.int64).max)
        looked = np.zeros((len(rows), self.groups), bool)
        for g in range(self.groups):
            need = lower[rows, g] <= upper[rows]
            mine = np.flatnonzero(self.group == g)
            d[np.ix_(need, mine)] = squared(x[rows[need]], self.entries[mine])
            looked[:, g] = need
            scanned += int(need.sum()) * len(mine)
        d[at, old] = own
        best = d.argmin(1)
        upper[rows] = _up(np.sqrt(d[at, best].astype(float)))
        far = np.sqrt(d.astype(float))
        far[at, best] = np.inf
        # Groups that were scanned have their bound anew; an unscanned one that lost this row gets the entry that it left.
        least = self._least(far)
        held = np.where(looked, least, lower[rows])
        left = (best != old) & ~looked[at, self.group[old]]
        held[at[left], self.group[old[left]]] = np.minimum(held[at[left], self.group[old[left]]], _down(np.sqrt(own[left].astype(float))))
        lower[rows] = held
        code = code.copy()
        code[rows] = best
        return code, upper, lower, scanned

    def own(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whole squared distances of rows to the entries of their codes."""
        c = self.entries[code]
        reach = max(int(np.abs(x).max(initial=0)), 0) + max(int(np.abs(c).max(initial=0)), 0)
        if x.dtype == object or c.dtype == object or x.shape[1] * reach * reach >= 1 << 62:
            x, c = x.astype(object), c.astype(object)
            return ((x - c) ** 2).sum(1) if x.shape[1] else np.zeros(len(x), object)
        return ((x - c) ** 2).sum(1)


def _sums(x: np.ndarray, code: np.ndarray, parts: int, entries: int) -> list[dict]:
    """(place, limb, value) of the counts and sums of each part's entries; the count comes before an entry's components."""
    width = x.shape[1] // parts
    out = []
    for j in range(parts):
        own = x[:, j * width : (j + 1) * width]
        for e in range(entries):
            mine = own[code[:, j] == e]
            for i, v in enumerate([len(mine), *(mine.astype(object) if mine.dtype == object else mine).sum(0).tolist()] if len(mine) else []):
                place, limb, rest = (j * entries + e) * (width + 1) + i, 0, abs(int(v))
                while rest:
                    out.append({"place": place, "limb": limb, "v": (rest & (1 << LIMB) - 1) * (1 if v > 0 else -1)})
                    rest, limb = rest >> LIMB, limb + 1
    return out


_STATE = ["keys", "labels", "kind", "x", "code", "upper", "lower", "scanned", "sums"]


def _block(keys, labels, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: int, entries: int) -> pa.RecordBatch:
    kind, data = pack(x)
    sums = pa.array([_sums(x, code, code.shape[1], entries)], pa.list_(pa.struct([("place", pa.int32()), ("limb", pa.int32()), ("v", pa.int64())])))
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    plain = [pa.array([v]) for v in (kind, data, code.astype(np.uint8).tobytes(), upper.astype("<f4").tobytes(), lower.astype("<f4").tobytes(), scanned)]
    return pa.RecordBatch.from_arrays([one(keys), one(labels), *plain, sums], _STATE)


def _first(books: list[Part], width: int):
    """Blocks of the rows, with the codes and bounds of a first scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            keys, labels = (pa.concat_arrays([b.column(c) for b in held]) for c in ("key", "label"))
            x = np.concatenate([whole(b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(books) * width)) for b in held])
            found = [book.scan(x[:, j * width : (j + 1) * width]) for j, book in enumerate(books)]
            code, upper = (np.stack([f[i] for f in found], 1) for i in (0, 1))
            lower = np.concatenate([f[2] for f in found], 1)
            return _block(keys, labels, x, code, upper, lower, x.shape[0] * sum(len(b.entries) for b in books), len(books[0].entries))

        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                held.append(b.slice(s, BLOCK))
                if sum(h.num_rows for h in held) >= BLOCK:
                    yield flush()
                    held = []
        if held:
            yield flush()
        trim()

    return run


def _loaded(b: pa.RecordBatch, books: list[Part]) -> Iterator[tuple]:
    for i in range(b.num_rows):
        keys, labels = b.column("keys")[i].values, b.column("labels")[i].values
        n = len(keys)
        code = np.frombuffer(b.column("code")[i].as_py(), np.uint8).reshape(n, -1).astype(np.int64)
        upper = np.frombuffer(b.column("upper")[i].as_py(), "<f4").reshape(n, -1)
        lower = np.split(np.frombuffer(b.column("lower")[i].as_py(), "<f4").reshape(n, -1), np.cumsum([p.groups for p in books])[:-1], 1)
        yield keys, labels, unpack(b.column("kind")[i].as_py(), b.column("x")[i].as_py(), n), code, upper, lower


def _moved(x, code, upper, lower, books: list[Part], width: int):
    found = [book.move(x[:, j * width : (j + 1) * width], code[:, j], upper[:, j], lower[j]) for j, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1), np.concatenate([f[2] for f in found], 1), sum(f[3] for f in found)


def _next(books: list[Part], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, labels, x, *known in _loaded(b, books):
                yield _block(keys, labels, x, *_moved(x, *known, books, width), len(books[0].entries))
        trim()

    return run


def _errors(x: np.ndarray, code: np.ndarray, books: list[Part], width: int) -> pa.Array:
    own = [book.own(x[:, j * width : (j + 1) * width], code[:, j]).astype(object) for j, book in enumerate(books)]
    return pa.array([v if v < 1 << 63 else None for v in sum(own).tolist()], pa.int64())


def _last(books: list[Part], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, labels, x, *known in _loaded(b, books):
                code = _moved(x, *known, books, width)[0]
                yield pa.RecordBatch.from_arrays([keys, labels, pa.array(code.astype(np.uint8).tobytes()[i * len(books) : (i + 1) * len(books)].hex() for i in range(len(keys))), _errors(x, code, books, width)], ["key", "label", "code", "error"])
        trim()

    return run


def _kept(vectors: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = F.col(label) if label else F.lit(None).cast("int")
    return vectors.select(F.col(key).alias("key"), own.alias("label"), v.alias("vector")).where(v.isNotNull() & fine)


def train(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame]:
    """The codebooks after so many rounds, and (``key``, label, code, error) of every kept row: two hex digits a part, and its squared distances summed."""
    kept = _kept(vectors, key, vector, label)
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("key", "label")}
    schema = f"`key` {kinds['key']}, label {kinds['label']}, code string, error long"
    first = kept.orderBy(F.col("key").asc_nulls_last(), "vector").limit(1).select(F.size("vector")).first()
    if first is None:
        return Codebooks([[] for _ in range(parts)]), vectors.sparkSession.createDataFrame([], schema)
    if first[0] % parts:
        raise ValueError(f"vectors of {first[0]} components have no {parts} equal parts")
    kept, width = kept.where(F.size("vector") == first[0]), first[0] // parts
    start = [whole(np.array(r[0])) for r in kept.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).select("vector").toLocalIterator()]
    books = [[[int(v) for v in x[j * width : (j + 1) * width]] for x in start] for j in range(parts)]
    groups = [grouped(np.array(b, float).reshape(len(b), -1), -(-len(b) // -(-entries // GROUPS))).tolist() for b in books]
    held = f"`keys` array<{kinds['key']}>, labels array<{kinds['label']}>, kind string, x binary, code binary, upper binary, lower binary, scanned long, sums array<struct<place:int,limb:int,v:long>>"
    state, before, scanned = None, None, 0
    for _ in range(rounds):
        now = [Part(b, f, g) for b, f, g in zip(books, before or [None] * parts, groups)]
        done = cut(kept.mapInArrow(_first(now, width), held) if state is None else state.mapInArrow(_next(now, width), held))
        if state is not None:
            drop(state)
        state, before = done, books
        scanned += state.agg(F.sum("scanned")).first()[0]
        books = _means(state, books, width)
    now = [Part(b, f, g) for b, f, g in zip(books, before or [None] * parts, groups)]
    if state is None:
        state = cut(kept.mapInArrow(_first(now, width), held))
    coded = cut(state.mapInArrow(_last(now, width), schema))
    drop(state)
    return Codebooks(books, scanned, coded.count() * parts * len(start) * rounds), coded


def _means(state: DataFrame, books: list[list[list[int]]], width: int) -> list[list[list[int]]]:
    """Entries at the floor of their parts' mean. A row for each number of the codebooks comes to the driver."""
    entries = len(books[0])
    totals = [0] * (len(books) * entries * (width + 1))
    for place, limb, v in state.select(F.explode("sums").alias("s")).groupBy("s.place", "s.limb").agg(F.sum("s.v")).collect():
        totals[place] += v << LIMB * limb
    out = []
    for j, book in enumerate(books):
        out.append([])
        for e, entry in enumerate(book):
            n, *sums = totals[(j * entries + e) * (width + 1) :][: width + 1]
            out[-1].append([s // n for s in sums] if n else entry)
    return out


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(``key``, code, error, label_error, codebooks_sha256) of every kept row; equal labels share their summed error, nulls together."""
    books, coded = train(vectors, key, vector, label)
    # Summed in the task before the shuffle; a label with many rows is one row here.
    shared = coded.groupBy(F.col("label").alias("same")).agg(F.when(F.count("*") == F.count("error"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")).alias("label_error"))
    out = coded.join(shared, F.col("label").eqNullSafe(F.col("same")))
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def encode(vectors: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``key``, code, error) of vectors by codebooks that stand, without a shuffle. What :func:`train` drops is dropped."""
    width = len(books.entries[0][0])
    kept = _kept(vectors, key, vector, None).where(F.size("vector") == width * len(books.entries))
    parts = [Part(b, None, [0] * len(b)) for b in books.entries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = whole(b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                code = np.stack([p.scan(x[:, j * width : (j + 1) * width])[0] for j, p in enumerate(parts)], 1)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([r.astype(np.uint8).tobytes().hex() for r in code]), _errors(x, code, parts, width)], ["key", "code", "error"])

    kind = kept.schema["key"].dataType.simpleString()
    return kept.select("key", "vector").mapInArrow(run, f"`key` {kind}, code string, error long").withColumnRenamed("key", key)


def decode(coded: DataFrame, books: Codebooks, key: str = "vec_id") -> DataFrame:
    """(``key``, vector): what the codes stand for, from the middle of each component's step."""
    table = F.array(*[F.array(*[F.array(*[F.lit((v + 0.5) / SCALE) for v in e]) for e in part]) for part in books.entries])
    digit = lambda j: F.conv(F.substring("code", 2 * j + 1, 2), 16, 10).cast("int")
    return coded.select(key, F.flatten(F.array(*[F.get(F.get(table, F.lit(j)), digit(j)) for j in range(len(books.entries))])).alias("vector"))
