"""N-gram Jaccard join: near-duplicate documents by word shingles, as a blocked sparse matrix product.

A document's row of the incidence matrix holds its distinct shingles, rarer ones
first. Rows with equal sets are one row. Two rows can only reach the threshold if
they meet in the leading quarter of both (the prefix), so the product runs over the
prefixes: blocks of columns (shingles by hash) are multiplied apart, each adds up
the overlaps of its pairs, and the sums of all blocks meet by pair. Bounds from the
sizes discard pairs whose overlap can't suffice; the rest are settled on the whole
sets.

Columns that many rows share make no square of pairs. In each, and for each range of
sizes, one row leads: the one whose columns are the most common for its size, which in
a group of copies is the text that they come from. Overlaps of rows with leading rows
are summed over all columns, and each row is settled against the leading row that it
shares most with; then, among rows that this left outside, once more with leading
rows of their own. What is still outside the largest component of a column is
multiplied with all rows of that column, in tiles of at most ``TILE`` by ``TILE``
rows. A tile gives out the pairs that sizes, places, open columns and signatures let
link: bits set for the shingles of a set, as many as its size asks for, so that bits
of one set which the other lacks bound the overlap from above. So every link between
different sets is either found or lies inside a component that has been found, and a
row that links with nothing costs comparisons, but no pairs.

"Rarer" follows counts of hashed shingles over all documents in a table of fixed
size. Any fixed order gives the same result; this one keeps shared passages out of
the prefixes.

Texts without words have an empty set and link with nothing. Texts of fewer than
``WORDS`` words have their whole sequence as one shingle. Null texts count as empty.
Rows with equal ids and sets count once. Null ids are components by themselves only
if nothing else is in them: the least id that is not null names a component.
Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm.bytescan import Words, mix, shingles
from fascicle.llm.common import collected, cut, drop, partitions, raw, release, rest, slices, text_of, trim
from fascicle.llm.frequency import PARTS, TABLE, counter, levels, packed

WORDS, PERCENT = 5, 75
#: Columns with at most so many rows are multiplied in full at once.
FULL = 8
#: Rows of one side of a tile, where a common column's rows are multiplied.
TILE = 4096


def sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, text by text and ascending, and where each text's begin and end."""
    w = Words(*raw(texts))
    hashes, count = w.hashes(), np.diff(w.first)
    runs = shingles(hashes, words)
    inside = np.zeros(len(runs), bool)
    owner = w.owner()
    if len(runs):
        inside = owner[: len(runs)] == owner[words - 1 :]
    whole = np.flatnonzero((count > 0) & (count < words))
    short = np.array([int(shingles(hashes[w.first[i] : w.first[i + 1]], int(count[i]))[0]) ^ int(count[i]) for i in whole], np.uint64)
    values, owners = np.concatenate([runs[inside], short]), np.concatenate([owner[: len(runs)][inside], whole])
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    return values[new], np.searchsorted(owners[new], np.arange(len(texts) + 1))


def set_digests(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever its order; 0 for the empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)])
    size = np.diff(first).astype(np.uint64)
    return np.where(size > 0, mix(sums[first[1:]] - sums[first[:-1]] + size) | np.uint64(1), np.uint64(0))


def signatures(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A bit for each member of each set, in 4 to 8 times as many bits as members (a power of two, 512 to 16384). The halves of one, or-ed, are the signature in half the bits."""
    size = np.diff(first)
    width = np.int64(1) << np.clip(np.ceil(np.log2(np.maximum(size, 1) * 4)).astype(np.int64), 9, 14)
    start = np.concatenate([[0], np.cumsum(width)])
    bits = np.zeros(start[-1], bool)
    owner = np.repeat(np.arange(len(size)), size)
    bits[start[owner] + (mix(values ^ np.uint64(0x8CB92BA72F3D8DD7)) & (width[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    whole = np.packbits(bits, bitorder="little").tobytes()
    return [whole[s // 8 : e // 8] for s, e in zip(start[:-1], start[1:])]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set by its digest, size and signature; at the end, this task's counts of hashed shingles."""
    names = ["doc", "digest", "n", "sig", "part", "counts"]
    total = np.zeros(TABLE, np.int64)
    for b in batches:
        for s, e in slices(b.column(1)):
            values, first = sets(b.column(1).slice(s, e - s))
            total += np.bincount(counter(values), minlength=TABLE)
            m = e - s
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s, m), pa.array(set_digests(values, first).view(np.int64)), pa.array(np.diff(first).astype(np.int64)), pa.array(signatures(values, first), pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
    if total.any():
        yield pa.RecordBatch.from_arrays([*(pa.nulls(PARTS, pa.int64()) for _ in range(3)), pa.nulls(PARTS, pa.binary()), *packed(total)], names)
    trim()


def prefix_size(n):
    return n - -(-PERCENT * n // 100) + 1


def needed(a, b):
    """The least overlap of sets of these sizes that links them."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def reachable(a, b, shared):
    """Whether so many shingles shared in the prefixes can make enough overlap: behind its prefix a set has one less than its share."""
    return shared + -(-PERCENT * np.maximum(a, b) // 100) - 1 >= needed(a, b)


def within(a, b, at_a, at_b):
    """Whether a shared shingle at these places of the orders leaves room for enough overlap, if it is the first one shared."""
    return (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)) & (1 + np.minimum(a - at_a, b - at_b) - 1 >= needed(a, b))


_POSTING = (("x", np.uint64), ("digest", np.uint64), ("n", np.uint32), ("at", np.uint32))


def _postings(level: np.ndarray, routes: int):
    """Texts to the prefixes of their sets, packed by block of columns; equal sets of a flush go once."""

    def flush(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        c = {k: np.concatenate([x[k] for x in held]) for k, _ in _POSTING}
        route = ((c["x"] >> np.uint64(8)) % np.uint64(routes)).astype(np.int64)
        order = np.lexsort((c["x"], c["digest"], route))
        c, route = {k: v[order] for k, v in c.items()}, route[order]
        new = np.ones(len(route), bool)
        new[1:] = (c["x"][1:] != c["x"][:-1]) | (c["digest"][1:] != c["digest"][:-1])
        c, route = {k: v[new] for k, v in c.items()}, route[new]
        edge = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
        ends = np.append(edge[1:], len(route))
        blobs = [b"".join(c[k][s:e].astype(kind).tobytes() for k, kind in _POSTING) for s, e in zip(edge, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(route[edge], pa.int32()), pa.array(blobs, pa.binary())], ["route", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for s, e in slices(b.column(0)):
                values, first = sets(b.column(0).slice(s, e - s))
                if not len(values):
                    continue
                n = np.diff(first)
                owner = np.repeat(np.arange(e - s), n)
                key = (level[counter(values)].astype(np.uint64) << np.uint64(59)) | (mix(values) >> np.uint64(5))
                order = np.lexsort((key, owner))
                at = np.arange(len(values)) - np.repeat(first[:-1], n)
                kept = at < prefix_size(n)[owner]
                digest = set_digests(values, first)
                held.append({"x": values[order][kept], "digest": digest[owner[kept]], "n": n[owner[kept]], "at": at[kept]})
                size += int(kept.sum())
                if size >= 1 << 19:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)
        trim()

    return run


_PAIR = "kind int, x long, a long, b long, n_a int, n_b int, shared int"


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of columns: overlaps of pairs (kind 0), and the rows of columns too common to be multiplied in full (kind 1: x, row, its size and place, the column's rows)."""
    step = sum(np.dtype(k).itemsize for _, k in _POSTING)
    got: dict[str, list[np.ndarray]] = {k: [] for k, _ in _POSTING}
    for b in batches:
        for blob in b.column(1).to_pylist():
            m, at = len(blob) // step, 0
            for k, kind in _POSTING:
                w = m * np.dtype(kind).itemsize
                got[k].append(np.frombuffer(blob[at : at + w], kind))
                at += w
    if not got["x"]:
        return
    c = {k: np.concatenate(v) for k, v in got.items()}
    del got
    order = np.lexsort((c["digest"], c["n"], c["x"]))
    c = {k: v[order] for k, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = (c["x"][1:] != c["x"][:-1]) | (c["digest"][1:] != c["digest"][:-1])
    c = {k: v[new] for k, v in c.items()}
    edge = np.flatnonzero(np.concatenate([[True], c["x"][1:] != c["x"][:-1]]))
    size = np.diff(np.append(edge, len(c["x"])))
    size_of = np.repeat(size, size)
    some = np.flatnonzero(size_of > 1)
    c = {k: v[some] for k, v in c.items()}
    size_of = size_of[some]
    if not len(some):
        return
    n, at = c["n"].astype(np.int64), c["at"].astype(np.int64)
    lefts, rights = [], []
    small = size_of <= FULL
    for gap in range(1, FULL):
        i = np.flatnonzero(small[:-gap] & (c["x"][:-gap] == c["x"][gap:])) if len(small) > gap else np.zeros(0, np.int64)
        lefts.append(i)
        rights.append(i + gap)
    big = np.flatnonzero(~small)
    yield from _rows({"kind": np.ones(len(big), np.int32), "x": c["x"][big].view(np.int64), "a": c["digest"][big].view(np.int64), "b": np.zeros(len(big), np.int64), "n_a": n[big], "n_b": at[big], "shared": size_of[big]})
    i, j = np.concatenate(lefts), np.concatenate(rights)
    ok = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
    i, j = i[ok], j[ok]
    a, b = c["digest"][i], c["digest"][j]
    flip = a > b
    a, b = np.where(flip, b, a), np.where(flip, a, b)
    n_a, n_b = np.where(flip, n[j], n[i]), np.where(flip, n[i], n[j])
    order = np.lexsort((b, a))
    a, b, n_a, n_b = a[order], b[order], n_a[order], n_b[order]
    if len(a):
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        shared = np.diff(np.append(first, len(a)))
        yield from _rows({"kind": np.zeros(len(first), np.int32), "x": np.zeros(len(first), np.int64), "a": a[first].view(np.int64), "b": b[first].view(np.int64), "n_a": n_a[first], "n_b": n_b[first], "shared": shared})
    del c, order, a, b, n_a, n_b, i, j, lefts, rights
    trim()


def _rows(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    kinds = {"kind": np.int32, "x": np.int64, "a": np.int64, "b": np.int64, "n_a": np.int32, "n_b": np.int32, "shared": np.int32}
    for s in range(0, len(c["a"]), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(c[k][s : s + (1 << 18)].astype(kind)) for k, kind in kinds.items()], list(kinds))


def _folded(sigs: list[bytes], size: int) -> np.ndarray:
    """Signatures as rows of 64-bit words, in ``size`` bytes at most each."""
    out = np.zeros((len(sigs), size // 8), np.uint64)
    for i, sig in enumerate(sigs):
        w = np.frombuffer(sig, np.uint64)
        while len(w) > size // 8:
            w = w[: len(w) // 2] | w[len(w) // 2 :]
        out[i] = w
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles, one after another (x, p, q sorted; outside rows first), to the pairs that can link."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        at = [b.column(k).to_numpy() for k in range(3)]
        edge = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in at])]))
        for s, e in zip(edge, np.append(edge[1:], b.num_rows)):
            here = tuple(int(c[s]) for c in at)
            if key is not None and here != key:
                yield from _product(pa.Table.from_batches(held).combine_chunks())
                held = []
            key = here
            held.append(b.slice(s, e - s))
    if held:
        yield from _product(pa.Table.from_batches(held).combine_chunks())
    trim()


def _product(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Outside rows of one tile against its other rows."""
    role = t.column("outside").to_numpy()
    c = {k: t.column(k).to_numpy().astype(np.int64) for k in ("node", "n", "at", "open", "least")}
    sigs = t.column("sig").to_pylist()
    rows = np.flatnonzero(~role)
    rows = rows[np.argsort(c["n"][rows], kind="stable")]
    r = {k: v[rows] for k, v in c.items()}
    widths = np.array([len(sigs[i]) for i in rows])
    # The rows' signatures in each width that an outside row or one of its partners has.
    folded: dict[int, np.ndarray] = {}
    found: list[np.ndarray] = []
    for i in np.flatnonzero(role):
        n = c["n"][i]
        j = np.arange(np.searchsorted(r["n"], -(-PERCENT * n // 100)), np.searchsorted(r["n"], n * 100 // PERCENT, "right"))
        j = j[(r["least"][j] != c["least"][i]) & within(n, r["n"][j], c["at"][i], r["at"][j]) & reachable(n, r["n"][j], np.minimum(c["open"][i], r["open"][j]))]
        for width in np.unique(np.minimum(widths[j], len(sigs[i]))).tolist():
            some = j[np.minimum(widths[j], len(sigs[i])) == width]
            if width not in folded:
                enough = widths >= width
                folded[width] = np.zeros((len(rows), width // 8), np.uint64)
                folded[width][enough] = _folded([sigs[k] for k in rows[enough]], width)
            a, b = _folded([sigs[i]], width)[0], folded[width][some]
            both = np.bitwise_count(a & b).sum(1).astype(np.int64)
            most = np.minimum(n - int(np.bitwise_count(a).sum()), r["n"][some] - np.bitwise_count(b).sum(1).astype(np.int64)) + both
            some = some[most >= needed(n, r["n"][some])]
            found.append(np.stack([np.minimum(c["node"][i], r["node"][some]), np.maximum(c["node"][i], r["node"][some])], 1))
        if sum(map(len, found)) > 1 << 18:
            yield _pairs(found)
            found = []
    if found:
        yield _pairs(found)


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    p = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])


def _least_overlap(a: Column, b: Column) -> Column:
    """:func:`needed` as a column."""
    return F.ceil((a + b) * F.lit(PERCENT) / F.lit(100.0 + PERCENT) - 1e-9)


def _behind(a: Column, b: Column) -> Column:
    """What two sets of these sizes can share behind their prefixes at most."""
    return F.ceil(F.greatest(a, b) * F.lit(PERCENT / 100.0) - 1e-9) - 1


def _sizes_fit(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _leading(own: DataFrame) -> DataFrame:
    """(x, band, lead and its columns) of each column and range of sizes, to be met by rows of that range and its neighbours."""
    lead = F.struct(F.col("node").alias("lead"), F.col("n").alias("n_l"), F.col("at").alias("at_l"), F.col("least").alias("least_l"), F.col("open").alias("open_l"))
    return own.groupBy("x", "band").agg(F.max(F.struct("weight", lead.alias("lead"))).alias("m")).select("x", "band", "m.lead.*")


def star(own: DataFrame) -> DataFrame:
    """Each row (b) with the leading row (a) that it shares most columns with, if that one is in another component and can link."""
    leads = _leading(own).select("*", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("of")).drop("band").withColumnRenamed("of", "band")
    n, m = F.col("n"), F.col("n_l")
    fits = _sizes_fit(n, m) & (F.least(n - F.col("at"), m - F.col("at_l")) >= _least_overlap(n, m)) & (F.least("open", "open_l") + _behind(n, m) >= _least_overlap(n, m))
    met = own.alias("o").join(leads.alias("l"), (F.col("o.x") == F.col("l.x")) & (F.col("o.band") == F.col("l.band")) & (F.col("least") != F.col("least_l")) & fits)
    shared = met.groupBy("node", "lead").agg(F.count("*").alias("shared"))
    best = shared.groupBy("node").agg(F.max(F.struct("shared", "lead")).alias("m"))
    return best.select(F.col("m.lead").alias("a"), F.col("node").alias("b"))


def outside(own: DataFrame) -> DataFrame:
    """Of each column and range of sizes, the rows of other components than its leading row's."""
    return own.join(_leading(own).select("x", "band", "least_l"), ["x", "band"]).where("least <> least_l").drop("least_l")


def across(own: DataFrame, sigs: DataFrame, parts: int) -> DataFrame:
    """The pairs of a common column's rows, of different components, that can link: rows outside the column's largest component with all its rows."""
    counts = own.groupBy("x", "least").agg(F.count("*").alias("rows"))
    main = counts.groupBy("x").agg(F.max(F.struct("rows", "least")).alias("m"), F.count("*").alias("kinds")).where("kinds > 1").select("x", F.col("m.least").alias("main"))
    own = cut(own.join(main, "x").withColumn("outside", F.col("least") != F.col("main")).drop("main", "band", "weight"))
    if own.isEmpty():
        return own.sparkSession.createDataFrame([], "a long, b long")

    def hopeful(low: Column, high: Column) -> Column:
        # What a pair must share in open columns falls with the distance of sizes: the nearest sizes on the far ends decide.
        n = F.col("n")
        low, high = F.greatest(low, F.ceil(n * (PERCENT / 100) - 1e-9)), F.least(high, F.floor(n * (100 / PERCENT) + 1e-9))
        least = lambda b: _least_overlap(n, b) - _behind(n, b)
        return (low <= high) & (F.col("open") >= F.least(least(low), least(high)))

    sizes = own.groupBy("x").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    out = own.where("outside").join(sizes, "x").where(hopeful(F.col("low"), F.col("high"))).drop("low", "high")
    reach = out.groupBy("x").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("outsiders"))
    rows = own.join(reach, "x").where(hopeful(F.col("low"), F.col("high"))).drop("low", "high", "outsiders")
    blocks = rows.groupBy("x").agg(F.ceil(F.count("*") / TILE).cast("int").alias("q_n")).join(reach.select("x", F.ceil(F.col("outsiders") / TILE).cast("int").alias("p_n")), "x")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = out.join(blocks, "x").withColumn("outside", F.lit(True)).withColumn("p", part("p_n")).withColumn("q", every("q_n"))
    right = rows.join(blocks, "x").withColumn("outside", F.lit(False)).withColumn("q", part("q_n")).withColumn("p", every("p_n"))
    names = ["x", "p", "q", "outside", "node", "n", "at", "open", "least"]
    tiles = left.select(names).unionByName(right.select(names)).join(sigs.withColumnRenamed("digest", "node"), "node").select(*names, "sig")
    tiles = tiles.repartition(parts, "x", "p", "q").sortWithinPartitions("x", "p", "q")
    return tiles.mapInArrow(_tiles, "a long, b long").distinct()


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets in order of (a, part), that of ``a`` before those of its partners ``b``, to the pairs that link. One set of ``a`` is held at a time."""
    here, hub = None, np.zeros(0, np.uint64)
    for b in batches:
        a, part, other, packed_sets = b.columns
        keys, single = list(zip(a.to_pylist(), part.to_pylist())), other.is_null().to_numpy(zero_copy_only=False)
        data, offsets = raw(packed_sets)
        ok = np.zeros(b.num_rows, bool)
        for i, key in enumerate(keys):
            values = np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes(), np.uint64)
            if single[i]:
                here, hub = key, values
            elif key == here and len(hub):
                at = np.minimum(np.searchsorted(hub, values), len(hub) - 1)
                both = int((hub[at] == values).sum())
                ok[i] = 100 * both >= PERCENT * (len(hub) + len(values) - both) and both > 0
        if ok.any():
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([a.take(keep), other.take(keep)], ["a", "b"])
    trim()


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node of each component, for every node of ``links`` (a, b), by turns of large and small stars (Kiveris et al., 2014)."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small)
        # Done when every node hangs on one that hangs on none, and nothing changed.
        same = new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        drop(edges)
        rest(edges.sparkSession)
        edges = new
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())


def clusters(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, digest, n, component): for each row its set and the least id of its component."""
    spark = df.sparkSession
    parts = partitions(df)
    base = df.select(F.col(key).cast("long").alias("doc"), text_of(text).alias("text"))
    profile = cut(base.mapInArrow(_profile, "doc long, digest long, n long, sig binary, part int, counts binary"))
    docs = profile.where("part is null").select("doc", "digest", "n")
    level = levels(profile.where("part is not null"))
    blocks = base.select("text").mapInArrow(_postings(level, parts), "route int, blob binary")
    product = cut(blocks.repartition(parts, "route").mapInArrow(_multiply, _PAIR))

    # Overlap in the prefixes, and what may be missing from it: a row's shingles in common columns.
    common = product.where("kind = 1").groupBy("a").agg(F.count("*").alias("open"), F.sum("shared").alias("rows"))
    pairs = product.where("kind = 0").groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("shared").alias("shared"))
    open_ = lambda c: common.select(F.col("a").alias(c), F.col("open").alias(f"open_{c}"))
    pairs = pairs.join(open_("a"), "a", "left").join(open_("b"), "b", "left")
    missing = F.least(F.coalesce("open_a", F.lit(0)), F.coalesce("open_b", F.lit(0)))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    pairs = pairs.where(F.col("shared") + missing + _behind(n_a, n_b) >= _least_overlap(n_a, n_b)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rows = product.where("kind = 1").select("x", F.col("a").alias("node"), F.col("n_a").alias("n"), F.col("n_b").alias("at")).join(common.withColumnRenamed("a", "node"), "node")
    # A row's weight: the mean number of rows in its prefix's columns. Sizes of one band link at most with those of the next.
    prefix = F.col("n") - F.ceil(F.col("n") * (PERCENT / 100) - 1e-9) + 1
    rows = cut(rows.select("x", "node", "n", "at", "open", (F.col("rows") / prefix).alias("weight"), F.floor(F.log(F.col("n")) / F.lit(math.log(100 / PERCENT))).cast("int").alias("band")))
    pairs = cut(pairs)
    drop(product)

    names = docs.where("n > 0").groupBy("digest").agg(F.min("doc").alias("doc"))
    sigs = profile.where("n > 0").groupBy("digest").agg(F.min("sig").alias("sig"))
    found = spark.createDataFrame([], "node long, least long")

    def columns() -> DataFrame:
        return rows.join(found, "node", "left").withColumn("least", F.coalesce("least", "node"))

    held: list[str] = []
    for step in (lambda: star(columns()).unionByName(pairs).distinct(), lambda: star(outside(columns())), lambda: across(columns(), sigs, parts)):
        with collected() as made:
            new = step()
            for c in "ab":
                new = new.join(found.select(F.col("node").alias(c), F.col("least").alias(f"at_{c}")), c, "left")
            new = cut(new.where(F.coalesce("at_a", "a") != F.coalesce("at_b", "b")).select("a", "b"))
            links = None if new.isEmpty() else cut(_settled(base, names, new, parts))
            if links is not None and not links.isEmpty():
                found = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(links))
                # What was cut last holds all components; the step's other tables, and the components before, have served.
                release(spark, held)
                held = [made.pop()]
            release(spark, made)
    named = names.join(found.withColumnRenamed("node", "digest"), "digest", "left").select("digest", F.coalesce("least", "digest").alias("least"), "doc")
    least_doc = named.groupBy("least").agg(F.min("doc").alias("component"))
    named = named.join(least_doc, "least").select("digest", "component")
    return docs.join(named, "digest", "left").select("doc", "digest", "n", F.coalesce("component", "doc").alias("component"))


def _with_digest(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: the hash of the set of each row's ``text``."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).fill_null("")
            for s, e in slices(texts):
                digest = set_digests(*sets(texts.slice(s, e - s)))
                yield pa.RecordBatch.from_arrays([*b.slice(s, e - s).columns, pa.array(digest.view(np.int64))], [*b.schema.names, name])
        trim()

    return df.mapInArrow(run, df.withColumn(name, F.lit(0).cast("long")).schema)


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their sets, by digest: hashes of the shingles, ascending."""
    for b in batches:
        for s, e in slices(b.column(0)):
            values, first = sets(b.column(0).slice(s, e - s))
            body = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([pa.array(set_digests(values, first).view(np.int64)), body], ["digest", "set"])
    trim()


def _settled(base: DataFrame, names: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """The pairs whose sets link. Sets are made once from one text each; that of ``a`` goes once to each part of its partners, so a leading row is spread over as many tasks as there are parts."""
    nodes = cut(pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct())
    chosen = names.join(nodes, "digest").where("doc is not null").select("doc").distinct()
    # An id may have rows of other sets too, and a set may have no id at all: sets go by their own digests.
    rows = base.join(chosen, "doc", "left_semi").unionByName(base.where("doc is null"))
    found = rows.select("text").mapInArrow(_packed_sets, "digest long, set binary")
    held = cut(found.join(nodes, "digest", "left_semi").dropDuplicates(["digest"]))
    routed = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int").alias("part"), "b")
    partners = routed.join(held.withColumnRenamed("digest", "b"), "b").select("a", "part", "b", "set")
    leaders = routed.select("a", "part").distinct().join(held.withColumnRenamed("digest", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "set")
    dealt = leaders.unionByName(partners).repartition(parts, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_decide, "a long, b long")


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: the size of its set and its component."""
    return clusters(df, key, text).select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose id names their component. Rows that repeat an id and its set stay once; rows without an id stay."""
    found = cut(clusters(df, key, text))
    kept = found.where("doc = component").select(F.col("doc").alias("__doc"), F.col("digest").alias("__set")).distinct()
    own = F.col(key).cast("long") == F.col("__doc")
    if found.where("doc is not null").groupBy("doc").count().where("count > 1").isEmpty():
        out = df.join(kept, own, "left_semi")
    else:
        # Rows of one id may have different sets, each with a component of its own.
        digest = "__digest"
        while digest in df.columns:  # a name that the input has not
            digest += "_"
        out = _with_digest(df, text, digest).join(kept, own & (F.col(digest) == F.col("__set")), "left_semi").dropDuplicates([key, digest]).drop(digest)
    return out if found.where("doc is null").isEmpty() else out.unionByName(df.where(F.col(key).isNull()))
