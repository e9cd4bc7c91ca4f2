"""Greedy leader clustering of latents, equal to one thread going through them in order.

A row is a new centre unless an earlier one is nearer than the limit. Against centres
of earlier batches and splits (rule G) the row's forward or reversed code is compared
with the centre's forward code. Within a split (rule L) the row's forward code is
compared with the centre's forward or reversed code. Distances must be strictly below
the limit to match.

Batches are taken from all sources in proportion. In each, one distributed pass drops
what existing centres cover. What is left is a graph: an edge goes from a row to each
later row that it matches, by rule L inside a split and by G between splits. The rows
that one thread would keep are the lexicographically first maximal independent set of
it, which is found by rounds: a row goes when an earlier match is kept, and stays when
all its earlier matches have gone. Edges are made in blocks, for a prefix of the rows
at a time, whose centres then clear the rows after it.

A row whose codes are null or hold null or non-finite numbers is not clustered.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.operators import metric, scoring
from fascicle.operators.metric import matrix, touched
from fascicle.plans.durable import discard, materialise, ranked, with_rank
from fascicle.schema import CENTRE, split_size

#: Rows of a first prefix and of any, edges that a prefix is meant to have, edges that are settled in one block by the driver.
PREFIX, MOST, EDGES, EDGES_HERE = 4096, 1 << 20, 16_000_000, 1_000_000
#: Prefixes of so many rows are met block by block; larger ones by cells.
BLOCKS_ONLY = 16_384
#: Batches of up to so many rows are taken many at a time.
TOGETHER = 4096


def batch_quotas(counts: list[int], batch_size: int) -> list[int]:
    """Rows of each source in a batch: in proportion, one at least, then one up or down source by source until the sum is right."""
    total = sum(counts)
    batch_size = max(min(batch_size, total), len(counts))
    quotas = [max(1, c * batch_size // total) for c in counts] if total else []
    left = batch_size - sum(quotas)
    while left and quotas:
        moved = 0
        for i, c in enumerate(counts):
            if left > 0 and quotas[i] < c:
                quotas[i], left, moved = quotas[i] + 1, left - 1, moved + 1
            elif left < 0 and quotas[i] > 1:
                quotas[i], left, moved = quotas[i] - 1, left + 1, moved + 1
        if not moved:
            break
    return quotas


def with_batches(latents: DataFrame, batch_size: int, source: str = "src", key: str = "sid") -> DataFrame:
    """``latents`` with ``batch_id``: each batch holds the next rows of every source, in proportion to the sources' counts."""
    # Nulls first, as they are ranked.
    counts = sorted(((r[0], r[1]) for r in latents.groupBy(source).count().collect()), key=lambda r: (r[0] is not None, r[0]))
    quotas = batch_quotas([n for _, n in counts], batch_size)
    if not counts:
        return latents.withColumn("quota", F.lit(0).cast("long")).withColumn("batch_id", F.lit(0))
    # Positions come from parts sorted side by side: a source of all rows is no task's own.
    placed = with_rank(latents, source, key, name="__rank")
    begins = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    table = latents.sparkSession.createDataFrame([(s, q, b) for (s, _), q, b in zip(counts, quotas, begins)], f"__source {latents.schema[source].dataType.simpleString()}, quota long, __begin long")
    nth = F.col("__rank") - F.col("__begin")
    return placed.join(F.broadcast(table), F.col(source).eqNullSafe(F.col("__source"))).drop("__source").withColumn("batch_id", F.floor(nth / F.col("quota")).cast("int")).drop("__rank", "__begin")


def random_batches(latents: DataFrame, batch_size: int, batches: int, seed: int, block: int = 1000, key: str = "sid", source: str | None = None) -> DataFrame:
    """Batches of runs of ``block`` rows, with replacement. A run's start is drawn from the first 60 bits of the digest of its seed, batch and number."""
    placed, total = ranked(latents, *([source] if source else []), key)
    runs = -(-batch_size // block)
    table = latents.sparkSession.range(batches * runs).select((F.col("id") / runs).cast("int").alias("batch_id"), (F.col("id") % runs).cast("int").alias("run"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "batch_id", "run").cast("binary")), 1, 15), 16, 10).cast("long")
    table = table.withColumn("start", drawn % max(total, 1))
    # The rows of each run by position; runs past the end go on at the beginning.
    wanted = table.select("batch_id", "run", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("i"), "start")
    wanted = wanted.select("batch_id", "run", "i", ((F.col("start") + F.col("i")) % max(total, 1)).alias("rank")).where(F.col("run") * block + F.col("i") < batch_size)
    return wanted.join(placed, "rank").drop("rank")


@dataclass
class Known:
    """Centres that rows are held against: arrays as long as they may travel with a task, tables (rank, split, z_fwd, z_rev) beyond."""

    pieces: list[pa.Table | DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.carried = all(isinstance(p, pa.Table) for p in self.pieces)
        held = [p for p in self.pieces if isinstance(p, pa.Table) and p.num_rows]
        if self.carried and held:
            t = pa.concat_tables(held)
            self.split = t.column("split").to_numpy()
            self.fwd, self.rev = (matrix(t.column(c).combine_chunks()) for c in ("z_fwd", "z_rev"))

    @property
    def empty(self) -> bool:
        return self.carried and not any(p.num_rows for p in self.pieces)

    def room(self, rows: int, width: int) -> bool:
        """Whether so many more may travel too."""
        return self.carried and 2 * (0 if self.empty else self.fwd.size) + 2 * rows * width <= scoring.SLICE_NUMBERS

    def with_(self, pieces: list[pa.Table | DataFrame]) -> Known:
        """And further ones, of other batches than the rows to come."""
        away = [p.set_column(p.column_names.index("split"), "split", pa.array(np.full(p.num_rows, ELSEWHERE))) if isinstance(p, pa.Table) else p.withColumn("split", F.lit(ELSEWHERE).cast("long")) for p in pieces]
        return Known(self.pieces + away)

    def table(self, spark: SparkSession) -> DataFrame:
        own = [spark.createDataFrame(p.select(_NAMES), _ROW) if isinstance(p, pa.Table) else p.select(_NAMES) for p in self.pieces]
        return functools.reduce(DataFrame.unionByName, own)


#: No split's number: centres that every row meets by rule G.
ELSEWHERE = -1
_ROW = "rank long, split long, z_fwd array<double>, z_rev array<double>"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _rule(own: np.ndarray, tag: np.ndarray, other: np.ndarray, other_tag: np.ndarray) -> np.ndarray:
    """Tags are twice the split, and one more for a reversed code. Forward codes meet by both rules, the row's reversed code by G, the centre's by L."""
    rev, other_rev, same = tag & 1 == 1, other_tag & 1 == 1, tag >> 1 == other_tag >> 1
    return ~rev & ~other_rev | rev & ~other_rev & ~same | ~rev & other_rev & same


def _either(own: np.ndarray, tag: np.ndarray, other: np.ndarray, other_tag: np.ndarray) -> np.ndarray:
    """As :func:`_rule` with the batch for the split, but within one both rules count."""
    return (other_tag & 1 == 0) | (tag & 1 == 0) & (tag >> 1 == other_tag >> 1)


def _codes(rows: DataFrame) -> DataFrame:
    """Two points a row, (id, tag, z)."""
    side = lambda k, c: F.struct((F.col("split") * 2 + k).alias("tag"), F.col(c).alias("z"))
    return rows.select(F.col("rank").alias("id"), F.explode(F.array(side(0, "z_fwd"), side(1, "z_rev"))).alias("c")).select("id", "c.tag", "c.z")


def _open(rows: DataFrame, known: Known, limit: float) -> DataFrame:
    """The rows (rank, split, z_fwd, z_rev, ranks unique) that no known centre matches."""
    if known.empty:
        return rows
    if not known.carried:
        cells, placed = metric.build(_codes(known.table(rows.sparkSession)))
        hit = metric.pairs(_codes(rows), cells, placed, limit, _rule)
        return rows.join(hit.select(F.col("id").alias("rank")).distinct(), "rank", "left_anti")
    split, fwd, rev, limit2 = known.split, known.fwd, known.rev, limit * limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y, own = matrix(b.column("z_fwd"), fwd.shape[1]), matrix(b.column("z_rev"), fwd.shape[1]), b.column("split").to_numpy()
            far = ~touched(x, fwd, limit2)
            for s in np.unique(own[far]):
                mine, here = np.flatnonzero(far & (own == s)), split == s
                far[mine] &= ~touched(y[mine], fwd[~here], limit2) & ~touched(x[mine], rev[here], limit2)
            yield b.filter(pa.array(far))

    return rows.mapInArrow(run, rows.schema)


def uncovered(latents: DataFrame, centres: DataFrame, limit2: float) -> DataFrame:
    """Rows that no centre's forward code matches, by rule G."""
    kept = centres.select(F.lit(0).cast("long").alias("rank"), F.lit(ELSEWHERE).cast("long").alias("split"), *(F.col(c).cast("array<double>").alias(c) for c in ("z_fwd", "z_rev")))
    n, width = kept.agg(F.count("*"), F.max(F.size("z_fwd"))).first()
    known = Known([kept.toArrow() if Known().room(n, width or 0) else kept])
    rows = latents.withColumn("split", F.lit(0).cast("long"))
    return _open(_numbered(rows, known), known, limit2**0.5).select(latents.columns)


def _numbered(rows: DataFrame, known: Known) -> DataFrame:
    """Rows with a number each in ``rank``; written if they are to be found again by it."""
    out = rows.withColumn("rank", F.monotonically_increasing_id())
    return out if known.carried else materialise(out)


def settle(later: np.ndarray, earlier: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One block of edges: (rows, kept or not) of all that can be told. ``state`` of the earlier row: 1 kept, 0 dropped, -1 open.

    A row is dropped once an earlier one that matches it is kept, and kept once all of
    them are dropped. Rows are taken in order, so that a chain inside a block is told in
    one go.
    """
    order = np.lexsort((earlier, later))
    told: dict[int, bool] = {}
    i = 0
    later, earlier, state = later[order].tolist(), earlier[order].tolist(), state[order].tolist()
    while i < len(later):
        row, kept, sure = later[i], True, True
        while i < len(later) and later[i] == row:
            of = state[i] if state[i] >= 0 else told.get(earlier[i], -1)
            kept &= of != 1
            sure &= of != -1
            i += 1
        if sure or not kept:
            told[row] = kept
    return np.array(list(told), np.int64), np.array(list(told.values()), bool)


#: Kinds of edges: by both rules, by the row's reversed code (G only), by the centre's (L only).
BOTH, ONLY_G, ONLY_L = 0, 1, 2


def settle_splits(later: np.ndarray, earlier: np.ndarray, kind: np.ndarray, state: np.ndarray, bounds: np.ndarray, split: Callable[[int], int]) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`settle`, for rows in batches that begin at ``bounds``, which ends with the end of the last.

    What earlier batches leave open of a batch is cut into splits of ``split(open rows)``;
    a batch is told once that is known. Rows without an edge are open, and stay.
    """
    order = np.lexsort((earlier, later))
    later, earlier, kind, state = (v[order] for v in (later, earlier, kind, state))
    own = np.searchsorted(bounds, later, "right") - 1
    cuts = np.flatnonzero(np.diff(own, prepend=-1)).tolist() if len(own) else []
    told: dict[int, bool] = {}
    for s, e in zip(cuts, [*cuts[1:], len(own)]):
        first, end = int(bounds[own[s]]), int(bounds[own[s] + 1])
        row, other, how = later[s:e].tolist(), earlier[s:e].tolist(), kind[s:e].tolist()
        covered, doubtful = set(), set()
        for i in np.flatnonzero((earlier[s:e] < first) & (kind[s:e] != ONLY_L)).tolist():
            of = state[s + i] if state[s + i] >= 0 else told.get(other[i], -1)
            if of == 1:
                covered.add(row[i])
            elif of == -1:
                doubtful.add(row[i])
        if doubtful - covered:
            continue
        free = np.ones(end - first, bool)
        free[np.array(sorted(covered), np.int64) - first] = False
        place = ((np.cumsum(free) - 1) // max(split(int(free.sum())), 1)).tolist()
        for i, (r, c, k) in enumerate(zip(row, other, how)):
            if i == 0 or row[i - 1] != r:
                told[r] = r not in covered
            if told[r] and c >= first and told.get(c, True) and k != (ONLY_G if place[r - first] == place[c - first] else ONLY_L):
                told[r] = False
    return np.array(list(told), np.int64), np.array(list(told.values()), bool)


def dropped(edges: DataFrame, block: int, here: int, most: int, bounds: np.ndarray | None = None, split: Callable[[int], int] | None = None) -> tuple[DataFrame, int, int]:
    """The rows that lose, of all that have an edge (id, other) to an earlier match, the count of edges, ``most`` at most, and the rounds it took.

    With ``bounds`` and ``split`` edges have a kind, and rows are in batches, as for :func:`settle_splits`.

    Rounds go over blocks of consecutive rows side by side; in each, a block tells what
    follows from what is told so far. A round tells the first open row and whatever
    hangs on it in its block, so there are at most as many rounds as blocks. Up to
    ``here`` edges are one block, which the driver settles.
    """
    spark, own, n = edges.sparkSession, edges.columns, most
    tell = settle if bounds is None else lambda *columns: settle_splits(*columns, bounds, split)
    if most > here:
        edges = materialise(edges)
        n = edges.count()
    if n <= here:
        t = edges.toArrow()
        i, c, *kind = (t.column(k).to_numpy() for k in own)
        state = np.where(np.isin(c, i), -1, 1)
        rows, kept = tell(i, c, *kind, state)
        discard(edges)
        return spark.createDataFrame(pa.table({"rank": rows[~kept]}), "rank long"), len(i), 1
    free = edges.select(F.col("id").alias("other"), F.lit(-1).alias("state")).distinct()
    number = F.floor(F.col("id") / block)
    if bounds is not None:
        # Whole batches: a block ends with the batch that fills it.
        ends = bounds[1:][np.diff(bounds[1:] // block, append=-1) != 0]
        number = F.size(F.filter(F.lit(ends.tolist()), lambda v: v <= F.col("id")))
    # An earlier row without an edge of its own stays.
    open_ = materialise(edges.distinct().join(free, "other", "left").select(*own, F.coalesce("state", F.lit(1)).alias("state"), number.alias("block")))
    lost, rounds = None, 0

    def run(t: pa.Table) -> pa.Table:
        rows, kept = tell(*(t.column(c).to_numpy() for c in [*own, "state"]))
        return pa.table({"id": rows, "kept": kept})

    while True:
        told = materialise(open_.groupBy("block").applyInArrow(run, "id long, kept boolean"))
        rounds += 1
        mine = told.where(~F.col("kept")).select(F.col("id").alias("rank"))
        lost = mine if lost is None else lost.unionByName(mine)
        left = open_.join(told.select("id"), "id", "left_anti").join(told.select(F.col("id").alias("other"), "kept"), "other", "left")
        left = materialise(left.select(*own, F.coalesce(F.col("kept").cast("int"), "state").alias("state"), "block"))
        discard(open_)
        open_ = left
        if open_.isEmpty():
            discard(edges)
            return lost, n, rounds


def _fine(code: str) -> F.Column:
    return F.col(code).isNotNull() & F.forall(code, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def find_centers(
    latents: DataFrame, max_dist: float, scaler: float = 1.0, batch_size: int = 1_000_000, key: str = "sid", source: str | None = None, max_iteration: int | None = None, shuffle_seed: int | None = None,
    split=split_size, random_seed: int | None = None, mini_batch: int = 1000, report: list | None = None, prefix: int | None = None, here: int | None = None,
) -> DataFrame:
    """(label, z_fwd, z_rev) of the centres, labelled in the order they are found.

    With ``random_seed`` batches are runs of ``mini_batch`` rows from random places, with
    replacement, as many batches as hold the number of rows; rows that no run meets are
    not clustered.

    ``max_dist`` is in units of the scores. ``report`` gets a line for each prefix: its
    batch, rows, edges and rounds. ``prefix`` rows are settled at first, and up to
    ``here`` edges in one block.
    """
    spark = latents.sparkSession
    limit = max_dist / scaler
    rows = latents.select(key, *([source] if source else []), F.col("z_fwd").cast("array<double>"), F.col("z_rev").cast("array<double>")).where(_fine("z_fwd") & _fine("z_rev"))
    order = [source or "src", key]
    # Where every batch is one split whatever is left of it, the rule of each pair is known: all batches are one order.
    whole = shuffle_seed is None and all(split(n) >= n for n in range(1, batch_size + 1))
    known, found, done, largest, width = Known(), [], 0, 0, 0
    line = lambda b: lambda told: report.append({"batch": b, **told}) if report is not None else None
    if whole and source is None and random_seed is None:
        # One ranking says both the batch and the place in it.
        rows, n = ranked(rows, key)
        size = max(min(batch_size, n), 1)
        n = min(n, size * (max_iteration or n))
        left = rows.where(F.col("rank") < n).select("rank", F.floor(F.col("rank") / size).alias("split"), "z_fwd", "z_rev")
        width = rows.agg(F.max(F.size("z_fwd"))).first()[0] if n else 0
        fresh = _leaders(left, n, limit, known, width, prefix or PREFIX, EDGES_HERE if here is None else here, line(0))
        found, known = [(0, piece) for piece in fresh], Known(fresh)
    else:
        if random_seed is None:
            dealt = with_batches(rows if source else rows.withColumn("src", F.lit(0)), batch_size, order[0], key)
        else:
            dealt = random_batches(rows, batch_size, min(-(-rows.count() // batch_size), max_iteration or 1 << 31), random_seed, mini_batch, key, source)
            order = ["run", "i"]
        # Unless batches are taken together, a folder for each, so that each is read alone; its rows are dealt to several files.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = materialise(dealt) if whole or batch_size <= TOGETHER else materialise(dealt.repartition(parts, "batch_id", F.pmod(F.xxhash64(key), F.lit(8))), "batch_id")
        batches, width = rows.agg(F.max("batch_id"), F.max(F.size("z_fwd"))).first()
        done = 0 if batches is None else min(batches + 1, max_iteration or batches + 1)
        # A batch has a row of each source at least, and so may be larger than meant.
        largest = rows.groupBy("batch_id").count().agg(F.max("count")).first()[0] if done > 1 and (whole or batch_size <= TOGETHER) else 0
    if largest and whole and all(split(n) >= n for n in range(batch_size + 1, largest + 1)):
        left, n = ranked(rows.where(F.col("batch_id") < done), "batch_id", *order)
        left = left.select("rank", F.col("batch_id").cast("long").alias("split"), "z_fwd", "z_rev")
        fresh = _leaders(left, n, limit, known, width, prefix or PREFIX, EDGES_HERE if here is None else here, line(0))
        found, known, done = [(0, piece) for piece in fresh], Known(fresh), 0
    elif 0 < largest <= TOGETHER:
        own, by = rows.where(F.col("batch_id") < done), ["batch_id", *order]
        if shuffle_seed is not None:
            own, by = own.withColumn("__random", F.xxhash64(F.lit(shuffle_seed), "batch_id", key)), ["batch_id", "__random", *order]
        left, n = ranked(own, *by)
        left = left.select("rank", F.col("batch_id").cast("long").alias("split"), "z_fwd", "z_rev")
        fresh = _in_splits(left, n, limit, known, width, prefix or PREFIX, EDGES_HERE if here is None else here, split, report.append if report is not None else lambda line: None)
        found, known, done = list(enumerate(fresh)), Known(fresh), 0
    for b in range(done):
        own = rows.where(F.col("batch_id") == b)
        by = order
        if shuffle_seed is not None:
            own, by = own.withColumn("__random", F.xxhash64(F.lit(shuffle_seed), F.lit(b), key)), ["__random", *order]
        if not known.empty:
            own = _open(_numbered(own.withColumn("split", F.lit(0).cast("long")), known), known, limit).drop("rank", "split")
        left, n = ranked(own, *by)
        left = left.select("rank", F.floor(F.col("rank") / max(split(n), 1)).alias("split"), "z_fwd", "z_rev")
        fresh = _leaders(left, n, limit, known, width, prefix or PREFIX, EDGES_HERE if here is None else here, line(b))
        found += [(b, piece) for piece in fresh]
        known = known.with_(fresh)
    discard(rows)
    if known.carried:
        labels = np.arange(1, sum(p.num_rows for _, p in found) + 1, dtype=np.int32)
        every = pa.concat_tables([p.select(["z_fwd", "z_rev"]) for _, p in found]) if len(labels) else None
        return spark.createDataFrame([] if every is None else every.add_column(0, "label", pa.array(labels)), CENTRE)
    pieces = [(spark.createDataFrame(p.select(_NAMES), _ROW) if isinstance(p, pa.Table) else p).withColumn("batch", F.lit(b)) for b, p in found]
    out, _ = ranked(functools.reduce(DataFrame.unionByName, pieces), "batch", "rank", name="nth")
    return out.select((F.col("nth") + 1).cast("int").alias("label"), "z_fwd", "z_rev")


def extend(rows: DataFrame, centres: DataFrame, max_dist: float, scaler: float = 1.0, order: list[str] | None = None, split=split_size, report: list | None = None) -> DataFrame:
    """(rank, z_fwd, z_rev) of the centres that one more batch adds to ``centres`` (z_fwd, z_rev), in its order."""
    limit, spark = max_dist / scaler, rows.sparkSession
    code = lambda c: F.col(c).cast("array<double>").alias(c)
    held = centres.select(F.lit(0).cast("long").alias("rank"), F.lit(ELSEWHERE).cast("long").alias("split"), code("z_fwd"), code("z_rev"))
    n, width = held.agg(F.count("*"), F.max(F.size("z_fwd"))).first()
    known = Known([held.toArrow() if Known().room(n, width or 0) else held]) if n else Known()
    order = order or ["sid"]
    own = rows.select(*order, code("z_fwd"), code("z_rev")).where(_fine("z_fwd") & _fine("z_rev"))
    if n:
        own = _open(_numbered(own.withColumn("split", F.lit(0).cast("long")), known), known, limit).drop("rank", "split")
    left, m = ranked(own, *order)
    left = left.select("rank", F.floor(F.col("rank") / max(split(m), 1)).alias("split"), "z_fwd", "z_rev")
    width = width or (left.select(F.max(F.size("z_fwd"))).first()[0] if m else 0) or 0
    fresh = _leaders(left, m, limit, known, width, PREFIX, EDGES_HERE, report.append if report is not None else lambda told: None)
    pieces = [spark.createDataFrame(p.select(_NAMES), _ROW) if isinstance(p, pa.Table) else p for p in fresh]
    return (functools.reduce(DataFrame.unionByName, pieces) if pieces else spark.createDataFrame([], _ROW)).select("rank", "z_fwd", "z_rev")


def _leaders(left: DataFrame, n: int, limit: float, known: Known, width: int, prefix: int, here: int, report: Callable[[dict], None]) -> list[pa.Table | DataFrame]:
    """The rows of a batch (rank, split, z_fwd, z_rev) that stay centres, piece by piece.

    A prefix of the ranks is settled by its edges, then its centres clear the rows after
    it. Prefixes grow as long as their edges stay few.
    """
    pieces, begin, rest, rows = [], 0, n, 0
    while rest:
        end = min(n, begin + -(-prefix * (n - begin) // rest))
        part = left.where((F.col("rank") >= begin) & (F.col("rank") < end)) if end - begin < n else left
        codes = _codes(part)
        cells, placed = metric.blocks(codes, begin, end) if end - begin <= BLOCKS_ONLY else metric.build(codes)
        # A pair may meet twice, by either code.
        lost, count, rounds = dropped(metric.pairs(codes, cells, placed, limit, _rule, earlier=True), max(1, (end - begin) // 64), here, (end - begin) ** 2)
        kept = part.join(lost, "rank", "left_anti").select(_NAMES)
        rows += end - begin
        pieces.append(kept.toArrow().sort_by("rank") if known.room(rows, width) else materialise(kept))
        report({"rows": min(prefix, rest), "edges": count, "rounds": rounds})
        prefix = int(min(4 * prefix, max(prefix // 2, PREFIX, prefix * (EDGES / max(count, 1)) ** 0.5), MOST))
        if end >= n:
            break
        # Centres of this prefix clear what comes later: by rule L in their own split.
        after = materialise(_open(left.where(F.col("rank") >= end), Known(pieces[-1:]), limit))
        discard(left)
        left, begin, rest = after, end, after.count()
    return pieces


def _in_splits(left: DataFrame, n: int, limit: float, known: Known, width: int, prefix: int, here: int, split: Callable[[int], int], report: Callable[[dict], None]) -> list[pa.Table | DataFrame]:
    """As :func:`_leaders`, of many batches (rank, split, z_fwd, z_rev; ``split`` is the batch, ranks have no gaps), each cut into splits as it comes.

    A prefix is whole batches, so that its centres meet the rows after it by rule G. What
    they leave open is ranked anew: covered rows are in no split.
    """
    pieces, rows = [], 0
    while n:
        # A line for each batch.
        counts = sorted((r[0], r[1]) for r in left.groupBy("split").count().collect())
        bounds = np.concatenate([[0], np.cumsum([c for _, c in counts])])
        batches = max(1, int(np.searchsorted(bounds, prefix, "right")) - 1)
        bounds = bounds[: batches + 1]
        end = int(bounds[-1])
        part = left.where(F.col("rank") < end) if end < n else left
        codes = _codes(part)
        cells, placed = metric.blocks(codes, 0, end) if end <= BLOCKS_ONLY else metric.build(codes)
        edges = metric.pairs(codes, cells, placed, limit, _either, earlier=True, kinds=True)
        # A pair may meet three times, by any of its codes.
        lost, count, rounds = dropped(edges, max(1, end // 64), here, 3 * end**2 // 2, bounds, split)
        kept = part.join(lost, "rank", "left_anti").select(_NAMES)
        rows += end
        pieces.append(kept.toArrow().sort_by("rank") if known.room(rows, width) else materialise(kept))
        report({"batch": counts[0][0], "batches": batches, "rows": end, "edges": count, "rounds": rounds})
        prefix = int(min(4 * prefix, max(prefix // 2, PREFIX, prefix * (EDGES / max(count, 1)) ** 0.5), MOST))
        if end >= n:
            break
        after, n = ranked(_open(left.where(F.col("rank") >= end), Known(pieces[-1:]), limit).withColumnRenamed("rank", "__before"), "__before")
        discard(left)
        left = after.select(_NAMES)
        left.table_path = after.table_path
    return pieces
