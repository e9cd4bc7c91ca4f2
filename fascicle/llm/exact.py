"""Exact deduplication by Grace hashing.

Records are dealt by a hash of their text, so that equal texts meet in one bucket. A
bucket goes through an open-addressing table that compares complete contents: hashes
only say where to look. When a bucket's distinct texts outgrow its table, texts that
the table already holds go on being settled, and every other record is spilled to a
written table, dealt again by the next level's hash and settled there, level by level
until nothing is left.

Before the first deal each task collapses the equal texts of a window of its own rows
in a table of the same kind, so that a text with any number of copies is one record for
each window. What is dealt is the text; the rows themselves stay where they were
written and learn their verdict by the unique number of their record, so that no bucket
gives out the rows of a large group.

Of equal texts the row with the largest key stays; of rows that repeat that key one
stays. Null keys count as smallest: a group of null keys only has a null ``keep_id``,
and one of its rows stays. A null text counts as empty. Texts are equal when their
UTF-8 bytes are. An empty table gives an empty result. Columns of any name may be
there: only the key and the text are read, and :func:`representatives` carries the
others in a struct, where no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fascicle.llm.common import cut, partitions, slices, text_of, trim

#: Distinct text and rows that a task collapses at a time before they are dealt.
WINDOW_BYTES, WINDOW_ROWS = 8 << 20, 1 << 16
#: Distinct text that a bucket's table holds; what comes after is spilled.
TABLE_BYTES = 64 << 20
#: Compressed text that is meant for one bucket.
BUCKET_BYTES = 16 << 20


class ContentTable:
    """Distinct texts by open addressing with linear probing; at most half of the slots are taken."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, text: bytes) -> int:
        """The number of ``text``, or, if it is new, -1 less the slot where it belongs."""
        slots, last = self.slots, len(self.slots) - 1
        at = h & last
        while (n := slots[at]) >= 0:
            if self.hashes[n] == h and self.texts[n] == text:
                return n
            at = at + 1 & last
        return -1 - at

    def add(self, slot: int, h: int, text: bytes) -> int:
        n = self.slots[slot] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.bytes += len(text) + 64
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return n

    def _grow(self) -> None:
        last = 2 * len(self.slots) - 1
        slots = [-1] * (last + 1)
        for n, h in enumerate(self.hashes):
            at = h & last
            while slots[at] >= 0:
                at = at + 1 & last
            slots[at] = n
        self.slots = slots


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33
    table, groups, tops, rows, base, kind = ContentTable(), [], [], [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        rows.append(b.column("row"))
        kind = b.column("key").type
        for i, (h, text, key) in enumerate(zip(*(b.column(c).to_pylist() for c in ("hash", "text", "key")))):
            n = table.find(h, text)
            if n < 0:
                n = table.add(-1 - n, h, text)
                groups.append([])
                tops.append((None, 0))
            if not groups[n] or key is not None and (tops[n][0] is None or key > tops[n][0]):
                tops[n] = (key, len(groups[n]))
            groups[n].append(base + i)
        base += b.num_rows
        if table.bytes >= WINDOW_BYTES or base >= WINDOW_ROWS:
            yield from _records(number, table, groups, tops, rows, kind)
            number += len(groups)
            table, groups, tops, rows, base = ContentTable(), [], [], [], 0
    if groups:
        yield from _records(number, table, groups, tops, rows, kind)
    trim()


def _records(number: int, table: ContentTable, groups: list[list[int]], tops: list[tuple], rows: list[pa.Array], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The window's records, in batches of about a megabyte: larger ones would stay in the JVM's buffers."""
    sizes = np.array([len(g) for g in groups])
    order = np.concatenate([np.array(g) for g in groups])
    members = pa.concat_arrays(rows).take(pa.array(order))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), members)
    whole = pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(number, number + len(groups))),
            pa.array(table.hashes, pa.int64()),
            pa.array(table.texts, pa.binary()),
            lists,
            pa.array([t[0] for t in tops], kind),
            pa.array([t[1] for t in tops], pa.int32()),
            pa.array(sizes),
            pa.array([hashlib.sha256(t).hexdigest() for t in table.texts]),
        ],
        ["record", "hash", "text", "rows", "top", "at", "n", "sha"],
    )
    for start, end in slices(whole.column("text")):
        yield whole.slice(start, end - start)


def _bucket(most: int):
    """A bucket's records through its table: (record, keep, size, holds) of those that are settled, (record, hash, text, n, top) of those that are spilled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, records, tops, sizes, full, kind = ContentTable(), [], [], [], False, None
        for b in batches:
            late, kind = [], b.column("top").type
            for i, (record, h, text, n, top) in enumerate(zip(*(b.column(c).to_pylist() for c in ("record", "hash", "text", "n", "top")))):
                at = table.find(h, text)
                if at < 0:
                    if full:  # for good: no copy of a spilled text may enter later
                        late.append(i)
                        continue
                    at = table.add(-1 - at, h, text)
                    records.append([])
                    tops.append((None, record))
                    sizes.append(0)
                    full = table.bytes >= most
                records[at].append(record)
                sizes[at] += n
                if top is not None and (tops[at][0] is None or top > tops[at][0]):
                    tops[at] = (top, record)
            if late:
                spilled = b.take(pa.array(late))
                empty = [pa.nulls(len(late), t) for t in (kind, pa.int64(), pa.bool_())]
                yield pa.RecordBatch.from_arrays([spilled.column("record"), *empty, *(spilled.column(c) for c in ("hash", "text", "n", "top"))], _SETTLED)
        table = None
        for s in range(0, len(records), 4096):
            out = [(r, tops[g][0], sizes[g], r == tops[g][1]) for g in range(s, min(s + 4096, len(records))) for r in records[g]]
            for t in range(0, len(out), 1 << 14):
                settled = [pa.array(c, k) for c, k in zip(zip(*out[t : t + (1 << 14)]), (pa.int64(), kind, pa.int64(), pa.bool_()))]
                empty = [pa.nulls(len(settled[0]), k) for k in (pa.int64(), pa.binary(), pa.int64(), kind)]
                yield pa.RecordBatch.from_arrays([*settled, *empty], _SETTLED)
        trim()

    return run


_SETTLED = ["record", "keep", "size", "holds", "hash", "text", "n", "top"]


def _verdicts(docs: DataFrame, key: str, text: str, table_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The records of :func:`_collapse`, written, and for each its (record, keep, size, holds)."""
    kind = docs.schema[key].dataType.simpleString()
    content = text_of(text).cast("binary")
    row = docs.select(content.alias("text"), F.xxhash64(content).alias("hash"), F.col(key).alias("key"), F.struct(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("own"), F.col(text).isNull().alias("none")).alias("row"))
    held = row.schema["row"].dataType.simpleString()
    schema = f"record long, hash long, text binary, rows array<{held}>, top {kind}, at int, n long, sha string"
    records = cut(row.mapInArrow(_collapse, schema))
    left, settled, level = records.select("record", "hash", "text", "n", "top"), None, 0
    while True:
        dealt = left.repartition(partitions(left, BUCKET_BYTES), F.xxhash64("hash", F.lit(level)))
        done = cut(dealt.mapInArrow(_bucket(table_bytes), f"record long, keep {kind}, size long, holds boolean, hash long, text binary, n long, top {kind}"))
        own = done.where(F.col("text").isNull()).select("record", "keep", "size", "holds")
        settled = own if settled is None else settled.unionByName(own)
        left, level = done.where(F.col("text").isNotNull()).select("record", "hash", "text", "n", "top"), level + 1
        if left.isEmpty():
            return records, settled


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(``key``, keep_id, group_size, kept, text_sha256) of every row, dropped ones too."""
    records, settled = _verdicts(docs.select(key, text), key, text, table_bytes)
    rows = records.select("record", "rows", "at", "sha").join(settled, "record")
    rows = rows.select(F.posexplode("rows").alias("pos", "row"), "at", "sha", "keep", "size", "holds")
    return rows.select(F.col(f"row.own.`{key}`").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("holds") & (F.col("pos") == F.col("at"))).alias("kept"), F.col("sha").alias("text_sha256"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns as they were."""
    records, settled = _verdicts(docs, key, text, table_bytes)
    stay = records.join(settled.where("holds").select("record"), "record").select("text", F.get("rows", F.col("at")).alias("row"))
    whole = F.when(~F.col("row.none"), F.col("text").cast("string"))
    return stay.select(*(whole.alias(c) if c == text else F.col(f"row.own.`{c}`").alias(c) for c in docs.columns))
