"""Benchmark decontamination: a BM25 inverted index of test items, queried with every training passage.

An item's passages of a document are twice the item's words long and one item's words
apart, so that each run of its length lies whole in one of them. Its score in a passage
is the BM25 sum over the passage's distinct words, as a share of the sum that all its
own words reach; it counts where the share is at least ``least`` and the passage also
holds the question and the answer: at least ``overlap`` of the word trigrams of each.
To find these passages, a document is cut into wide ones, in which every item's
passages lie whole whatever its length; a wide passage's distinct words are a query,
and block-max WAND retrieves all items whose share there reaches ``least``. A share
never falls when a passage grows, so no item's own passage is missed, and no item's
result depends on the other items' lengths. An item's last line, or else last sentence, is its answer; an item
of one sentence is taken in halves, so that both must be there.

The index goes to the executors. Benchmarks beyond ``SLICE_BYTES`` of text are cut
into slices of items, each with an index and a pass of its own; the number of items,
document frequencies, mean length and longest item are those of the whole benchmark,
so scores and passages do not depend on the slices.

Null and empty texts and items match nothing. Repeated items give a row each.
Items are scored word by word, in lower case; punctuation parts words. Long documents are searched whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fascicle.llm.bytescan import SIGNS, Words, shingles
from fascicle.llm.common import raw, slices, text_of, trim

K1, B = 1.2, 0.75
SLICE_BYTES = 8 << 20
#: Items to a block, and blocks to a wider one that is tested first.
BLOCK, WIDE = 2, 8
#: Sums of the same impacts in another order differ by less.
SLACK = 1e-9
#: Sums that are held together, passages times blocks.
AT_ONCE = 1 << 20


def _hashes(texts: list[str]) -> list[np.ndarray]:
    data, offsets = raw(pc.utf8_lower(pa.array(texts, pa.string())))
    w = Words(data, offsets, SIGNS)
    return np.split(w.hashes(), w.first[1:-1])


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item; of one sentence the first and the second half of its words, of one word twice that."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 2:
        lines = [x for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]
    if len(lines) < 2 and len(words := text.split()) > 1:
        lines = [" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])]
    return ("\n".join(lines[:-1]), lines[-1]) if len(lines) > 1 else (text, text)


def trigrams(hashes: np.ndarray) -> np.ndarray:
    return np.unique(shingles(hashes, min(3, max(1, len(hashes)))))


@dataclass
class Statistics:
    """Of all items with words: their number, words in all, the longest one's, and the document frequency of each term (ascending)."""

    items: int
    words: int
    longest: int
    terms: np.ndarray
    df: np.ndarray

    @staticmethod
    def of(words: list[np.ndarray]) -> Statistics:
        terms, df = np.unique(np.concatenate([np.unique(w) for w in words]) if words else np.zeros(0, np.uint64), return_counts=True)
        return Statistics(sum(len(w) > 0 for w in words), sum(map(len, words)), max(map(len, words), default=0), terms, df.astype(np.int64))

    def __add__(self, other: Statistics) -> Statistics:
        terms, at = np.unique(np.concatenate([self.terms, other.terms]), return_inverse=True)
        df = np.zeros(len(terms), np.int64)
        np.add.at(df, at, np.concatenate([self.df, other.df]))
        return Statistics(self.items + other.items, self.words + other.words, max(self.longest, other.longest), terms, df)


class Lists:
    """For each term an ascending list of places with a number each, one after another in flat arrays."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, values: np.ndarray, size: int):
        order = np.lexsort((places, terms))
        terms, places, values = terms[order], places[order], values[order]
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (places[1:] != places[:-1])
        first = np.flatnonzero(new)
        self.place = places[first].astype(np.int32)
        #: The highest value where a place occurs more than once.
        self.value = np.maximum.reduceat(values, first) if len(first) else values
        self.at = np.searchsorted(terms[first], np.arange(size + 1))

    def of(self, term: int) -> tuple[list[int], list[float]]:
        s, e = self.at[term], self.at[term + 1]
        return self.place[s:e].tolist(), self.value[s:e].tolist()

    def sums(self, terms: np.ndarray, group: np.ndarray, groups: int, places: int) -> np.ndarray:
        """Groups by places: the sum of the values of each group's terms."""
        size = self.at[terms + 1] - self.at[terms]
        ends = np.cumsum(size)
        take = np.repeat(self.at[terms] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(np.repeat(group, size) * places + self.place[take], weights=self.value[take], minlength=groups * places).reshape(groups, places)


class ItemIndex:
    """Postings by term, with the highest impact of each term, of each block of its postings' items and of wider blocks; all as lists of what there is, so that the size is that of the postings. ``whole``: statistics of the benchmark that ``items`` are a slice of."""

    def __init__(self, items: list[tuple[int, str]], least: float, overlap: float, whole: Statistics | None = None):
        words = _hashes([t for _, t in items])
        whole = whole or Statistics.of(words)
        items, words = zip(*[(i, w) for i, w in zip(items, words) if len(w)]) if any(map(len, words)) else ((), ())
        self.ids, self.least, self.overlap = [i for i, _ in items], least, overlap
        #: Wide passages are twice this long and this far apart: any run of twice the longest item lies whole in one.
        self.stride = 2 * max(whole.longest, 1)
        self.lengths = [len(w) for w in words]
        self.questions = [trigrams(h) for h in _hashes([parts(t)[0] for _, t in items])] if items else []
        self.answers = [trigrams(h) for h in _hashes([parts(t)[1] for _, t in items])] if items else []
        self.terms = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        n, mean = len(items), whole.words / max(whole.items, 1)
        counts = [np.unique(np.searchsorted(self.terms, w), return_counts=True) for w in words]
        df = whole.df[np.searchsorted(whole.terms, self.terms)]
        idf = np.log1p((whole.items - df + 0.5) / (df + 0.5))
        impacts = [idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean)) for (at, tf), w in zip(counts, words)]
        # All in double precision: a bound is never below a score that it stands for.
        of = np.concatenate([at for at, _ in counts]) if counts else np.zeros(0, np.int64)
        item = np.repeat(np.arange(n), [len(x) for x in impacts])
        impact = np.concatenate([x / x.sum() for x in impacts]) if counts else np.zeros(0)
        #: For each item its distinct words, ascending, with their impacts.
        self.own = [(self.terms[at], x / x.sum()) for (at, _), x in zip(counts, impacts)]
        v, self.blocks = len(self.terms), max(1, -(-n // BLOCK))
        self.wides = -(-self.blocks // WIDE)
        self.items, self.block_max, self.wide_max = Lists(of, item, impact, v), Lists(of, item // BLOCK, impact, v), Lists(of, item // (BLOCK * WIDE), impact, v)
        self.highest = np.zeros(v)
        np.maximum.at(self.highest, of, impact)

    def postings(self, term: int) -> tuple[list[int], list[float]]:
        """A term's items and impacts."""
        return self.items.of(term)

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least ``least`` for a passage with these distinct terms."""
        least, found = self.least - SLACK, []
        lists = {t: self.items.of(t) for t in terms}
        bounds = {t: dict(zip(*self.block_max.of(t))) for t in terms}
        # A cursor: [item, term, place in postings].
        cursors = [[lists[t][0][0], t, 0] for t in terms]

        def to(cursor: list[int], item: int) -> bool:
            items = lists[cursor[1]][0]
            cursor[2] = bisect_left(items, item, cursor[2])
            if cursor[2] < len(items):
                cursor[0] = items[cursor[2]]
            return cursor[2] < len(items)

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += float(self.highest[t])
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(bounds[c[1]].get(block, 0.0) for c in cursors[: pivot + 1]) < least:
                # Nothing before the block's end, or before the next cursor, can reach the threshold.
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
            else:
                if cursors[0][0] == item:
                    score = sum(lists[c[1]][1][c[2]] for c in cursors[: pivot + 1])
                    if score >= least:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            cursors = [c for k, c in enumerate(cursors) if k > pivot or c[0] >= target or to(c, target)]
        return found

    def search(self, texts: pa.Array) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(row, item) to the best (score, question overlap, answer overlap), over all passages of all rows."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not len(self.terms):
            return best
        words = Words(*raw(pc.utf8_lower(texts)), SIGNS)
        hashes = words.hashes()
        if not len(hashes):
            return best
        term = np.searchsorted(self.terms, hashes)
        term[term == len(self.terms)] = 0
        known = np.flatnonzero(self.terms[term] == hashes)
        owner = words.owner()
        # Strides are numbered through all rows; a passage is a stride and the next one of the same row.
        strides = -(-np.diff(words.first) // self.stride)
        first_stride = np.concatenate([[0], np.cumsum(strides)])
        stride = first_stride[owner[known]] + (known - words.first[owner[known]]) // self.stride
        passage_row = np.repeat(np.arange(len(texts)), strides)
        follows = np.zeros(len(passage_row), bool)
        follows[1:] = passage_row[1:] == passage_row[:-1]
        two = follows[stride]
        v = len(self.terms)
        keys = np.unique(np.concatenate([stride * v + term[known], (stride[two] - 1) * v + term[known][two]]))
        if not len(keys):
            return best
        passage, of = keys // v, keys % v
        edge = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        edges = np.append(edge, len(keys))
        # WAND's test on the sum of bounds for all passages at once: of terms, then of wide blocks, then of the blocks in those that pass.
        hopeful = np.flatnonzero(np.add.reduceat(self.highest[of], edge) >= self.least - SLACK)
        for level, places in ((self.wide_max, self.wides), (self.block_max, self.blocks)):
            good = []
            step = max(1, AT_ONCE // places)
            for s in range(0, len(hopeful), step):
                some = hopeful[s : s + step]
                size = edges[some + 1] - edges[some]
                ends = np.cumsum(size)
                terms = of[np.repeat(edges[some] - (ends - size), size) + np.arange(ends[-1])]
                sums = level.sums(terms, np.repeat(np.arange(len(some)), size), len(some), places)
                good.append(some[(sums >= self.least - SLACK).any(1)])
            hopeful = np.concatenate(good) if good else hopeful
        for k in hopeful:
            found = self.wand(of[edges[k] : edges[k + 1]].tolist())
            if not found:
                continue
            p = int(passage[edges[k]])
            row = int(passage_row[p])
            start = int(words.first[row]) + (p - int(first_stride[row])) * self.stride
            held = hashes[start : min(start + 2 * self.stride, int(words.first[row + 1]))]
            place = start - int(words.first[row])
            last = start + len(held) == int(words.first[row + 1])
            for item, _ in found:
                for result in self._passages(item, held, place, last):
                    best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), result)
        return best

    def _passages(self, item: int, held: np.ndarray, place: int, last: bool) -> Iterator[tuple[float, float, float]]:
        """(score, question overlap, answer overlap) of the item's own passages in a stretch of words that begins at ``place`` in its document, ``last`` if it ends there."""
        terms, impacts = self.own[item]
        length = self.lengths[item]
        term = np.minimum(np.searchsorted(terms, held), len(terms) - 1)
        at = np.flatnonzero(terms[term] == held)
        # A word at w stands in the passages that begin at the multiple of the length below it, and at the one before.
        k = (place + at) // length
        pairs = np.unique(np.concatenate([k * len(terms) + term[at], (k - 1) * len(terms) + term[at]]))
        k, of = pairs // len(terms), pairs % len(terms)
        begin = k * length - place
        whole = (k >= 0) & (begin >= 0) & ((begin + 2 * length <= len(held)) | last)
        k, of = k[whole], of[whole]
        if not len(k):
            return
        low = int(k.min())
        shares = np.bincount(k - low, weights=impacts[of])
        for n in np.flatnonzero(shares >= self.least - SLACK):
            begin = int(n + low) * length - place
            own = held[begin : begin + 2 * length]
            grams = {g: np.unique(shingles(own, g)) for g in (1, 2, 3)}
            found = [max(float(np.isin(sought[item], grams[g]).mean()) for g in (1, 2, 3)) if len(sought[item]) else 1.0 for sought in (self.questions, self.answers)]
            if min(found) >= self.overlap:
                yield float(shares[n]), found[0], found[1]


def _slices(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in order of their ids, at most ``SLICE_BYTES`` of text at a time."""
    held, size = [], 0
    for r in benchmark.select(item, text).where(F.col(text).isNotNull()).orderBy(item, text).toLocalIterator():
        if held and size + len(r[1]) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    yield held


def indexes(benchmark: DataFrame, least: float, overlap: float, item: str = "item_id", text: str = "text") -> list[ItemIndex]:
    """An index for each slice of items. A benchmark of several slices is read twice: for its statistics, then slice by slice."""
    parts = _slices(benchmark, item, text)
    first, second = next(parts), next(parts, None)
    if second is None:
        return [ItemIndex(first, least, overlap)]
    whole = Statistics.of(_hashes([t for _, t in first])) + Statistics.of(_hashes([t for _, t in second]))
    del first, second
    for part in parts:
        whole += Statistics.of(_hashes([t for _, t in part]))
    return [ItemIndex(part, least, overlap, whole) for part in _slices(benchmark, item, text)]


def hits(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """A row for each document and item that it holds: score and overlaps of the best passage."""
    kind, item_kind = df.schema[key].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()

    def search(index: ItemIndex) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s, e in slices(b.column(1)):
                    found = index.search(b.column(1).slice(s, e - s))
                    at = sorted(found)
                    columns = [pa.array([index.ids[i] for _, i in at]), *(pa.array([found[k][j] for k in at], pa.float64()) for j in range(3))]
                    if at:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([s + r for r, _ in at])), *columns], [key, "item_id", "score", "question_overlap", "answer_overlap"])

        return df.select(key, text_of(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double")

    return reduce(DataFrame.unionByName, [search(i) for i in indexes(benchmark, least, overlap)])


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", least: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """The rows of ``df`` that hold no item; no shuffle, no join."""
    for index in indexes(benchmark, least, overlap):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(b.schema.get_field_index(text)).fill_null("")
                bad = {s + r for s, e in slices(texts) for r, _ in index.search(texts.slice(s, e - s))}
                yield b.take(pa.array([i for i in range(len(texts)) if i not in bad], pa.int64())) if bad else b
            trim()

        df = df.mapInArrow(run, df.schema)
    return df
