"""Toxicity by a chain of linear classifiers.

Categories are columns of labels and are predicted one after another. Each link is a
logistic model over the presence of telling words and word stems, and over the
probabilities of the links before it; while fitting, those come from models that did
not see the row (out of fold; folds go by the hash of the id, so that they do not
depend on how the input lies). The telling features are chosen by their lift in the
training rows, inside each fold anew.

Fitting takes at most ``per_class`` labelled rows of each class of the first category,
those with the smallest hash of their id; a later link takes those of them that have
its label. Scoring covers every row and every word.

Where labels have no column of a category the chain is without it.
Null and empty texts have no telling word and score as such. Without labels or
with one class alone every probability is 0. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fascicle.llm import linear
from fascicle.llm.bytescan import SIGNS, Words
from fascicle.llm.common import raw, slices, text_of
from fascicle.llm.quality import sampled

BITS = 20
STEMS = (4, 5)
#: The chain's categories, each with its label column and the label that stands for it. Labels that there are none of are left out.
CATEGORIES = {"toxic": ("toxic", 1), "poor": ("quality", 0)}


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of each word and of its stems."""
    w = Words(data, offsets, SIGNS)
    kinds = [w.hashes(), *(w.stems(n) + np.uint64(n) for n in STEMS)]
    return np.tile(w.owner(), len(kinds)), np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in kinds])


@dataclass(frozen=True)
class Link:
    features: np.ndarray
    weights: np.ndarray

    def logits(self, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return np.hstack([x, earlier]) @ self.weights[:-1] + self.weights[-1]


def _telling(rows: list[np.ndarray], y: np.ndarray, most: int = 400) -> np.ndarray:
    """Buckets that occur in many more positive rows than chance has it, the strongest first."""
    pos, neg = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for r, v in zip(rows, y):
        (pos if v > 0 else neg)[r] += 1
    n1, n0 = max(1, (y > 0).sum()), max(1, (y < 0).sum())
    lift = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    gain = np.where((pos >= max(3, n1 // 200)) & (lift > np.log(3)), (pos / n1 - neg / n0) * lift, 0)
    best = np.argsort(-gain, kind="stable")[:most]
    return best[gain[best] > 0]


def _present(rows: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    slot = np.full(1 << BITS, -1, np.int32)
    slot[features] = np.arange(len(features))
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, r in enumerate(rows):
        at = slot[r]
        x[i, at[at >= 0]] = 1
    return x


def _link(rows, y, earlier, l2=1e-4) -> Link:
    features = _telling(rows, y)
    x = np.hstack([_present(rows, features), earlier]).astype(np.float32)
    return Link(features, linear.logistic(x, y, linear.balanced(y), l2, 200))


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    links: tuple[Link, ...]

    def slots(self) -> np.ndarray:
        """For each bucket its column in the union of all links' features, or -1."""
        slot = np.full(1 << BITS, -1, np.int32)
        for i, f in enumerate(np.unique(np.concatenate([x.features for x in self.links] or [np.zeros(0, np.int64)]))):
            slot[f] = i
        return slot

    def score(self, x: np.ndarray, slot: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.categories)))
        for k, link in enumerate(self.links):
            own = x[:, slot[link.features]]
            out[:, k] = linear.sigmoid(link.logits(own, out[:, :k]))
        return out


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", per_class: int = 2000, folds: int = 5, categories: dict[str, tuple[str, int]] = CATEGORIES) -> Chain:
    """A chain over ``categories``, in their order. A category with one class alone ends it."""
    names = [c for c, (column, _) in categories.items() if column in labels.columns]
    columns = [categories[c][0] for c in names]
    if not columns:
        return Chain((), ())
    rows = sampled(df, labels, columns[0], key, per_class, tuple(columns[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)
            for s, e in slices(texts):
                owner, bucket = buckets(*raw(pc.utf8_lower(texts.slice(s, e - s))))
                sets, sizes = [], np.bincount(owner, minlength=e - s)
                kept = [b.column(i).slice(s, e - s) for i in range(1, b.num_columns)]
                order = np.argsort(owner, kind="stable")
                for part in np.split(bucket[order], np.cumsum(sizes)[:-1]):
                    sets.append(np.unique(part).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32())), *kept], ["at", *b.schema.names[1:]])

    got = rows.mapInArrow(run, ", ".join(["at array<int>, __label double, __draw long", *(f"__{c} double" for c in columns[1:])])).toArrow()
    # The order in which rows arrive is none of the model's business.
    draw = got.column("__draw").to_numpy()
    sets = [np.asarray(x.values) for x in got.column("at")]
    order = np.lexsort(([x.tobytes() for x in sets], draw)) if len(sets) else []
    sets, fold = [sets[i] for i in order], draw[order] % folds
    earlier, links = np.zeros((len(sets), 0), np.float32), []
    for name, column in zip(names, ["__label", *(f"__{c}" for c in columns[1:])]):
        label = got.column(column).to_numpy(zero_copy_only=False).astype(float)[order]
        here = ~np.isnan(label)
        t = np.where((label >= 0.5) == (categories[name][1] == 1), 1.0, -1.0)
        if len(set(t[here])) < 2:
            break
        some = lambda rows: [sets[i] for i in rows]
        known = np.flatnonzero(here)
        links.append(_link(some(known), t[known], earlier[known]))
        unseen = np.zeros(len(t), np.float32)
        for f in range(folds):
            train, test = np.flatnonzero(here & (fold != f)), np.flatnonzero(fold == f)
            if len(set(t[train])) < 2 or not len(test):
                continue
            part = _link(some(train), t[train], earlier[train])
            unseen[test] = linear.sigmoid(part.logits(_present(some(test), part.features), earlier[test]))
        earlier = np.hstack([earlier, unseen[:, None]])
    return Chain(tuple(names), tuple(links))


def score(df: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text", least: float = 0.6) -> DataFrame:
    """``key``, a probability for each category, and ``is_toxic`` where that of ``toxic`` reaches ``least``; null if the chain has no such category."""
    toxic = chain.categories.index("toxic") if "toxic" in chain.categories else None
    names = [f"p_{c}" for c in chain.categories]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = chain.slots()
        width = int(slot.max(initial=-1)) + 1
        for b in batches:
            texts = b.column(1)
            for s, e in slices(texts, 1 << 19):
                x = np.zeros((e - s, width), np.float32)
                owner, bucket = buckets(*raw(pc.utf8_lower(texts.slice(s, e - s))))
                at = slot[bucket]
                x[owner[at >= 0], at[at >= 0]] = 1
                p = chain.score(x, slot)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), *(pa.array(p[:, k]) for k in range(len(names))), pa.nulls(e - s, pa.bool_()) if toxic is None else pa.array(p[:, toxic] >= least)], [key, *names, "is_toxic"])

    return df.select(key, text_of(text).alias("__text")).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{n} double" for n in names), "is_toxic boolean"]))
