"""Hierarchical language identification.

Byte trigrams of the lower-cased text, hashed to a fixed number of buckets and
scaled to sum 1, are the features. Linear support vector machines first separate
language families, one against one; within the family that wins, one-versus-one
machines separate its languages. Only the text decides; the language column is
read for training rows alone.

Training takes at most ``per_language`` rows of each language, those with the
smallest hash of their id: a bounded sample, the same on every run. Prediction
covers every row and every byte.

The machines only say which learned language is nearest. Whether a text is in any
of them is told by its evidence: how many bits its trigrams gain, on average, from a
language's trigram shares over equal shares of all buckets, in units of what rows of
that language usually gain from shares that they took no part in; the most over the
languages. 1 is usual; texts in a language or script that was not learned, and letter
junk, are near 0 or below.
Trigrams with fewer than two letters tell nothing.

A null text, an empty one and one without any letter give ``und`` with score 0.
Without any training row every prediction is ``und``. With one language learned it
is always predicted. Repeated rows give repeated results; null keys are kept and
count as held out from training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fascicle.llm import linear
from fascicle.llm.common import crc32_of_id, raw, slices, text_of, trim

BUCKETS = 1 << 13
#: Share of each bucket's usual probability that stands for trigrams not seen in training.
UNSEEN = 0.05

# The families of the languages that a corpus is likely to name.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk pl cs sk bg sr hr sl mk be bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indic": "hi bn mr ur pa gu ne".split(),
    "semitic": "ar he mt am".split(),
}


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"only-{lang}")


_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte; ``BUCKETS`` where it would leave its text."""
    b = _FOLD[data].astype(np.uint32)
    h = b * np.uint32(0x9E3779B1)
    h[:-1] += b[1:] * np.uint32(0x85EBCA6B)
    h[:-2] += b[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    out = ((h * np.uint32(0x27D4EB2F)) >> np.uint32(19)).astype(np.int64)
    starts, ends = offsets[:-1], offsets[1:]
    for back in (1, 2):
        out[ends[ends - back >= starts] - back] = BUCKETS
    return out


def _telling() -> np.ndarray:
    """Whether a bucket's trigrams have two letters at least; false for the last entry."""
    letters = np.flatnonzero(_FOLD != 0x20).astype(np.uint8)
    blank = np.uint8(0x20)
    few = [np.array([blank] * 3, np.uint8), *(np.array(g, np.uint8) for x in letters for g in ((x, blank, blank), (blank, x, blank), (blank, blank, x)))]
    grams = trigrams(np.concatenate(few), np.arange(0, 3 * len(few) + 1, 3))[::3]
    out = np.ones(BUCKETS + 1, bool)
    out[grams] = out[BUCKETS] = False
    return out


def counted(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and shares of each text."""
    grams = trigrams(data, offsets)
    out = []
    for s, e in zip(offsets[:-1], offsets[1:]):
        n = np.bincount(grams[s:e], minlength=BUCKETS + 1)[:BUCKETS]
        at = np.flatnonzero(n)
        out.append((at.astype(np.int32), (n[at] / max(1, n.sum())).astype(np.float32)))
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    plain = (_FOLD[data] != 0x20) & (data < 0x80)
    some = np.concatenate([[0], np.cumsum(plain)])
    out = some[offsets[1:]] > some[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    return out


@dataclass(frozen=True)
class LangModel:
    """``pairs``: (a, b) of each machine, families first; positive margins say a. ``weights``: a column for each, the last row of zeros.

    ``familiar``: the evidence of a bucket for each language, 0 where it tells nothing.
    """

    languages: tuple[str, ...]
    family_pairs: tuple[tuple[str, str], ...]
    language_pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray
    bias: np.ndarray
    familiar: np.ndarray
    telling: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        families = sorted({family(x) for x in self.languages})
        chance = linear.sigmoid(3 * margins)
        k = len(self.family_pairs)
        won = _coupled(families, self.family_pairs, chance[:, :k])
        best, out, score = won.argmax(1), np.empty(len(margins), object), np.zeros(len(margins))
        for i, f in enumerate(families):
            rows = np.flatnonzero(best == i)
            members = [x for x in self.languages if family(x) == f]
            own = [j for j, p in enumerate(self.language_pairs) if family(p[0]) == f]
            inside = _coupled(members, [self.language_pairs[j] for j in own], chance[rows][:, [k + j for j in own]])
            out[rows] = np.array(members, object)[inside.argmax(1)]
            score[rows] = won[rows, i] * inside.max(1)
        return out.tolist(), score


def _coupled(names, pairs, chance: np.ndarray) -> np.ndarray:
    """The mean chance of each name over the machines that it takes part in, scaled to sum 1."""
    out = np.ones((len(chance), len(names))) if len(names) == 1 else np.zeros((len(chance), len(names)))
    for j, (a, b) in enumerate(pairs):
        out[:, names.index(a)] += chance[:, j]
        out[:, names.index(b)] += 1 - chance[:, j]
    return out / np.maximum(out.sum(1, keepdims=True), 1e-12)


def _bits(x: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Bits that each telling bucket gains from the mean shares of the rows ``x`` over equal shares."""
    share = x.mean(0, dtype=np.float64) * telling if len(x) else np.zeros(len(telling))
    return np.log2((share / max(share.sum(), 1e-12) * telling.sum() + UNSEEN) / (1 + UNSEEN)) * telling


def _familiar(x: np.ndarray, langs: np.ndarray, languages: tuple[str, ...], telling: np.ndarray) -> np.ndarray:
    """Each language's bits a bucket, in units of the median that its rows gain from the half of its rows that they are not in."""
    inside, out = telling[:BUCKETS], np.zeros((BUCKETS + 1, len(languages)), np.float32)
    for j, name in enumerate(languages):
        own = x[langs == name]
        held = [h @ _bits(rest, inside) / np.maximum(h @ inside, 1e-12) for h, rest in ((own[::2], own[1::2]), (own[1::2], own[::2]))]
        # One bit at least: where rows are too few to tell what is usual, all of them are in training.
        out[:BUCKETS, j] = _bits(own, inside) / max(1.0, float(np.median(np.concatenate(held))))
    return out


def fit(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400) -> LangModel:
    """Fit on the rows where ``train`` holds and text and language are there; at most ``per_language`` rows of each language."""
    known = df.where(train).select(F.col(key).alias("id"), F.col(lang).alias("lang")).where("lang is not null and id is not null").withColumn("draw", F.xxhash64("id"))
    # Chosen by id alone, in parts of a language first: no text is shuffled, and a language of most rows lands in no one task.
    for group in (["lang", F.pmod("draw", F.lit(16))], ["lang"]):
        known = known.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("draw", "id"))).where(F.col("nth") <= per_language)
    # ``per_language`` ids for each language that is named.
    # An id may have several rows: each is learned from under its own language only.
    rows = df.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("text is not null and lang is not null")
    sample = rows.join(F.broadcast(known.select("id", "lang").distinct()), ["id", "lang"]).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)
            for s, e in slices(texts):
                rows = counted(*raw(texts.slice(s, e - s)))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(s, e - s), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["lang", "at", "share"])

    rows = sample.mapInArrow(run, "lang string, at array<int>, share array<float>").toArrow()
    langs = np.array(rows.column("lang").to_pylist(), object)
    x = np.zeros((len(langs), BUCKETS), np.float32)
    done = 0
    for part in rows.to_batches():
        at, share = part.column("at"), part.column("share")
        x[done + np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = share.flatten().to_numpy()
        done += part.num_rows
    del rows
    languages, telling = tuple(sorted(set(langs.tolist()))), _telling()
    familiar = _familiar(x, langs, languages, telling)
    # Rare trigrams count for more: each bucket is scaled by the root of its usual share.
    scale = np.sqrt(np.maximum(x.mean(0), 1e-5)) if len(x) else np.ones(BUCKETS)
    families = sorted({family(x) for x in languages})
    kin = np.array([family(x) for x in langs], object)
    family_pairs = tuple(combinations(families, 2))
    language_pairs = tuple((a, b) for a, b in combinations(languages, 2) if family(a) == family(b))
    columns, bias = [], []
    x /= scale.astype(np.float32)
    for of, pairs in ((kin, family_pairs), (langs, language_pairs)):
        for a, b in pairs:
            rows_ab = (of == a) | (of == b)
            y = np.where(of[rows_ab] == a, 1.0, -1.0)
            w = linear.squared_hinge(x[rows_ab], y, linear.balanced(y), l2=1e-4, steps=120)
            columns.append(w[:-1] / scale)
            bias.append(w[-1])
    weights = np.zeros((BUCKETS + 1, len(columns)), np.float32)
    if columns:
        weights[:-1] = np.stack(columns, 1)
    del x
    trim()
    return LangModel(languages, family_pairs, language_pairs, weights, np.array(bias), familiar, telling)


def predict(df: DataFrame, model: LangModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep`` columns of every row with ``lang_pred``, ``score`` and ``evidence``, their names after ``prefix``."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep))
            for s, e in slices(texts):
                part = texts.slice(s, e - s)
                data, offsets = raw(part)
                size = np.maximum(1, np.diff(offsets) - 2)
                margins, evidence = np.zeros((e - s, len(model.bias))), np.zeros(e - s)
                if len(data):
                    grams, full = trigrams(data, offsets), np.flatnonzero(np.diff(offsets))
                    for j in range(len(model.bias)):
                        margins[full, j] = np.add.reduceat(model.weights[grams, j], offsets[full], dtype=np.float64)
                margins = margins / size[:, None] + model.bias
                letters = has_letter(data, offsets, part) & (len(model.languages) > 0)
                pred, score = model.predict(margins) if model.languages else ([None] * (e - s), np.zeros(e - s))
                if len(data) and model.languages:
                    gained = np.max([np.add.reduceat(f[grams], offsets[full], dtype=np.float64) for f in model.familiar.T], 0)
                    evidence[full] = gained / np.maximum(np.add.reduceat(model.telling[grams], offsets[full], dtype=np.float64), 1)
                pred = [p if ok else "und" for p, ok in zip(pred, letters)]
                yield pa.RecordBatch.from_arrays([*(c.slice(s, e - s) for c in b.columns[: len(keep)]), pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64()), pa.array(np.where(letters, evidence, 0.0), pa.float64())], [*keep, *(prefix + c for c in ("lang_pred", "score", "evidence"))])
        trim()

    return df.select(*(F.col(f"`{c}`") for c in keep), text_of(text).alias("__text")).mapInArrow(run, f"{kinds}, {prefix}lang_pred string, {prefix}score double, {prefix}evidence double")


def identify(df: DataFrame, key: str = "doc_id", folds: int = 5) -> DataFrame:
    """Predict every row with a model that never saw the rows whose crc32 of the id leaves no remainder by ``folds``."""
    fold = F.pmod(crc32_of_id(key), F.lit(folds))
    model = fit(df, fold != 0, key)
    return predict(df, model, keep=(key,)).select(key, (F.coalesce(fold, F.lit(0)) == 0).alias("held_out"), "lang_pred", "score")


def accept(df: DataFrame, key: str = "doc_id", least: float = 0.2, evidence: float = 0.25) -> DataFrame:
    """Rows of ``df`` in a learned language: with that much evidence for one, and a score of at least ``least``; the language column is left as it was.

    The score alone can't fail while few languages are learned: the best of k is at least 1/k.
    """
    columns = df.columns
    model = fit(df, F.lit(True), key)
    # The input's own columns may have any name.
    told = (F.col("__own_lang_pred") != "und") & (F.col("__own_score") >= least) & (F.col("__own_evidence") >= evidence)
    return predict(df, model, keep=tuple(columns), prefix="__own_").where(told).select([F.col(f"`{c}`") for c in columns])
