"""Document quality by hierarchical empirical Bayes.

A logistic classifier over byte and byte-class shares gives each document's own
evidence. Hosts and paths gather it: a host's posterior shrinks toward the global
mean, a path's toward its host's, by prior weights fitted from the spread between
groups (method of moments). Sparse sites so fall back to the global prior. The log
odds of a document's path against the global mean are added to the document's own;
for them the path and host are taken without the document, so that neither its
evidence nor its label counts twice.

The classifier is fitted on at most ``per_class`` labelled rows of each class,
those with the smallest hash of their id. All counts cover every row. Known labels
enter site counts instead of the classifier's word.

Null and empty texts get the classifier's answer for an empty text. Null hosts or
paths form one site of their own. Without labels, or with one class alone, the
evidence is 0.5 throughout. Repeated rows count as often as they occur. Repeated
labels of an id count as their mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fascicle.llm import linear
from fascicle.llm.common import cut, raw, slices, text_of

# Lower case, upper case, digits, blanks, line breaks, sentence signs, other signs, bytes of wider characters.
_KIND = np.full(256, 6, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[0x20, 0x09]] = 3
_KIND[[0x0A, 0x0D]] = 4
_KIND[[ord(c) for c in ".,;:?'\"-"]] = 5
_KIND[0x80:] = 7
FEATURES = 256 + 64


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of each byte and of each pair of neighbouring byte classes, a row for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kind = _KIND[data].astype(np.int64)
    pair = np.zeros(len(data), np.int64)
    pair[:-1] = kind[:-1] * 8 + kind[1:]
    pair[offsets[1:][size > 0] - 1] = kind[offsets[1:][size > 0] - 1] * 9
    counts = np.bincount(owner * FEATURES + data, minlength=n * FEATURES) + np.bincount(owner * FEATURES + 256 + pair, minlength=n * FEATURES)
    return np.sqrt(counts.reshape(n, FEATURES) / np.maximum(size, 1)[:, None]).astype(np.float32)


def sampled(df: DataFrame, labels: DataFrame, label: str, key: str, n: int, others: tuple[str, ...] = ()) -> DataFrame:
    """(text, __label, __draw, other labels) of labelled rows of ``df``, at most ``n`` ids of each class: those with the smallest hash, ``__draw``. They are chosen from the labels alone, so only 2 ``n`` ids travel and no text is shuffled."""
    known = labels.select(F.col(key), F.col(label).cast("double").alias("__label"), *(F.col(c).cast("double").alias(f"__{c}") for c in others)).where(f"{key} is not null and __label is not null")
    known = known.groupBy(key).agg(F.avg("__label").alias("__label"), *(F.avg(f"__{c}").alias(f"__{c}") for c in others))
    picks = [known.where(c).orderBy(F.xxhash64(key), key).limit(n) for c in ("__label >= 0.5", "__label < 0.5")]
    chosen = df.select(key, "text").where("text is not null").join(F.broadcast(picks[0].unionByName(picks[1])), key)
    return chosen.select("text", "__label", F.xxhash64(key).alias("__draw"), *(f"__{c}" for c in others))


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", per_class: int = 3000) -> np.ndarray:
    """Weights of the evidence classifier, the bias last."""
    rows = sampled(df, labels, label, key, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)
            for s, e in slices(texts):
                x = features(*raw(texts.slice(s, e - s)))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(s, e - s), pa.array(list(x), pa.list_(pa.float32()))], ["y", "x"])

    got = rows.mapInArrow(run, "y double, x array<float>").toArrow()
    y = np.where(got.column("y").to_numpy() >= 0.5, 1.0, -1.0)
    if len(set(y)) < 2:
        return np.zeros(FEATURES + 1)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), FEATURES)
    return linear.logistic(x, y, linear.balanced(y), l2=1e-5, steps=600)


def evidence(df: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``evidence``, the classifier's log odds from the whole text alone."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep))
            for s, e in slices(texts, 1 << 18):
                x = features(*raw(texts.slice(s, e - s)))
                yield pa.RecordBatch.from_arrays([*(c.slice(s, e - s) for c in b.columns[: len(keep)]), pa.array(x @ weights[:-1] + weights[-1], pa.float64())], [*keep, "evidence"])

    return df.select(*keep, text_of(text).alias("__text")).mapInArrow(run, f"{kinds}, evidence double")


def _prior_weight(groups: DataFrame, n: str, good: str, around: Column) -> float:
    """The weight of the prior in pseudo-rows, from how far group means spread beyond what their sizes explain."""
    mean = F.col(good) / F.col(n)
    got = groups.agg(
        F.sum(F.col(n) * F.pow(mean - around, 2)).alias("spread"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("n2"),
        F.count("*").alias("groups"), F.sum(F.col(n) * around * (1 - around)).alias("noise"),
    ).first()
    if not got["n"] or got["groups"] < 2:
        return 10.0
    noise = max(got["noise"] / got["n"], 1e-6)
    between = (got["spread"] - (got["groups"] - 1) * noise) / max(got["n"] - got["n2"] / got["n"], 1e-9)
    return float(np.clip(noise / max(between, 1e-6) - 1, 1.0, 1e6))


def score(df: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", label: str = "quality", site_share: float = 0.5, least: float = 0.3) -> DataFrame:
    """For each row: evidence, host, path and document posteriors of good quality, and ``keep`` where the last reaches ``least``."""
    weights = fit(df, labels, label, key)
    known = labels.select(F.col(key), F.col(label).cast("double").alias("known")).where(f"{key} is not null and known is not null").groupBy(key).agg(F.avg("known").alias("known"))
    base = df.select(F.col(key), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.col("text"))
    rows = cut(evidence(base, weights, [key, "host", "path"]).join(known, key, "left"))
    good = F.coalesce("known", 1 / (1 + F.exp(-F.greatest(F.least(F.col("evidence"), F.lit(30.0)), F.lit(-30.0)))))
    # Both levels aggregate on the map side first: a host with a third of all rows sends one row a task.
    paths = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    mean = float(np.clip(total["good"] / total["n"], 1e-4, 1 - 1e-4)) if total["n"] else 0.5
    a = _prior_weight(hosts, "host_n", "host_good", F.lit(mean))
    hosts = hosts.withColumn("p_host", (F.col("host_good") + a * mean) / (F.col("host_n") + a))
    sites = paths.join(hosts, "host")
    b = _prior_weight(sites, "n", "good", F.col("p_host"))
    sites = sites.withColumn("p_path", (F.col("good") + b * F.col("p_host")) / (F.col("n") + b))
    bound = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    odds = lambda p: F.log(bound(p) / (1 - bound(p)))
    others_host = (F.col("host_good") - good + a * mean) / (F.col("host_n") - 1 + a)
    others_path = (F.col("good") - good + b * others_host) / (F.col("n") - 1 + b)
    logit = F.col("evidence") + site_share * (odds(others_path) - F.lit(float(np.log(mean / (1 - mean)))))
    joined = rows.join(sites, ["host", "path"]).withColumn("p_quality", 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0)))))
    return joined.select(key, "host", "path", "evidence", "p_host", "p_path", "p_quality", (F.col("p_quality") >= least).alias("keep"))
