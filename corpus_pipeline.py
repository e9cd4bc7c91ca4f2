"""A corpus from raw documents to token counts, stage by stage.

Each stage works on all rows that the one before it kept; its result is written as
Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm import bpe, decontam, jaccard, langid, repeats
from fascicle.llm.common import cut, cuts, documents, release, small_batches, table
from fascicle.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the others go."""
    return langid.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    return jaccard.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stood in an earlier one, or earlier in the same."""
    out = repeats.trimmed(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's count of tokens, with digests of its ids and of what they decode to."""
    return bpe.digests(docs, vocabulary())


def _alone(stage: Stage) -> Stage:
    """A stage begins when the one before it is written, so that one's working tables can go."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        release(spark, _working)
        before = set(cuts())
        out = stage(spark, docs, sf_dir)
        _working[:] = [p for p in cuts() if p not in before]
        return out

    run.__doc__ = stage.__doc__
    return run


_working: list[str] = []

STAGES: list[tuple[str, Stage]] = [
    ("language_id", _alone(language)),
    ("jaccard_join", _alone(near_duplicates)),
    ("suffix_array_dedup", _alone(repeated_passages)),
    ("decontamination", _alone(decontamination)),
    ("bpe", _alone(tokens)),
]

#: No stage but the last could be said in SQL; the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = documents(spark, sf_dir), []
    for _, stage in STAGES:
        out = cut(stage(spark, docs, sf_dir))
        release(spark, written)
        docs, written = out, [cuts()[-1]]
    return docs
