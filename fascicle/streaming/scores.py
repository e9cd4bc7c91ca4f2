"""Scores of latents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fascicle.operators.scoring import score
from fascicle.schema import LATENT


def latent_stream(spark, folder: str) -> DataFrame:
    """New Parquet files of latents in a folder."""
    return spark.readStream.schema(LATENT).parquet(folder)


def score_stream(latents: DataFrame, centres: DataFrame, scaler: float = 1.0, key: str = "sid") -> DataFrame:
    """Scoring keeps no state: the batch operator applies to a stream as it is, with the centres fixed at the start."""
    return score(latents, centres, scaler, key)


def start(scores: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = scores.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
