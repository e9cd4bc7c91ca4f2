"""Tables that end a lineage, and positions over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Shuffle files go when a table is written, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local one if driver and executors are one machine; otherwise there is none that all see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fascicle-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``by`` if given, and read it back. :func:`discard` deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    usual = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if usual is None else spark.conf.set(_CLEANUP, usual)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete tables of :func:`materialise` once what came from them is written."""
    for df in frames:
        path = getattr(df, "table_path", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def with_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """``df`` with its 0-based position by ``order``."""
    return ranked(df, *order, name=name)[0]


def ranked(df: DataFrame, *order: str, name: str = "rank") -> tuple[DataFrame, int]:
    """``df`` with its 0-based position by ``order``, and how many rows it has. Parts are sorted side by side; the driver sees one count for each part."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    counts = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for part, n in counts:
        rows.append((part, before))
        before += n
    base = spark.createDataFrame(rows, "__part int, __base long")
    out = placed.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")
    out.table_path = placed.table_path
    return out, before
