"""An extension: blobs that are dropped in a folder, catalogued as they come.

The batch index has no streaming counterpart of its own; this wraps its classifier and chunk walk in a Structured
Streaming job that takes what is new and stops (availableNow), with exactly-once files and a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import index_type
from ..functions.columns import fourcc
from ..functions.media import explode_blobs
from ..functions.packfile import chunks


def dropped(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, data) of the files in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.schema(schema).format("binaryFile").load(folder).select("path", F.col("content").alias("data"))


def described(blobs: DataFrame) -> DataFrame:
    """(path, magic, type, container, size); expressions only."""
    kind = index_type(F.col("data"))
    box = F.when((kind == "packfile") & (F.octet_length("data") >= 12), fourcc(F.col("data"), 8)).otherwise("")
    return blobs.select("path", fourcc(F.col("data")).alias("magic"), kind.alias("type"), box.alias("container"), F.octet_length("data").cast("long").alias("size"))


def chunk_rows(blobs: DataFrame) -> DataFrame:
    """(path, seq, fourcc, version, size) of the packfiles among the blobs."""
    rows = lambda d: [(k, name, v, size) for k, (_, name, v, size, _) in enumerate(chunks(d))] if d[:2] == b"PF" else []
    return explode_blobs(blobs, rows, "seq int, fourcc string, version int, size long", key="path")


def catalogue(spark: SparkSession, folder: str, out: str, checkpoint: str) -> int:
    """Appends what is new in the folder to out/entries; how many rows there are then."""
    q = described(dropped(spark, folder)).writeStream.format("parquet").option("path", f"{out}/entries").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/entries").count()
