"""Sinks: decoded bytes, images, meshes, text tables and manifests, each written by the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.media import decode_blocks, png


def write_files(blobs: DataFrame, folder: str, name: str = "base_id", data: str = "data", suffix: str = ".bin") -> DataFrame:
    """Writes each blob to a file of its own in a folder that all executors share; (name, path, bytes) of each. A file is
    written aside and renamed, so a repeated task leaves no half file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, f"{k}{suffix}")
                temp = f"{path}.{uuid.uuid4().hex}"
                with open(temp, "wb") as f:
                    f.write(d)
                os.replace(temp, path)
                rows.append((str(k), path, len(d)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["name", "path", "bytes"])

    return blobs.where(F.col(data).isNotNull()).select(name, data).mapInArrow(run, "name string, path string, bytes long")


def images(surfaces: DataFrame) -> DataFrame:
    """(base_id, png) of surfaces (base_id, format, width, height, surface)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [png(decode_blocks(f, s, w, h)) for f, w, h, s in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["base_id", "png"])

    return surfaces.select("base_id", "format", "width", "height", "surface").mapInArrow(run, "base_id long, png binary")


def obj_lines(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(line, text): a mesh as OBJ text. vertices (vertex, x, y, z) from 0, triangles (triangle, a, b, c)."""
    v = vertices.select(F.lit(0).alias("part"), F.col("vertex").alias("line"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("text"))
    f = triangles.select(F.lit(1).alias("part"), F.col("triangle").alias("line"), F.format_string("f %d %d %d", F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("text"))
    return v.unionAll(f).orderBy("part", "line").select("line", "text")


def write_texts(texts: DataFrame, path: str) -> None:
    """(text_id, text) as quoted CSV with a header, in the ids' order."""
    texts.orderBy("text_id").write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_manifest(shaders: DataFrame, path: str) -> None:
    shaders.write.mode("overwrite").json(path)
