"""References between entries: which files a packfile names, and where, as edges that join to the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.classify import reference_kind
from ..functions.media import explode_blobs
from ..functions.packfile import parse_packfile

EDGE = "ord int, fourcc string, path string, file_id long"
#: Ids outside this range in content stores aren't files.
LEAST, MOST = 40_000, 0xFFFFFF


def edges_of(data: bytes, registry: dict) -> list[tuple]:
    """Every file that a packfile's fields name, with the field's path, in the order of the fields."""
    if data[:2] != b"PF" or len(data) < 12:
        return []
    rows = parse_packfile(data, registry)
    paths, out = {}, []
    for node, parent, depth, _, name, kind, _, _, value in rows:
        # a chunk's own struct has the schema's name, which says nothing about the place
        up, box = paths.get(parent, ("", ""))
        box = name.split(" ")[0] if kind == "chunk" else box
        paths[node] = ("" if depth < 3 else f"{up}.{name}" if up else name, box)
        if kind == "filename" and value.startswith("fileId=") and not value.startswith("fileId=0 "):
            out.append((len(out), box, paths[node][0], int(value.split(" ")[0][7:])))
    return out


def edges(blobs: DataFrame, registry: dict) -> DataFrame:
    """(base_id, ord, fourcc, path, file_id) of all packfiles among the blobs."""
    return explode_blobs(blobs, lambda d: edges_of(d, registry), EDGE)


def resolve(found: DataFrame, file_ids: DataFrame) -> DataFrame:
    """edges with the base id that each leads to; -1 where the catalog has none."""
    to = file_ids.select("file_id", F.col("base_id").alias("to_base"))
    return found.join(to, "file_id", "left").withColumn("to_base", F.coalesce("to_base", F.lit(-1)))


def asset_list(found: DataFrame, most: int = 512) -> DataFrame:
    """Of each entry the files in range, each once, in the order first named, at most so many."""
    first = found.where((F.col("file_id") > LEAST) & (F.col("file_id") < MOST)).groupBy("base_id", "file_id").agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("base_id").orderBy("ord"))
    return first.withColumn("place", rank).where(F.col("place") <= most).drop("ord")


def classified(assets: DataFrame, blobs: DataFrame) -> DataFrame:
    """assets (with to_base) and what each leads to; each target is read and judged once, however many name it."""
    wanted = assets.where("to_base >= 0").select(F.col("to_base").alias("base_id")).distinct()
    kinds = explode_blobs(blobs.join(wanted, "base_id", "left_semi"), lambda d: [(reference_kind(d),)], "kind string")
    return assets.join(kinds.withColumnRenamed("base_id", "to_base"), "to_base", "left").withColumn("kind", F.coalesce("kind", F.lit("")))
