"""Scene tables of packfiles, and the joins between them. A table's rows carry base_id, the entry that they are from."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.media import explode_blobs
from ..functions.scenes import REGION, TABLES, region_rows


def scene_table(blobs: DataFrame, registry: dict, name: str) -> DataFrame:
    """One of TABLES for all packfiles among the blobs (base_id, data)."""
    rows_of, schema = TABLES[name]
    return explode_blobs(blobs, partial(rows_of, registry=registry), schema)


def shader_regions(blobs: DataFrame, material_end: int, compute_start: int) -> DataFrame:
    """Shader blobs in executables, by region; group by region, stage or role to count them."""
    return explode_blobs(blobs, partial(region_rows, material_end=material_end, compute_start=compute_start), REGION)


def _at(column: str, token: str) -> Column:
    return F.struct(F.col(column).alias("at"), F.col(token).alias("v"))


def placed_zones(zones: DataFrame, definitions: DataFrame) -> DataFrame:
    """Zones with their definition's file. Of definitions with one token the last counts; zones without one, and files of id 0, go."""
    last = definitions.where("token <> 0").groupBy("base_id", "token").agg(F.max(_at("ord", "file_id")).alias("d")).select("base_id", "token", F.col("d.v").alias("file_id"))
    return zones.join(last.where("file_id <> 0"), ["base_id", "token"]).select("base_id", "ord", "file_id", "position")


def unique_models(props: DataFrame, most: int = 600) -> DataFrame:
    """(base_id, file_id, place, uses): the models that a map places, in the order of first use. `most` is the feature's limit of
    models that are loaded for a map; placements of the others stay in props."""
    used = props.groupBy("base_id", "file_id").agg(F.min("ord").alias("first"), F.count("*").alias("uses"))
    place = F.row_number().over(Window.partitionBy("base_id").orderBy("first"))
    return used.withColumn("place", place).where(F.col("place") <= most).select("base_id", "file_id", "place", "uses")


def placements(props: DataFrame, models: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Props of loaded models, with the entry that holds each model; ids that the catalog lacks go."""
    where = models.join(file_ids.select("file_id", F.col("base_id").alias("model_base")), "file_id")
    return props.join(where, ["base_id", "file_id"])


def bound_textures(samplers: DataFrame, textures: DataFrame, materials: DataFrame) -> DataFrame:
    """(base_id, material, slot, file_id): textures that each material's shader samples. samplers: of shader lists, with the
    list's file_id; textures and materials: of models. A texture index beyond the material's list gives a null."""
    wanted = materials.select("base_id", "material", "file_id").join(samplers.select("file_id", "shader", "slot", "texture_index"), "file_id").drop("file_id")
    mine = textures.select("base_id", "material", F.col("slot").cast("long").alias("texture_index"), "file_id")
    return wanted.join(mine, ["base_id", "material", "texture_index"], "left")


def picked_effects(effects: DataFrame, shaders: DataFrame, samplers: DataFrame) -> DataFrame:
    """(base_id, transparent, pixel, vertex, state): of each shader list the opaque and the transparent effect whose pixel shader
    samples most, the first of equals. Only effects with both shaders, and a sampler at slot 0, count. Without an opaque one
    the transparent one is both."""
    seen = samplers.groupBy("base_id", "shader").agg(F.count("*").alias("n"), F.bool_or(F.col("slot") == 0).alias("colour")).where("colour")
    pixel = shaders.select("base_id", "shader").join(seen, ["base_id", "shader"]).withColumnRenamed("shader", "pixel")
    best = (
        effects.where("vertex >= 0")
        .join(pixel, ["base_id", "pixel"])
        .groupBy("base_id", "transparent")
        .agg(F.max(F.struct("n", (-F.col("ord")).alias("first"), "pixel", "vertex", "state")).alias("e"))
        .groupBy("base_id")
        .agg(F.max(F.when(~F.col("transparent"), F.col("e"))).alias("opaque"), F.max(F.when(F.col("transparent"), F.col("e"))).alias("clear"))
    )
    families = F.array(F.struct(F.lit(False).alias("transparent"), F.coalesce("opaque", "clear").alias("e")), F.struct(F.lit(True).alias("transparent"), F.col("clear").alias("e")))
    flat = best.select("base_id", F.explode(families).alias("f")).where("f.e IS NOT NULL")
    return flat.select("base_id", "f.transparent", "f.e.pixel", "f.e.vertex", "f.e.state")


def bone_curves(bones: DataFrame, curves: DataFrame) -> DataFrame:
    """Each bone (base_id, bone, name) with the curves of its name in each clip of `curves` (clip_base as the clips' entry); of
    tracks with one name the last counts, and a bone without a track keeps nulls."""
    one = Window.partitionBy("clip_base", "clip", "name", "slot").orderBy(F.desc("track"))
    last = curves.withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth", "track")
    return bones.join(last, "name", "left")
