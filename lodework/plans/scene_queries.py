"""Queries over a small archive of scenes of our own making, each beside the rows that its contents call for."""

from __future__ import annotations

import struct
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scenes
from ..operators.api import Archive
from . import archive_queries
from .archive_queries import _packfile, _stored


class Block:
    """Bytes with pointers to other bytes, which follow them; pointers count from their own place, so blocks nest."""

    def __init__(self, *fields: bytes | tuple):
        self.out, self.later = bytearray(), []
        for f in fields:
            if isinstance(f, tuple):  # (count or None, bytes): an array's count and pointer, or a pointer alone
                count, target = f
                self.out += b"" if count is None else struct.pack("<I", count)
                self.later.append((len(self.out), bytes(target)))
                self.out += bytes(8)
            else:
                self.out += f

    def __bytes__(self) -> bytes:
        out = bytearray(self.out)
        for at, target in self.later:
            if target:
                struct.pack_into("<Q", out, at, len(out) - at)
                out += target
        return bytes(out)


def d(*v: int) -> bytes:
    return struct.pack(f"<{len(v)}I", *v)


def f(*v: float) -> bytes:
    return struct.pack(f"<{len(v)}f", *v)


def q(*v: int) -> bytes:
    return struct.pack(f"<{len(v)}Q", *v)


def name(ident: int) -> tuple:
    """A reference to a file; 0 is none."""
    high, low = divmod(ident - 1, 0xFF00)
    return None, struct.pack("<4H", 0x100 + low, 0x100 + high, 0, 0) if ident else b""


def array(*structs: Block) -> tuple:
    """An array of structs whose pointers lead behind the whole array."""
    whole = Block()
    for s in structs:
        whole.later += [(len(whole.out) + at, target) for at, target in s.later]
        whole.out += s.out
    return len(structs), whole


def pointers(*structs: Block) -> tuple:
    return len(structs), Block(*[(None, s) for s in structs])


def _fields(text: str) -> dict:
    """'name kind, ...'; kind is a scalar's, or [T] an array, *T a pointer, [*T] an array of pointers, T a struct; T begins in upper
    case where it is a struct."""
    out = []
    for part in text.split(", "):
        label, kind = part.split(" ")
        target = {"struct": kind.strip("[*]")} if kind.strip("[*]")[0].isupper() else kind.strip("[*]")
        if kind.startswith("[*"):
            out.append({"name": label, "kind": "ptr_array_ptr", "element": target})
        elif kind.startswith("["):
            out.append({"name": label, "kind": "array_ptr", "element": target})
        elif kind.startswith("*"):
            out.append({"name": label, "kind": "ptr", "target": target})
        else:
            out.append({"name": label, "kind": "struct", "type": kind} if isinstance(target, dict) else {"name": label, "kind": kind})
    return {"fields": out}


REGISTRY = {
    "chunks": {c: {"1": t} for c, t in {"GEOM": "Geom", "MODL": "Model", "BGFX": "Shading", "prp2": "Props", "zon2": "Zones", "trn": "Terrain", "parm": "Limits", "havk": "Solid", "ANIM": "Anim"}.items()},
    "types": {
        key: _fields(text)
        for key, text in {
            "Geom": "meshes [*Mesh]", "Mesh": "materialIndex dword, minBound float3, maxBound float3, boneBindings [token64], geometry *Shape",
            "Shape": "verts Verts, indices Indices", "Verts": "vertexCount dword, mesh Pack", "Pack": "fvf dword, vertices [byte]", "Indices": "indices [word]",
            "Model": "permutations [Permutation]", "Permutation": "token qword, materials [*Material]",
            "Material": "materialId dword, materialFlags dword, sortOrder dword, sortLayer dword, filename filename, textures [Texture], constants [Constant]",
            "Texture": "filename filename, textureFlags dword, token token64, uvPSInputIndex byte", "Constant": "name token32, value float4",
            "Shading": "shaders [Shader], techniques [Technique]", "Shader": "isPixelShader dword, dx11Shader Binary",
            "Binary": "data [byte], samplers [Sampler], constants [Token]", "Sampler": "textureIndex dword, textureSlot dword, token token64", "Token": "token token32",
            "Technique": "passes [Pass]", "Pass": "effects [Effect]", "Effect": "pixelShaderIndex dword, shaderPassFlags dword, renderState qword, vertexShaderVariants [Variant]",
            "Variant": "vertexShaderIndex dword, renderState qword",
            "Props": "propArray [Prop], propInstanceArray [Repeated]", "Prop": "filename filename, position float3, rotation float3, scale float",
            "Repeated": "filename filename, position float3, rotation float3, scale float, transforms [Transform]", "Transform": "position float3, rotation float3, scale float",
            "Zones": "zoneDefArray [Definition], zoneArray [Zone]", "Definition": "token dword, filename filename", "Zone": "defToken dword, zPos float, vertices [float2]",
            "Terrain": "dims dword2, swapDistance float, verticesPerChunkSide dword, heightMapArray [float]", "Limits": "rect float4",
            "Solid": "waterSurfaceZ float, collisions [Collision]", "Collision": "vertices [float3], indices [word]",
            "Anim": "bank *Bank", "Bank": "animations [*Clip]", "Clip": "token token64, moveSpeed float, data Granny", "Granny": "animation [byte], pointers [dword]",
        }.items()
    },
}

CORNERS = b"".join(f(x, y, 0) + bytes([255, 0, 0, 255, 3, 1, 0, 0]) + f(x / 2, y / 4) for x, y in ((0, 0), (2, 0), (0, 4)))
MESH = Block(d(1), f(-1, -2, -3), f(1, 2, 3), (2, q(7, 1 << 63)), (None, Block(d(3, 0x107), (len(CORNERS), CORNERS), (6, struct.pack("<6H", 0, 1, 2, 2, 1, 0)))))
MATERIALS = (
    Block(d(5, 6, 7, 8), name(900), array(Block(name(800), d(3), q(17), b"\1"), Block(name(70_000), d(4), q(18), b"\0")), array(Block(d(99), f(1, 2, 3, 4)))),
    Block(d(9, 0, 0, 0), name(901), (0, b""), (0, b"")),
)
MODEL = _packfile(b"MODL", (b"GEOM", 1, bytes(Block(pointers(MESH, Block(bytes(28), (0, b""), (None, b"")))))), (b"MODL", 1, bytes(Block(array(Block(q(0), pointers(*MATERIALS)), Block(q(0), (0, b"")))))))


def _shader(pixel: int, code: bytes, samplers: list[tuple[int, int]], tokens: list[int]) -> Block:
    return Block(d(pixel), (len(code), code), array(*[Block(d(t, s), q(40 + s)) for t, s in samplers]), (len(tokens), d(*tokens)))


def _effect(pixel: int, flags: int, state: int, vertex: int, own: int) -> Block:
    return Block(d(pixel, flags), q(state), array(Block(d(vertex), q(own))))


SHADERS = (_shader(0, b"vs", [], []), _shader(1, b"ps_one", [(0, 0)], [11, 12]), _shader(1, b"ps", [(1, 0), (0, 1), (9, 2)], []), _shader(1, b"depth", [(0, 15), (1, 16), (0, 17), (1, 18)], []))
TECHNIQUES = array(
    Block(array(Block(array(_effect(3, 0, 1, 0, 0), _effect(1, 0, 2, 0, 0))), Block(array(_effect(2, 0x4000, 0, 0, 33))))),
    Block(array(Block(array(_effect(2, 0, 5, 0, 0), _effect(2, 0, 6, 0, 0), _effect(0xFFFFFFFF, 0, 7, 0, 0))))),
)
SHADING = _packfile(b"AMAT", (b"BGFX", 1, bytes(Block(array(*SHADERS), TECHNIQUES))))
PLACE = f(1, 2, 3), f(0, 0.5, 0), f(2)
MAP = _packfile(
    b"mapc",
    (b"prp2", 1, bytes(Block(array(Block(name(800), *PLACE), Block(name(0), *PLACE), Block(name(70_000), *PLACE)), array(Block(name(800), *PLACE, array(Block(f(7, 8, 9), f(0, 0, 0), f(1)))))))),
    (b"zon2", 1, bytes(Block(array(Block(d(4), name(800)), Block(d(5), name(801)), Block(d(5), name(0)), Block(d(4), name(70_000)), Block(d(0), name(801))), array(Block(d(4), f(9), (2, f(0, 0, 4, 2))), Block(d(5), f(0), (0, b"")), Block(d(6), f(0), (0, b"")), Block(d(0), f(0), (0, b"")))))),
    (b"trn\0", 1, bytes(Block(d(2, 1), f(9.5), d(3), (6, f(0, 1, 2, 3, 4, 5))))),
    (b"parm", 1, f(-10, -20, 10, 20)),
    (b"havk", 1, bytes(Block(f(-2), array(Block((2, f(1, 2, 3, 4, 5, 6)), (3, struct.pack("<3H", 0, 1, 0))), Block((0, b""), (1, b"\0\0")))))),
)


def _clip() -> bytes:
    """A clip of one group with two tracks of one name; places count from the blob's start."""
    head, group, track, curve = 48, 64, 96, 96 + 2 * 60
    out = bytearray(curve + 16 + 8)
    struct.pack_into("<QfffIQ", out, 0, curve + 16, 1.5, 0.25, 1.0, 1, head)
    struct.pack_into("<Q", out, head, group)
    struct.pack_into("<QIQIQ", out, group, 0, 0, 0, 2, track)
    for k in range(2):
        struct.pack_into("<Q", out, track + 60 * k, curve + 20)
        struct.pack_into("<Q", out, track + 60 * k + 36, curve if k else 0)
    struct.pack_into("<BBHfff", out, curve, 4, 0, 0, 1, 2, 3)
    out[curve + 16 :] = b"run\0hip\0"
    return bytes(out)


CLIPS = _packfile(b"ABIX", (b"ANIM", 1, bytes(Block((None, Block(pointers(Block(q(77), f(2.5), (len(_clip()), _clip()), (2, d(0, 8))))))))))


def _atlas() -> bytes:
    """One layer after 28 bytes of fields, then three pages, the second of which names nothing, then a reference."""
    fields = d(1, 28 - 4, 0, 0, 3, 28 + 24 - 20, 0)
    layer = d(0, 0, 32, 16, 0) + b"DXT5"
    pages, after = b"", 28 + 24 + 3 * 24
    for k, (x, y) in enumerate(((-1, 2), (0, 0), (3, 4))):
        here = 28 + 24 + 24 * k + 12
        pages += struct.pack("<IiiIII", 0, x, y, 0 if k == 1 else after - here, 0, 0)
    return _packfile(b"PIMG", (b"PGTB", 3, fields + layer + pages + name(800)[1]))


def _content() -> bytes:
    parts = [(2, None), (2, 0), (0, None), (0, None), (0, None), (0, None), (4, 1), (0, None), (0, None), (2, 2), (12, 3)]
    size = 4 + 12 * len(parts)
    names = "core\0".encode("utf-16-le")
    bodies, at = [], size
    spaces = struct.pack("<qII", 0, 0, 0) + struct.pack("<qII", 16 + 16, 0, 0) + bytes(16) + names
    texts = struct.pack("<qq", 0, 8) + "alpha\0".encode("utf-16-le")
    for body in (spaces, d(0, 4, 0, 8), texts, d(50_000, 39_999, 60_000)):
        bodies.append((at, body))
        at += len(body)
    out = d(0)
    for count, body in parts:
        here = len(out) + 4
        out += struct.pack("<Iq", count, 0 if body is None else bodies[body][0] - here)
    return _packfile(b"cntc", (b"Main", 1, out + b"".join(b for _, b in bodies)))


BLOBS = [(_stored(b), 0) for b in (MODEL, SHADING, MAP, CLIPS, _atlas(), _content(), b"DXT5 texture")]  # base ids from 3 on
IDS = [(799, 3), (900, 4), (800, 9), (50_000, 9), (801, 3)]
QUERIES: dict = {}
ORACLE: dict = {}


def scene_archive(spark: SparkSession) -> str:
    return archive_queries.fixture(spark, "scenes", BLOBS, IDS)


query = partial(archive_queries.query, archive=scene_archive, queries=QUERIES, oracle=ORACLE)


def rows(a: Archive, table: str) -> DataFrame:
    return scenes.scene_table(a.blobs(a.mft.where("base_id > 2")), REGISTRY, table)


def point(column: str, *names: str) -> list:
    return [F.col(column)[k].cast("double").alias(n) for k, n in enumerate(names)]


@query("base_id BIGINT, mesh INTEGER, material BIGINT, mask BIGINT, n_vertices BIGINT, n_triangles BIGINT, skinned BOOLEAN, tangents BOOLEAN, low DOUBLE, high DOUBLE, first BIGINT, second BIGINT", (3, 0, 1, 0x107, 3, 2, "true", "false", -1, 3, 7, -(1 << 63)))
def scene_meshes(a: Archive) -> DataFrame:
    return rows(a, "meshes").select("*", *point("least", "low"), F.col("most")[2].cast("double").alias("high"), F.col("bindings")[0].alias("first"), F.col("bindings")[1].alias("second"))


@query("base_id BIGINT, mesh INTEGER, ord INTEGER, x DOUBLE, y DOUBLE, z DOUBLE, u DOUBLE, v DOUBLE, up DOUBLE, weight DOUBLE, bone INTEGER", (3, 0, 0, 0, 0, 0, 0, 0, 1, 0.5, 3), (3, 0, 1, 2, 0, 0, 1, 0, 1, 0.5, 3), (3, 0, 2, 0, 4, 0, 0, 1, 1, 0.5, 3))
def scene_vertices(a: Archive) -> DataFrame:
    return rows(a, "vertices").select("*", *point("position", "x", "y", "z"), *point("uv", "u", "v"), F.col("normal")[2].cast("double").alias("up"), F.col("weights")[3].cast("double").alias("weight"), F.col("bones")[0].alias("bone"))


@query("base_id BIGINT, mesh INTEGER, ord INTEGER, a INTEGER, b INTEGER, c INTEGER", (3, 0, 0, 0, 1, 2), (3, 0, 1, 2, 1, 0))
def scene_triangles(a: Archive) -> DataFrame:
    return rows(a, "triangles")


@query("base_id BIGINT, material INTEGER, material_id BIGINT, flags BIGINT, sort_order BIGINT, sort_layer BIGINT, file_id BIGINT", (3, 0, 5, 6, 7, 8, 900), (3, 1, 9, 0, 0, 0, 901))
def scene_materials(a: Archive) -> DataFrame:
    return rows(a, "materials")


@query("base_id BIGINT, material INTEGER, slot INTEGER, file_id BIGINT, token BIGINT, flags BIGINT, uv INTEGER", (3, 0, 0, 800, 17, 3, 1), (3, 0, 1, 70_000, 18, 4, 0))
def scene_textures(a: Archive) -> DataFrame:
    return rows(a, "textures")


@query("base_id BIGINT, material INTEGER, ord INTEGER, name BIGINT, x DOUBLE, w DOUBLE", (3, 0, 0, 99, 1, 4))
def scene_constants(a: Archive) -> DataFrame:
    return rows(a, "constants").select("*", *point("value", "x", "y", "z", "w"))


@query("base_id BIGINT, shader INTEGER, pixel BOOLEAN, code_size BIGINT, n_constants INTEGER", (4, 0, "false", 2, 0), (4, 1, "true", 6, 2), (4, 2, "true", 2, 0), (4, 3, "true", 5, 0))
def scene_shaders(a: Archive) -> DataFrame:
    return rows(a, "shaders").withColumn("n_constants", F.size("constants"))


@query("base_id BIGINT, transparent BOOLEAN, pixel INTEGER, vertex INTEGER, state BIGINT", (4, "false", 2, 0, 5), (4, "true", 2, 0, 33))
def scene_effects(a: Archive) -> DataFrame:
    return scenes.picked_effects(rows(a, "effects"), rows(a, "shaders"), rows(a, "samplers"))


@query("base_id BIGINT, material INTEGER, shader INTEGER, slot BIGINT, file_id BIGINT", (3, 0, 1, 0, 800), (3, 0, 2, 0, 70_000), (3, 0, 2, 1, 800), (3, 0, 2, 2, None), (3, 0, 3, 15, 800), (3, 0, 3, 16, 70_000), (3, 0, 3, 17, 800), (3, 0, 3, 18, 70_000))
def scene_bound_textures(a: Archive) -> DataFrame:
    lists = rows(a, "samplers").join(a.file_ids, "base_id").drop("base_id")
    return scenes.bound_textures(lists, rows(a, "textures"), rows(a, "materials"))


@query("base_id BIGINT, ord INTEGER, file_id BIGINT, x DOUBLE, turn DOUBLE, scale DOUBLE", (5, 0, 800, 1, 0.5, 2), (5, 1, 70_000, 1, 0.5, 2), (5, 2, 800, 1, 0.5, 2), (5, 3, 800, 7, 0, 1))
def scene_props(a: Archive) -> DataFrame:
    return rows(a, "props").select("base_id", "ord", "file_id", *point("position", "x"), F.col("rotation")[1].cast("double").alias("turn"), F.col("scale").cast("double"))


@query("base_id BIGINT, file_id BIGINT, ord INTEGER, model_base BIGINT, uses BIGINT, place INTEGER", *[(5, 800, k, 9, 3, 1) for k in (0, 2, 3)])
def scene_placements(a: Archive) -> DataFrame:
    props = rows(a, "props")
    return scenes.placements(props, scenes.unique_models(props), a.file_ids)


@query("base_id BIGINT, ord INTEGER, file_id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE", (5, 0, 70_000, 2, 1, 9))
def scene_zones(a: Archive) -> DataFrame:
    return scenes.placed_zones(rows(a, "zones"), rows(a, "zone_definitions")).select("*", *point("position", "x", "y", "z"))


@query("base_id BIGINT, across BIGINT, down BIGINT, swap DOUBLE, side BIGINT, left_edge DOUBLE, n_heights INTEGER, last DOUBLE", (5, 2, 1, 9.5, 3, -10, 6, 5))
def scene_terrain(a: Archive) -> DataFrame:
    t = rows(a, "terrain").withColumn("swap", F.col("swap").cast("double"))
    return t.select("*", *point("rect", "left_edge"), F.size("heights").alias("n_heights"), F.col("heights")[5].cast("double").alias("last"))


@query("base_id BIGINT, ord INTEGER, water DOUBLE, n_corners INTEGER, last DOUBLE, n_indices INTEGER", (5, 0, -2, 2, 6, 3))
def scene_collision(a: Archive) -> DataFrame:
    return rows(a, "collision").select("base_id", "ord", F.col("water").cast("double"), F.size("corners").alias("n_corners"), F.col("corners")[1][2].cast("double").alias("last"), F.size("indices").alias("n_indices"))


@query("base_id BIGINT, clip INTEGER, token BIGINT, speed DOUBLE, name VARCHAR, duration DOUBLE, step DOUBLE, n_bytes INTEGER, n_fixups INTEGER", (6, 0, 77, 2.5, "run", 1.5, 0.25, len(_clip()), 2))
def scene_clips(a: Archive) -> DataFrame:
    return rows(a, "clips").select("*", F.length("blob").alias("n_bytes"), F.size("fixups").alias("n_fixups")).withColumns({"speed": F.col("speed").cast("double"), "duration": F.col("duration").cast("double"), "step": F.col("step").cast("double")})


@query("bone INTEGER, name VARCHAR, slot VARCHAR, format INTEGER, n_controls INTEGER", (0, "hip", "orientation", 2, 0), (0, "hip", "position", 4, 1), (0, "hip", "scale_shear", 2, 0), (1, "arm", None, None, None))
def scene_bone_curves(a: Archive) -> DataFrame:
    bones = a.spark.createDataFrame([(0, "hip"), (1, "arm")], "bone int, name string")
    return scenes.bone_curves(bones, rows(a, "curves").withColumnRenamed("base_id", "clip_base")).withColumn("n_controls", F.size("controls"))


@query("base_id BIGINT, ord INTEGER, cx INTEGER, cy INTEGER, file_id BIGINT, tile_width BIGINT, tile_height BIGINT, format VARCHAR, to_base BIGINT", (7, 0, -1, 2, 800, 32, 16, "DXT5", 9), (7, 1, 3, 4, 800, 32, 16, "DXT5", 9))
def scene_pages(a: Archive) -> DataFrame:
    return rows(a, "pages").join(a.file_ids.withColumnRenamed("base_id", "to_base"), "file_id", "left")


@query("base_id BIGINT, part VARCHAR, items BIGINT", *[(8, part, n) for part, n in (("content types", 2), ("namespaces", 2), ("file-index fixups", 4), ("strings", 2), ("content bytes", 12))])
def scene_store(a: Archive) -> DataFrame:
    return rows(a, "stores").where("items > 0")


@query("base_id BIGINT, part VARCHAR, ord INTEGER, name VARCHAR", (8, "namespaces", 0, "(root)"), (8, "namespaces", 1, "core"), (8, "strings", 1, "alpha"))
def scene_store_names(a: Archive) -> DataFrame:
    return rows(a, "store_names")


@query("base_id BIGINT, ord INTEGER, file_id BIGINT, to_base BIGINT", (8, 0, 50_000, 9), (8, 1, 60_000, None))
def scene_store_assets(a: Archive) -> DataFrame:
    return rows(a, "store_assets").join(a.file_ids.withColumnRenamed("base_id", "to_base"), "file_id", "left")
