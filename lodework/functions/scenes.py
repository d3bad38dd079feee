"""What scenes are made of, as rows: meshes, materials, maps, shader lists, clips, atlases and content stores.

Each function takes a blob (and the registry, where fields come from it) and gives tuples; the schema stands beside it in
TABLES. Fields that a schema lacks and places beyond the end read as zero; a blob of another kind gives no rows. Tokens and
states of 64 bits come as signed numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .curves import clip_header, tracks
from .media import executable_sections, shader_role, shaders
from .models import values, vertices
from .packfile import chunks, file_id, number

#: The effect flag of transparent passes; the smallest and largest id, exclusive, of a content store's files.
TRANSPARENT = 0x4000
LEAST_ASSET, MOST_ASSET = 40_000, 0xFFFFFF
#: The arrays of a content store, in the order stored.
STORE_PARTS = (
    "content types", "namespaces", "file references", "index entries", "local fixups", "external fixups", "file-index fixups", "string-index fixups", "tracked references", "strings", "content bytes",
)


def _chunk(data: bytes, registry: dict, name: str) -> dict:
    return values(data, registry, frozenset([name]), arrays=True).get(name) or {}


def _floats(v: object, n: int = 3) -> list[float]:
    flat = [] if v is None else np.ravel(v).tolist()
    return flat if len(flat) == n else [0.0] * n


def _numbers(v: object) -> np.ndarray:
    return np.zeros(0, np.int64) if v is None else np.asarray(v)


def _signed(v: int | None, bits: int = 64) -> int:
    v = v or 0
    return v - (1 << bits) if v >> bits - 1 else v


def _structs(v: object) -> list[tuple[int, dict]]:
    """An array's structs that are there, with their places."""
    return [(k, s) for k, s in enumerate(v or ()) if s]


# ---- models


def _meshes(data: bytes, registry: dict) -> Iterator[tuple[int, dict, dict, np.ndarray]]:
    """(place, mesh, vertex data, indices) of the meshes that have geometry."""
    found = [m for _, m in _structs(_chunk(data, registry, "GEOM").get("meshes")) if (m.get("geometry") or {}).get("verts")]
    for k, m in enumerate(found):
        yield k, m, m["geometry"]["verts"], _numbers((m["geometry"].get("indices") or {}).get("indices"))


def _columns(verts: dict) -> dict[str, np.ndarray]:
    pack, n = verts.get("mesh") or {}, verts.get("vertexCount") or 0
    return vertices(pack.get("fvf") or 0, _numbers(pack.get("vertices")).astype(np.uint8).tobytes(), n) if n else {}


def mesh_rows(data: bytes, registry: dict) -> list[tuple]:
    rows = []
    for k, m, verts, indices in _meshes(data, registry):
        mask = (verts.get("mesh") or {}).get("fvf") or 0
        rows.append((k, m.get("materialIndex") or 0, _floats(m.get("minBound")), _floats(m.get("maxBound")), mask, verts.get("vertexCount") or 0, len(indices) // 3, mask & 6 == 6, bool(mask & 0x80), _numbers(m.get("boneBindings")).astype(np.int64).tolist()))
    return rows


def vertex_rows(data: bytes, registry: dict) -> list[tuple]:
    """A null stands for what the format lacks, but for normals, which point up then."""
    rows = []
    for k, _, verts, _ in _meshes(data, registry):
        cols = _columns(verts)
        n = max((len(c) for c in cols.values()), default=0)
        wanted = [cols[c].tolist() if c in cols else [None] * n for c in ("position", "normal", "uv0", "weights", "indices")]
        rows += [(k, i, *v) for i, v in enumerate(zip(*wanted, strict=True))]
    return rows


def triangle_rows(data: bytes, registry: dict) -> list[tuple]:
    return [(k, i, *t) for k, _, _, indices in _meshes(data, registry) for i, t in enumerate(indices[: len(indices) // 3 * 3].reshape(-1, 3).tolist())]


def _materials(data: bytes, registry: dict) -> list[tuple[int, dict]]:
    """The materials of the first permutation."""
    permutations = _chunk(data, registry, "MODL").get("permutations") or [None]
    return _structs((permutations[0] or {}).get("materials"))


def material_rows(data: bytes, registry: dict) -> list[tuple]:
    return [(k, *(m.get(f) or 0 for f in ("materialId", "materialFlags", "sortOrder", "sortLayer", "filename"))) for k, m in _materials(data, registry)]


def texture_rows(data: bytes, registry: dict) -> list[tuple]:
    return [(k, i, t.get("filename") or 0, _signed(t.get("token")), t.get("textureFlags") or 0, t.get("uvPSInputIndex") or 0) for k, m in _materials(data, registry) for i, t in _structs(m.get("textures"))]


def constant_rows(data: bytes, registry: dict) -> list[tuple]:
    return [(k, i, c.get("name") or 0, _floats(c.get("value"), 4)) for k, m in _materials(data, registry) for i, c in _structs(m.get("constants"))]


# ---- shader lists


def _shader_list(data: bytes, registry: dict) -> list[tuple[int, dict, dict]]:
    return [(k, s, s.get("dx11Shader") or {}) for k, s in _structs(_chunk(data, registry, "BGFX").get("shaders"))]


def shader_list_rows(data: bytes, registry: dict) -> list[tuple]:
    return [(k, bool(s.get("isPixelShader")), len(_numbers(b.get("data"))), [c.get("token") or 0 for _, c in _structs(b.get("constants"))]) for k, s, b in _shader_list(data, registry)]


def sampler_rows(data: bytes, registry: dict) -> list[tuple]:
    return [(k, i, _signed(s.get("token")), s.get("textureIndex") or 0, s.get("textureSlot") or 0) for k, _, b in _shader_list(data, registry) for i, s in _structs(b.get("samplers"))]


def effect_rows(data: bytes, registry: dict) -> list[tuple]:
    """Effects of all techniques and passes; a shader that isn't named is -1, and the state is the first one that isn't zero."""
    rows = []
    for _, technique in _structs(_chunk(data, registry, "BGFX").get("techniques")):
        for _, turn in _structs(technique.get("passes")):
            for _, e in _structs(turn.get("effects")):
                first = next((v for _, v in _structs(e.get("vertexShaderVariants"))), {})
                pixel, vertex = (_signed(s.get(f, 0xFFFFFFFF), 32) for s, f in ((e, "pixelShaderIndex"), (first, "vertexShaderIndex")))
                rows.append((len(rows), pixel, vertex, bool((e.get("shaderPassFlags") or 0) & TRANSPARENT), _signed(e.get("renderState") or first.get("renderState"))))
    return rows


# ---- maps


def prop_rows(data: bytes, registry: dict) -> list[tuple]:
    """Placed models: the single ones, then each repeated one at its own place and at each of its transforms."""
    part, found = _chunk(data, registry, "prp2"), []
    for box in ("propArray", "propInstanceArray"):
        for _, p in _structs(part.get(box)):
            if p.get("filename"):
                found += [(p["filename"], at) for at in (p, *(t for _, t in _structs(p.get("transforms") if box == "propInstanceArray" else None)))]
    return [(k, ident, _floats(p.get("position")), _floats(p.get("rotation")), 1.0 if "scale" not in p else p["scale"] or 0.0) for k, (ident, p) in enumerate(found)]


def zone_rows(data: bytes, registry: dict) -> list[tuple]:
    """Zones and the middle of their outline's corners; an empty outline is at zero."""
    rows = []
    for k, z in _structs(_chunk(data, registry, "zon2").get("zoneArray")):
        corners = _numbers(z.get("vertices")).astype(np.float32).reshape(-1, 2)
        middle = np.add.accumulate(corners)[-1] / np.float32(len(corners)) if len(corners) else np.zeros(2)
        rows.append((k, z.get("defToken") or 0, [*middle.tolist(), z.get("zPos") or 0.0]))
    return rows


def zone_definition_rows(data: bytes, registry: dict) -> list[tuple]:
    return [(k, z.get("token") or 0, z.get("filename") or 0) for k, z in _structs(_chunk(data, registry, "zon2").get("zoneDefArray"))]


def terrain_rows(data: bytes, registry: dict) -> list[tuple]:
    t = _chunk(data, registry, "trn")
    across, down = (np.ravel(t.get("dims") or (0, 0)).tolist() + [0, 0])[:2]
    heights = _numbers(t.get("heightMapArray"))
    if not len(heights) or not across or not down:
        return []
    rect = _chunk(data, registry, "parm").get("rect")
    return [(across, down, t.get("swapDistance") or 0.0, t.get("verticesPerChunkSide") or 0, None if rect is None else _floats(rect, 4), heights.tolist())]


def collision_rows(data: bytes, registry: dict) -> list[tuple]:
    """Collision meshes that have corners and indices, with the water's height (null: none)."""
    part, rows = _chunk(data, registry, "havk"), []
    for _, c in _structs(part.get("collisions")):
        corners, indices = _numbers(c.get("vertices")), _numbers(c.get("indices"))
        if len(corners) and len(indices):
            rows.append((len(rows), part.get("waterSurfaceZ"), corners.reshape(-1, 3).tolist(), indices.tolist()))
    return rows


# ---- clips


def _clips(data: bytes, registry: dict) -> Iterator[tuple[int, dict, bytes, np.ndarray]]:
    part = _chunk(data, registry, "ANIM")
    box = part if "animations" in part else part.get("bank") or {}
    for k, (_, c) in enumerate(_structs(box.get("animations"))):
        body = c.get("data") or {}
        yield k, c, _numbers(body.get("animation")).astype(np.uint8).tobytes(), _numbers(body.get("pointers"))


def _pointer(data: bytes) -> int:
    return 8 if number(data, 2, 2) & 4 else 4


def clip_rows(data: bytes, registry: dict) -> list[tuple]:
    rows = []
    for k, c, blob, fixups in _clips(data, registry):
        h = clip_header(blob, _pointer(data)) or {}
        rows.append((k, _signed(c.get("token")), c.get("moveSpeed") or 0.0, h.get("name", ""), h.get("duration", 0.0), h.get("step", 0.0), blob, fixups.tolist()))
    return rows


def curve_rows(data: bytes, registry: dict) -> list[tuple]:
    """Each track's three curves, with knots and controls as numbers."""
    rows = []
    for k, _, blob, _ in _clips(data, registry):
        for t, name, found in tracks(blob, _pointer(data)):
            rows += [(k, t, name, slot, c.kind, c.degree, c.knots.tolist(), c.controls.tolist()) for slot, c in found.items()]
    return rows


# ---- atlases and content stores, whose layout is fixed


def _first(data: bytes, container: bytes, name: str) -> tuple[int, int, int] | None:
    """(place, version, header size) of a chunk of a container's."""
    if data[:2] != b"PF" or data[8:12] != container:
        return None
    return next(((at, version, header) for at, n, version, _, header in chunks(data, "extract") if n == name), None)


def page_rows(data: bytes, registry: dict | None = None) -> list[tuple]:
    """An atlas' pages that name a file, with the size and format of all its tiles; only version 3 is known."""
    found = _first(data, b"PIMG", "PGTB")
    if not found or found[1] != 3:
        return []
    base = found[0] + found[2]
    layer, pages = (at + number(data, at, 4) for at in (base + 4, base + 20))
    wide, high, kind = (number(data, layer + at, 4) for at in (8, 12, 20)) if number(data, base, 4) else (0, 0, 0)
    rows = []
    for at in range(pages, min(pages + 24 * number(data, base + 16, 4), len(data) - 23), 24) if wide and high else ():
        to = at + 12 + step if (step := number(data, at + 12, 4)) else len(data)
        if ident := file_id((number(data, to, 2), number(data, to + 2, 2), 0, 0))[0]:
            rows.append((len(rows), number(data, at, 4), *(_signed(number(data, at + k, 4), 32) for k in (4, 8)), ident, wide, high, kind.to_bytes(4, "little").decode("latin-1")))
    return rows


def _store(data: bytes) -> list[tuple[str, int, int]]:
    """(part, items, place) of a content store's arrays."""
    found = _first(data, b"cntc", "Main")
    return [(name, number(data, at, 4), at + 4 + _signed(number(data, at + 4, 8))) for k, name in enumerate(STORE_PARTS) for at in [found[0] + 20 + 12 * k]] if found else []


def store_rows(data: bytes, registry: dict | None = None) -> list[tuple]:
    return [(k, name, n) for k, (name, n, _) in enumerate(_store(data))]


def store_name_rows(data: bytes, registry: dict | None = None) -> list[tuple]:
    """Names of namespaces (one that points nowhere is the root) and of contents (those are left out)."""
    rows = []
    for part, n, at in _store(data):
        step = {"namespaces": 16, "strings": 8}.get(part, 0)
        for k in range(min(n, max(len(data) - at, 0) // step) if step and at > 0 else 0):
            to = at + k * step + (away := _signed(number(data, at + k * step, 8)))
            end = next((q for q in range(to, len(data) - 1, 2) if not number(data, q, 2)), len(data)) if away and to > 0 else to
            if away or part == "namespaces":
                rows.append((part, k, data[to:end].decode("utf-16-le", "replace") if away else "(root)"))
    return rows


def store_asset_rows(data: bytes, registry: dict | None = None) -> list[tuple]:
    """The files that fixups point at in the content, each once, in the order of the fixups."""
    parts = {name: (n, at) for name, n, at in _store(data)}
    if not parts:
        return []
    (n, at), content = parts["file-index fixups"], parts["content bytes"][1]
    found = (number(data, content + number(data, at + 4 * k, 4), 4) for k in range(min(n, max(len(data) - at, 0) // 4) if at > 0 else 0))
    return [(k, ident) for k, ident in enumerate(dict.fromkeys(v for v in found if LEAST_ASSET < v < MOST_ASSET))]


# ---- executables


def region_rows(data: bytes, material_end: int, compute_start: int) -> list[tuple]:
    """Shader blobs in an executable's sections by address: material ones come first, compute ones last or by stage."""
    pe = number(data, 0x3C, 4)
    wide = bool(executable_sections(data)) and number(data, pe + 24, 2) == 0x20B
    base, rows = number(data, pe + 48, 8), []
    table = pe + 24 + number(data, pe + 20, 2)
    for k, (_, start, size) in enumerate(executable_sections(data) if wide else ()):
        for s in shaders(data[start : start + size]):
            at = base + number(data, table + 40 * k + 12, 4) + s["offset"]
            region = "material" if at < material_end else "compute" if at >= compute_start or s["stage"] == "C" else "engine"
            role = shader_role(s["stage"], {u["name"] for u in s["uniforms"]}, sum(u["sampler"] for u in s["uniforms"]))
            rows.append((len(rows), start + s["offset"], at, s["stage"], region, role))
    return rows


REGION = "ord int, offset long, address long, stage string, region string, role string"

VECTOR = "array<float>"
TABLES = {
    "meshes": (mesh_rows, f"mesh int, material long, least {VECTOR}, most {VECTOR}, mask long, n_vertices long, n_triangles long, skinned boolean, tangents boolean, bindings array<long>"),
    "vertices": (vertex_rows, f"mesh int, ord int, position {VECTOR}, normal {VECTOR}, uv {VECTOR}, weights {VECTOR}, bones array<int>"),
    "triangles": (triangle_rows, "mesh int, ord int, a int, b int, c int"),
    "materials": (material_rows, "material int, material_id long, flags long, sort_order long, sort_layer long, file_id long"),
    "textures": (texture_rows, "material int, slot int, file_id long, token long, flags long, uv int"),
    "constants": (constant_rows, f"material int, ord int, name long, value {VECTOR}"),
    "shaders": (shader_list_rows, "shader int, pixel boolean, code_size long, constants array<long>"),
    "samplers": (sampler_rows, "shader int, ord int, token long, texture_index long, slot long"),
    "effects": (effect_rows, "ord int, pixel int, vertex int, transparent boolean, state long"),
    "props": (prop_rows, f"ord int, file_id long, position {VECTOR}, rotation {VECTOR}, scale float"),
    "zones": (zone_rows, f"ord int, token long, position {VECTOR}"),
    "zone_definitions": (zone_definition_rows, "ord int, token long, file_id long"),
    "terrain": (terrain_rows, f"across long, down long, swap float, side long, rect {VECTOR}, heights {VECTOR}"),
    "collision": (collision_rows, f"ord int, water float, corners array<{VECTOR}>, indices array<int>"),
    "clips": (clip_rows, "clip int, token long, speed float, name string, duration float, step float, blob binary, fixups array<long>"),
    "curves": (curve_rows, f"clip int, track int, name string, slot string, format int, degree int, knots {VECTOR}, controls array<{VECTOR}>"),
    "pages": (page_rows, "ord int, layer long, cx int, cy int, file_id long, tile_width long, tile_height long, format string"),
    "stores": (store_rows, "ord int, part string, items long"),
    "store_names": (store_name_rows, "part string, ord int, name string"),
    "store_assets": (store_asset_rows, "ord int, file_id long"),
}
