"""Typed values of packfiles, and what models are made of: vertices, bones, poses, curves.

values() reads a chunk by the registry into nested dicts and lists of numbers and strings, the form for nested
columns; bones(), vertices() and the rest work on such values or on arrays."""

from __future__ import annotations

import json
import struct

import numpy as np

from .media import vertex_layout
from .packfile import MOST_DEPTH, MOST_TEXT, SCALARS, STRINGS, chunks, file_id, number, printable

#: numpy's letters for the numbers of struct formats.
NUMPY = {"B": "u1", "H": "u2", "I": "u4", "Q": "u8", "f": "f4", "d": "f8"}


class Reader:
    """Reads structs of a registry at places in some bytes. What lies beyond the end is None."""

    def __init__(self, data: bytes, registry: dict, pointer: int, arrays: bool = False):
        self.data, self.types, self.pointer, self.arrays = data, registry.get("types", {}), pointer, arrays

    def size(self, kind: object) -> int:
        """The bytes that an inline value of this kind takes."""
        if isinstance(kind, dict):
            return sum(self.field_size(f) for f in self.types.get(kind.get("struct", ""), {}).get("fields", ()))
        return self.pointer if kind in STRINGS else struct.calcsize("<" + SCALARS[kind]) if kind in SCALARS else 4

    def field_size(self, f: dict) -> int:
        kind = f.get("kind", "dword")
        if kind == "struct":
            return self.size({"struct": f.get("type", "")})
        if kind == "array":
            return f.get("count", 0) * self.size(f.get("element", "dword"))
        return self.pointer if kind == "ptr" else 4 + self.pointer if kind in ("array_ptr", "ptr_array_ptr") else self.size(kind)

    def follow(self, at: int) -> int | None:
        step = number(self.data, at, self.pointer)
        return at + step if step and at + step < len(self.data) else None

    def value(self, kind: object, at: int, depth: int) -> object:
        if isinstance(kind, dict):
            return self.struct(kind.get("struct", ""), at, depth + 1)
        if kind in STRINGS:
            to = self.follow(at)
            if to is None:
                return None
            if kind == "filename":
                return file_id(tuple(number(self.data, to + 2 * k, 2) for k in range(4)))[0]
            if kind == "char_ptr":
                return self.data[to : to + MOST_TEXT].split(b"\0", 1)[0].decode("latin-1")
            return self.data[to : to + 2 * MOST_TEXT].decode("utf-16-le", "replace").split("\0", 1)[0]
        form = "<" + SCALARS.get(kind, "I")
        raw = self.data[at : at + struct.calcsize(form)]
        if len(raw) < struct.calcsize(form):
            return None
        got = struct.unpack(form, raw)
        return got[0].hex() if isinstance(got[0], bytes) else got[0] if len(got) == 1 else list(got)

    def items(self, kind: object, at: int, count: int, depth: int, indirect: bool = False) -> list:
        step, out = self.pointer if indirect else self.size(kind), []
        fits = min(count, -(-(len(self.data) - at) // step)) if step and at < len(self.data) else 0
        if self.arrays and not indirect and isinstance(kind, str) and kind not in STRINGS and "s" not in (form := SCALARS.get(kind, "I")):
            whole = min(count, max(len(self.data) - at, 0) // step)
            flat = np.frombuffer(self.data, f"<{NUMPY[form[-1]]}", whole * int(form[:-1] or 1), at) if whole else np.zeros(0, np.float32)
            return flat.reshape(whole, -1) if form[:-1] else flat
        for i in range(fits):
            here = at + i * step
            to = self.follow(here) if indirect else here
            out.append(None if to is None else self.value(kind, to, depth))
        return out

    def struct(self, key: str, at: int, depth: int = 0) -> dict | None:
        if key not in self.types or depth > MOST_DEPTH:
            return None
        out = {}
        for f in self.types[key].get("fields", ()):
            kind = f.get("kind", "dword")
            if kind == "struct":
                v = self.struct(f.get("type", ""), at, depth + 1)
            elif kind == "array":
                v = self.items(f.get("element", "dword"), at, f.get("count", 0), depth)
            elif kind == "ptr":
                to = self.follow(at)
                v = None if to is None else self.value(f.get("target", "dword"), to, depth)
            elif kind in ("array_ptr", "ptr_array_ptr"):
                to = self.follow(at + 4)
                v = [] if to is None else self.items(f.get("element", "dword"), to, number(self.data, at, 4), depth, kind == "ptr_array_ptr")
            else:
                v = self.value(kind, at, depth)
            out[f.get("name", "field")] = v
            at += self.field_size(f)
        return out


def values(data: bytes, registry: dict, only: frozenset[str] | None = None, arrays: bool = False) -> dict[str, dict]:
    """A packfile's chunks by name (`only` these), read by the registry; of chunks of one name the first counts. With `arrays`,
    arrays of numbers are numpy's."""
    if data[:2] != b"PF" or len(data) < 12:
        return {}
    own, every = registry.get("fileTypes", {}).get(printable(data[8:12]), {}), registry.get("chunks", {})
    r, out = Reader(data, registry, 8 if number(data, 2, 2) & 4 else 4, arrays), {}
    for at, shown, version, _, header in chunks(data, "extract"):
        name = data[at : at + 4].split(b"\0", 1)[0].decode("latin-1")  # a name of three letters ends in a zero
        key = next((v for n in (name, shown) for by in (own, every) if (v := by.get(n, {}).get(str(version)))), None)
        if key and name not in out and (only is None or name in only) and (got := r.struct(key, at + header)) is not None:
            out[name] = got
    return out


def values_json(data: bytes, registry: dict) -> list[tuple]:
    """(fourcc, json) of each chunk, for from_json or VARIANT."""
    return [(name, json.dumps(v)) for name, v in values(data, registry).items()]


VALUES = "fourcc string, json string"


def vertices(mask: int, raw: bytes, count: int | None = None) -> dict[str, np.ndarray]:
    """A vertex buffer's columns by its format: position, normal, uv0 to uv7, weights that add up to one, indices, and of a
    tangent frame normal, tangent and bitangent. A packed normal's layout isn't known, so it gives no column."""
    layout, stride = vertex_layout(mask)
    n = min(len(raw) // stride, count) if stride and count else len(raw) // stride if stride else 0
    rows = np.frombuffer(raw[: n * stride], np.uint8).reshape(n, stride) if stride else np.zeros((0, 0), np.uint8)
    out: dict[str, np.ndarray] = {}
    for label, size, at in layout:
        part = np.ascontiguousarray(rows[:, at : at + size])
        name = label.split(" ")[0]
        if "half" in label:
            out[name] = part.view("<f2").astype(np.float32)
        elif label == "blend weights":
            total = part.sum(axis=1, dtype=np.int64)[:, None]
            out["weights"] = np.where(total > 0, part / np.maximum(total, 1), [1.0, 0, 0, 0]).astype(np.float32)
        elif label == "blend indices":
            out["indices"] = part
        elif label == "color":
            out["color"] = part[:, [2, 1, 0, 3]]
        elif label == "tangent frame":
            for k, axis in enumerate(("normal", "tangent", "bitangent")):
                out[axis] = part[:, 4 * k : 4 * k + 3] / np.float32(127.5) - 1
        elif "packed" not in label:
            out[name] = part.view("<f4")[:, : 3 if name == "position" else None]
    if n and "normal" not in out:
        out["normal"] = np.tile(np.float32([0, 0, 1]), (n, 1))
    return out


def rotation(q: np.ndarray) -> np.ndarray:
    """3x3 matrices of quaternions (..., 4) as x, y, z, w, of any length but zero."""
    q = np.asarray(q, float)
    n = (q * q).sum(-1)
    v, w = q[..., :3], q[..., 3]
    cross = np.zeros((*q.shape[:-1], 3, 3))
    cross[..., 0, 1], cross[..., 0, 2], cross[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    cross -= np.swapaxes(cross, -1, -2)
    s = np.where(n > 1e-12, 2 / np.maximum(n, 1e-12), 0)[..., None, None]
    return np.eye(3) + s * (w[..., None, None] * cross + cross @ cross)


def bones(chunk: dict) -> list[tuple]:
    """(ord, name, parent, position, orientation, scale_shear, inverse_world) of a skeleton chunk's inline rig."""
    rig = chunk
    for step in ("skeletonData", "grannyModel", "Skeleton"):
        rig = (rig or {}).get(step)
    out = []
    for k, b in enumerate((rig or {}).get("Bones") or []):
        t = b.get("LocalTransform") or {}
        out.append((k, b.get("Name") or "", int(np.int32(np.uint32(b.get("ParentIndex") or 0))), t.get("Position") or [0.0] * 3, t.get("Orientation") or [0.0, 0, 0, 1], list(np.ravel(t.get("ScaleShear") or np.eye(3))), list(np.ravel(b.get("InverseWorld4x4") or np.zeros(16)))))
    return out


def rest_positions(rig: list[tuple]) -> np.ndarray:
    """Where each bone is at rest: the origin that its inverse world matrix maps to zero. A bone without a usable matrix is
    where its parent is; with none at all, local translations add up from the root."""
    world, good = np.zeros((len(rig), 3)), np.zeros(len(rig), bool)
    for k, b in enumerate(rig):
        m = np.array(b[6], float).reshape(4, 4)
        if abs(np.linalg.det(m[:3, :3])) >= 1e-20:
            world[k], good[k] = -m[3, :3] @ np.linalg.inv(m[:3, :3]), True
    some = good.any()
    for k, b in enumerate(rig):
        up = b[2] if 0 <= b[2] < k else -1
        if not some:
            world[k] = np.array(b[3]) + (world[up] if up >= 0 else 0)
        elif not good[k] and 0 <= b[2] < len(rig) and good[b[2]]:
            world[k] = world[b[2]]
    return world


def pose(rig: list[tuple], tracks: dict[str, tuple] | None = None) -> np.ndarray:
    """World positions from local transforms down the parents, which come before their children. A track of a bone's name
    (position, orientation, scale and shear, each None where it has no say) stands for its own transform."""
    linear, place = np.zeros((len(rig), 3, 3)), np.zeros((len(rig), 3))
    for k, (_, name, up, p, q, s, _) in enumerate(rig):
        p, q, s = (own if new is None else new for own, new in zip((p, q, s), (tracks or {}).get(name, (None,) * 3), strict=True))
        linear[k], place[k] = rotation(np.array(q)) @ np.reshape(s, (3, 3)), p
        if 0 <= up < k:
            linear[k], place[k] = linear[up] @ linear[k], place[up] + linear[up] @ place[k]
    return place


def sample_curve(knots: np.ndarray, controls: np.ndarray, degree: int, t: float) -> np.ndarray:
    """A B-spline at t by repeated interpolation: knots and controls repeat at the ends; quaternions (four numbers) are kept
    on one side and come out with length one. One knot is a constant; degree 0 holds the control of the first later knot."""
    controls = np.atleast_2d(np.asarray(controls, float))
    n = len(knots)
    if n <= 1:
        return controls[0]
    at = min(int(np.searchsorted(knots, t, "right")), n - 1)
    if degree <= 0:
        return controls[at]
    window = np.clip(np.arange(at - degree, at + degree), 0, n - 1)
    u, p = np.asarray(knots, float)[window], controls[window].copy()
    if p.shape[1] == 4:
        for k in range(1, len(p)):
            if p[k - 1] @ p[k] < 0:
                p[k] = -p[k]
    p = p[: degree + 1]
    for r in range(1, degree + 1):
        for j in range(degree, r - 1, -1):
            low, high = u[j - 1], u[j + degree - r]
            share = (t - low) / (high - low) if high != low else 0.0
            p[j] = (1 - share) * p[j - 1] + share * p[j]
    out = p[degree]
    return out / size if len(out) == 4 and (size := np.sqrt(out @ out)) > 1e-12 else out


def bind_errors(rig: list[tuple]) -> dict[str, float]:
    """How far the composed rest pose is from the inverse world matrices' places: root mean square and worst."""
    d = np.sqrt(((pose(rig) - rest_positions(rig)) ** 2).sum(axis=1)) if rig else np.zeros(0)
    return {"bones": len(rig), "rms": float(np.sqrt((d * d).mean())) if len(d) else 0.0, "worst": float(d.max(initial=0))}


def grid_normals(heights: np.ndarray, step: float = 1.0) -> np.ndarray:
    """Normals of a height grid by central differences, one-sided at the edges."""
    gy, gx = np.gradient(np.asarray(heights, float), step) if min(np.shape(heights)) > 1 else (np.zeros_like(heights, float),) * 2
    n = np.stack([-gx, -gy, np.ones_like(gx)], -1)
    return n / np.linalg.norm(n, axis=-1, keepdims=True)
