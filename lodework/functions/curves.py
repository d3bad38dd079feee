"""Animation clips: the tracks in a clip's blob, and their curves as numbers.

A curve starts with its format and degree. All formats but four hold scaled integers (or floats) for knots and controls;
PACKED says how each lays them out. Places in a blob are offsets from its start; what lies beyond the end reads as zero."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

IDENTITY = 2
#: Format -> (type of knots and controls, stored controls a knot, numbers they stand for, scales and offsets of one
#: each or three). One control and three scales is a line; nine numbers are a matrix with the controls on its diagonal.
PACKED = {
    10: ("<u2", 3, 3, 3), 11: ("<u1", 3, 3, 3),
    12: ("<u2", 1, 9, 1), 14: ("<u1", 1, 9, 1),
    13: ("<u2", 3, 9, 3), 15: ("<u1", 3, 9, 3),
    16: ("<f4", 1, 3, 3), 17: ("<u2", 1, 3, 3), 18: ("<u1", 1, 3, 3),
}
#: Scale and offset of a quaternion's component, in units of one over the root of two; eight to fifteen are these negated.
RANGES = ((2, -1), (1, -0.5), (0.5, -0.75), (0.5, -0.25), (0.5, 0.25), (0.25, -0.25), (0.25, -0.125), (0.25, 0))


@dataclass
class Curve:
    kind: int
    degree: int
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    controls: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))


class Blob:
    def __init__(self, data: bytes, pointer: int):
        self.data, self.pointer = data, pointer

    def many(self, at: int, kind: str, n: int) -> np.ndarray:
        """n numbers, as many as there are before the end."""
        n = min(n, max(len(self.data) - at, 0) // np.dtype(kind).itemsize) if at >= 0 else 0
        return np.frombuffer(self.data, kind, n, at) if n > 0 else np.zeros(0, kind)

    def one(self, at: int, form: str = "I") -> float:
        size = struct.calcsize(form)
        return struct.unpack("<" + form, self.data[at : at + size])[0] if 0 <= at and at + size <= len(self.data) else 0

    def text(self, at: int) -> str:
        return self.data[at:].split(b"\0", 1)[0].decode("latin-1") if 0 < at < len(self.data) else ""

    def knots_and_controls(self, at: int, kind: str, total: int, per: int) -> tuple[np.ndarray, np.ndarray]:
        """Of `total` numbers: the knots, then `per` controls for each knot."""
        raw = self.many(at, kind, total).astype(np.float32)
        n = len(raw) // (per + 1)
        return raw[:n], raw[n : n * (per + 1)].reshape(n, per)


def _knot_scale(truncated: int) -> np.float32:
    """One over the float whose upper half is stored."""
    f = np.array([truncated << 16], "<u4").view("<f4")[0]
    return np.float32(1) / f if f else np.float32(0)


def _smallest_three(raw: np.ndarray, entries: int, bits: int) -> np.ndarray:
    """Quaternions of three stored components each; the one left out follows from the length of one. The top bits of the three
    say the sign of that one and which it is."""
    picks = np.array([entries >> 4 * d & 15 for d in range(4)])
    table = np.array(RANGES, np.float32) * np.float32(np.sqrt(0.5))
    table = np.concatenate([table, -table])[picks]
    top, low = raw >> bits & 1, raw & (1 << bits) - 1
    left_out = top[:, 1] * 2 + top[:, 2]
    out, rows, total = np.zeros((len(raw), 4), np.float32), np.arange(len(raw)), np.zeros(len(raw), np.float32)
    for k in range(3):
        to = (left_out + 1 + k) % 4
        v = table[to, 1] + table[to, 0] / np.float32((1 << bits) - 1) * low[:, k].astype(np.float32)
        out[rows, to] = v
        total += v * v
    out[rows, left_out] = np.sqrt(np.maximum(1 - total, 0)) * np.where(top[:, 0], -1, 1)
    return out


def curve(b: Blob, at: int, dim: int) -> Curve:
    """The curve at a place; `dim` is what its slot needs. No place or an unknown format is the identity, without controls."""
    kind = b.one(at, "B") if 0 < at <= len(b.data) - 2 else IDENTITY
    c, p = Curve(int(kind), int(b.one(at + 1, "B")) if kind != IDENTITY else 0), b.pointer
    if kind == 0:  # a control for each frame, no knots
        c.controls = _rows(b.many(b.one(at + 8), "<f4", b.one(at + 4)), b.one(at + 2, "h") or dim)
    elif kind == 1:
        c.knots = b.many(b.one(at + 8), "<f4", b.one(at + 4))
        n = b.one(at + 8 + p)
        c.controls = _rows(b.many(b.one(at + 12 + p), "<f4", n), n // b.one(at + 4) if b.one(at + 4) else dim)
    elif kind in (3, 4, 5):  # constants
        flat = b.many(b.one(at + 8), "<f4", b.one(at + 4)) if kind == 3 else b.many(at + 4, "<f4", kind - 1)
        c.knots, c.controls = np.zeros(1, np.float32), flat[None]
    elif kind in (6, 7):
        n = b.one(at + 4) // 2 or dim
        both = b.many(b.one(at + 8), "<f4", 2 * n)
        knots, raw = b.knots_and_controls(b.one(at + 12 + p), "<u2" if kind == 6 else "<u1", b.one(at + 8 + p), n)
        c.knots = knots * _knot_scale(b.one(at + 2, "H"))
        c.controls = both[n:] + both[:n] * raw if len(both) == 2 * n else raw[:0]
    elif kind in (8, 9):
        knots, raw = b.knots_and_controls(b.one(at + 12), "<u2" if kind == 8 else "<u1", b.one(at + 8), 3)
        c.knots = knots * (np.float32(1) / np.float32(s) if (s := b.one(at + 4, "f")) else np.float32(0))
        c.controls = _smallest_three(raw.astype(np.int64), b.one(at + 2, "H"), 15 if kind == 8 else 7)
    elif kind in PACKED:
        form, per, numbers, wide = PACKED[kind]
        scales, offsets, end = b.many(at + 4, "<f4", wide), b.many(at + 4 + 4 * wide, "<f4", wide), at + 4 + 8 * wide
        knots, raw = b.knots_and_controls(b.one(end + 4), form, b.one(end), per)
        c.knots = knots if form == "<f4" else knots * _knot_scale(b.one(at + 2, "H"))
        c.controls = got = offsets + scales * raw if len(offsets) == wide else raw[:0]
        if numbers == 9:
            c.controls = np.zeros((len(got), 9), np.float32)
            c.controls[:, ::4] = got
    else:
        c = Curve(IDENTITY, 0)
    return c


def _rows(flat: np.ndarray, dim: int) -> np.ndarray:
    dim = max(int(dim), 1)
    return flat[: len(flat) // dim * dim].reshape(-1, dim)


#: The curves of a track in the order they are stored, and their numbers.
SLOTS = (("orientation", 4), ("position", 3), ("scale_shear", 9))


def clip_header(data: bytes, pointer: int) -> dict | None:
    """Name, duration, time step and oversampling of a clip's blob."""
    b = Blob(data, pointer)
    if len(data) < 3 * pointer + 4:
        return None
    return {"name": b.text(b.one(0)), "duration": b.one(pointer, "f"), "step": b.one(pointer + 4, "f"), "oversampling": b.one(pointer + 8, "f")}


def tracks(data: bytes, pointer: int) -> list[tuple[int, str, dict[str, Curve]]]:
    """(place, name, curves by slot) of all tracks of all groups of a clip's blob."""
    b, p, out = Blob(data, pointer), pointer, []
    if len(data) < 3 * p + 4:
        return out
    groups = b.one(p + 16)
    for g in range(min(b.one(p + 12), len(data) // p) if groups else 0):
        group = b.one(groups + p * g)
        first, size = b.one(group + 2 * p + 8), 7 * p + 4
        for t in range(first, min(first + size * b.one(group + 2 * p + 4), len(data)), size) if group and first else ():
            found = {name: curve(b, b.one(t + 4 + 2 * p * (k + 1)), dim) for k, (name, dim) in enumerate(SLOTS)}
            out.append((len(out), b.text(b.one(t)), found))
    return out
