"""Curves of every format, and scene rows' odd cases. The tables themselves are queried over an archive in plans/."""

import struct

import numpy as np
import pytest

from lodework.functions import curves, scenes

ONE = 0x3F80  # the upper half of 1.0
HALF = np.float32(np.sqrt(0.5))


def read(body, dim, pointer=4):
    return curves.curve(curves.Blob(b"pad!" + body, pointer), 4, dim)


def numbers(*values, form="H"):
    return struct.pack(f"<{len(values)}{form}", *values)


@pytest.mark.parametrize("pointer", [4, 8])
def test_plain_formats(pointer):
    wide = "Q" if pointer == 8 else "I"
    c = read(struct.pack("<BBHI" + wide, 0, 1, 2, 4, 8 + 4 + pointer) + numbers(1, 2, 3, 4, form="f"), 3, pointer)
    assert c.controls.tolist() == [[1, 2], [3, 4]] and len(c.knots) == 0
    head = struct.pack(f"<BBHI{wide}I{wide}", 1, 2, 0, 2, 4 + 12 + 2 * pointer, 6, 4 + 12 + 2 * pointer + 8)
    c = read(head + numbers(0, 1, form="f") + numbers(*range(6), form="f"), 3, pointer)
    assert c.knots.tolist() == [0, 1] and c.controls.tolist() == [[0, 1, 2], [3, 4, 5]] and c.degree == 2
    assert read(b"\2\0\0\0", 4, pointer).controls.size == 0
    c = read(struct.pack("<BBHI" + wide, 3, 0, 0, 2, 4 + 8 + pointer) + numbers(5, 6, form="f"), 3, pointer)
    assert c.controls.tolist() == [[5, 6]] and c.knots.tolist() == [0]
    assert read(b"\4\0\0\0" + numbers(1, 2, 3, form="f"), 3).controls.tolist() == [[1, 2, 3]]
    assert read(b"\5\0\0\0" + numbers(1, 2, 3, 4, form="f"), 4).controls.tolist() == [[1, 2, 3, 4]]


@pytest.mark.parametrize("kind,form", [(6, "H"), (7, "B")])
@pytest.mark.parametrize("pointer", [4, 8])
def test_scaled_by_a_table(kind, form, pointer):
    wide, table = "Q" if pointer == 8 else "I", 4 + 12 + 2 * pointer
    head = struct.pack(f"<BBHI{wide}I{wide}", kind, 1, ONE, 4, table, 6, table + 16)
    c = read(head + numbers(2, 3, 10, 20, form="f") + numbers(0, 4, 1, 2, 3, 4, form=form), 3, pointer)
    assert c.knots.tolist() == [0, 4] and c.controls.tolist() == [[12, 26], [16, 32]]


@pytest.mark.parametrize("kind,form,per", [(10, "H", 3), (11, "B", 3), (13, "H", 3), (15, "B", 3), (16, "f", 1), (17, "H", 1), (18, "B", 1)])
def test_three_scales(kind, form, per):
    head = struct.pack("<BBH", kind, 2, ONE) + numbers(1, 2, 3, 10, 20, 30, form="f") + struct.pack("<II", 2 + 2 * per, 4 + 36)
    raw = [[1, 1, 1], [2, 3, 4]] if per == 3 else [[1], [5]]
    c = read(head + numbers(0, 7, *sum(raw, []), form=form), 3)
    want = np.array([10, 20, 30]) + np.array([1, 2, 3]) * np.array(raw)
    assert c.knots.tolist() == [0, 7]
    assert np.array_equal(c.controls, np.array([np.diag(w).ravel() for w in want]) if kind in (13, 15) else want)


@pytest.mark.parametrize("kind,form", [(12, "H"), (14, "B")])
def test_one_scale(kind, form):
    c = read(struct.pack("<BBHffII", kind, 1, ONE, 2, 1, 4, 4 + 20) + numbers(0, 3, 1, 2, form=form), 9)
    assert c.knots.tolist() == [0, 3] and c.controls[:, [0, 4, 8]].tolist() == [[3] * 3, [5] * 3] and c.controls.sum() == 24


@pytest.mark.parametrize("kind,form,bits", [(8, "H", 15), (9, "B", 7)])
def test_quaternions(kind, form, bits):
    top, full = 1 << bits, (1 << bits) - 1
    # the whole range at its ends is -+ one over the root of two; the fourth component is left out, once negative
    rows = [top | 0, full | top, 0 | top], [0 | 0, 0 | top, 0 | top]
    c = read(struct.pack("<BBHfII", kind, 2, 0, 2.0, 8, 4 + 16) + numbers(0, 4, *rows[0], *rows[1], form=form), 4)
    assert c.knots.tolist() == [0, 2]
    assert np.allclose(c.controls[0], [-HALF, HALF, -HALF, 0], atol=1e-6)
    assert np.allclose(c.controls[1], [-HALF, -HALF, -HALF, 0], atol=1e-6)
    entries = 0x7777  # components from zero up to a quarter
    c = read(struct.pack("<BBHfII", kind, 2, entries, 1.0, 8, 4 + 16) + numbers(0, 1, top, 0, 0, 0, 0, top, form=form), 4)
    assert np.allclose(c.controls, [[-1, 0, 0, 0], [0, 1, 0, 0]])


def test_damaged_curves_and_clips():
    rng = np.random.default_rng(5)
    for kind in range(256):
        for pointer in (4, 8):
            body = bytes([kind]) + rng.bytes(int(rng.integers(0, 60)))
            c = read(body, 3, pointer)
            assert c.controls.ndim == 2
    assert curves.tracks(b"", 8) == [] and curves.clip_header(b"x", 4) is None
    for _ in range(200):
        curves.tracks(rng.bytes(120), 4)
        data = b"PF\4\0\0\0\x0c\0" + [b"PIMG", b"cntc"][_ % 2] + [b"PGTB", b"Main"][_ % 2] + struct.pack("<IHHI", 180, 3, 16, 0) + rng.bytes(160)
        for rows_of in (scenes.page_rows, scenes.store_rows, scenes.store_name_rows, scenes.store_asset_rows):
            rows_of(data)


def test_no_scene():
    for name, (rows_of, _) in scenes.TABLES.items():
        for data in (b"", b"PF", b"PF\4\0\0\0\x0c\0MODL", bytes(64)):
            assert rows_of(data, {}) == [], name
    assert scenes.region_rows(b"MZ" + bytes(100), 0, 0) == []


def test_regions():
    shader = b"VSH\x05" + struct.pack("<IHI4sBH", 7, 0, 4, b"DXBC", 0, 0)
    pe, sections = 64, 3
    head = bytearray(b"MZ" + bytes(58) + struct.pack("<I", pe) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, sections, 0, 0, 0, 40, 0) + struct.pack("<H", 0x20B) + bytes(22) + struct.pack("<Q", 0x10000) + bytes(8))
    body, table = b"", b""
    start = len(head) + 40 * sections
    for k in range(sections):
        part = b"--" + (shader if k < 2 else b"CSH" + shader[3:])
        table += struct.pack("<8sIIII16s", b".s%d" % k, len(part), 0x1000 * (k + 1), len(part), start + len(body), b"")
        body += part
    got = scenes.region_rows(bytes(head) + table + body, 0x11800, 0x20000)
    assert [(r[2], r[3], r[4]) for r in got] == [(0x11002, "V", "material"), (0x12002, "V", "engine"), (0x13002, "C", "compute")]
