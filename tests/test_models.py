"""Typed values, vertices, poses and curves."""

import struct

import numpy as np

from lodework.functions import media, models


def test_values():
    reg = {
        "chunks": {"TEST": {"0": "Root"}},
        "types": {
            "Root": {"fields": [{"name": "a", "kind": "dword"}, {"name": "b", "kind": "float"}, {"name": "arr", "kind": "array_ptr", "element": "byte"}, {"name": "sub", "kind": "ptr", "target": {"struct": "Sub"}}]},
            "Sub": {"fields": [{"name": "x", "kind": "word"}, {"name": "y", "kind": "word"}]},
        },
    }
    b = bytearray(72)
    struct.pack_into("<2sHHH4s", b, 0, b"PF", 4, 0, 12, b"TEST")
    struct.pack_into("<4sIHHI", b, 12, b"TEST", 52, 0, 16, 44)
    struct.pack_into("<IfIQQ", b, 28, 0x11223344, 1.5, 3, 24, 20)
    b[64:67] = bytes([10, 20, 30])
    struct.pack_into("<HH", b, 68, 0xAAAA, 0xBBBB)
    want = {"TEST": {"a": 287454020, "b": 1.5, "arr": [10, 20, 30], "sub": {"x": 43690, "y": 48059}}}
    assert models.values(bytes(b), reg) == want
    assert models.values(b"no", reg) == {} and models.values_json(bytes(b), reg)[0][0] == "TEST"


def test_vertices():
    raw = struct.pack("<3f4B4B2e", 1, 2, 3, 10, 20, 30, 40, 0, 1, 2, 3, 0.5, 0.25)
    v = models.vertices(0x1 | 0x2 | 0x4 | 0x10000, raw * 2)
    assert v["position"].tolist() == [[1, 2, 3]] * 2 and v["uv0"].tolist()[0] == [0.5, 0.25]
    assert abs(v["weights"].sum(axis=1) - 1).max() < 1e-6 and v["indices"].tolist()[0] == [0, 1, 2, 3]
    assert models.vertices(0x1 | 0x10000000, struct.pack("<3e", 1, 2, 3))["position"].tolist() == [[1, 2, 3]]
    assert models.vertices(0, b"abc") == {}
    assert media.vertex_layout(0)[1] == 0


def bone(k, parent, p, q=(0, 0, 0, 1), world=None):
    m = np.eye(4)
    if world is not None:
        m[3, :3] = -np.array(world)
    return (k, f"b{k}", parent, list(p), list(q), list(np.eye(3).ravel()), list(m.ravel()) if world is not None else [0.0] * 16)


def test_pose():
    turn = (0, 0, np.sin(np.pi / 4), np.cos(np.pi / 4))
    rig = [bone(0, -1, (1, 0, 0), turn, (1, 0, 0)), bone(1, 0, (2, 0, 0), world=(1, 2, 0)), bone(2, 1, (0, 1, 0), world=(0, 2, 0))]
    assert np.allclose(models.pose(rig), [[1, 0, 0], [1, 2, 0], [0, 2, 0]])
    assert models.bind_errors(rig)["worst"] < 1e-9
    assert np.allclose(models.pose(rig, {"b1": (np.array([3.0, 0, 0]), None, None)})[1], [1, 3, 0])
    assert np.allclose(models.rotation(np.array(turn)) @ [1, 0, 0], [0, 1, 0])
    assert np.allclose(models.rest_positions([bone(0, -1, (1, 1, 1)), bone(1, 0, (1, 0, 0))]), [[1, 1, 1], [2, 1, 1]])
    assert models.bind_errors([])["bones"] == 0


def test_curves():
    knots, line = np.array([0.0, 1, 2, 3]), np.array([[0.0], [10], [20], [30]])
    assert np.allclose(models.sample_curve(knots, line, 1, 1.5), 15)
    assert np.allclose(models.sample_curve(knots, line, 0, 0.5), 10)
    for d in (2, 3):
        assert np.allclose(models.sample_curve(knots, np.full((4, 3), 7.0), d, 1.3), 7)
    assert np.allclose(models.sample_curve(knots[:1], line[:1], 3, 9), 0)
    q = np.array([[0, 0, 0, 1.0], [0, 0, 0, -1.0], [0, 0, 1, 0], [0, 0, 1, 0]])
    assert np.isclose(np.linalg.norm(models.sample_curve(knots, q, 2, 0.7)), 1)


def test_grid():
    assert np.allclose(models.grid_normals(np.zeros((3, 3))), [0, 0, 1])
    x = np.tile(np.arange(4.0), (4, 1))
    assert np.allclose(models.grid_normals(x), np.array([-1, 0, 1]) / np.sqrt(2))
