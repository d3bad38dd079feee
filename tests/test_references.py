"""References between entries."""

import struct

from lodework.operators import references as R

REG = {"chunks": {"BANK": {"1": "Bank"}}, "types": {"Bank": {"fields": [{"name": "n", "kind": "dword"}, {"name": "sounds", "kind": "array_ptr", "element": {"struct": "Sound"}}]}, "Sound": {"fields": [{"name": "file", "kind": "filename"}]}}}


def bank(*ids):
    body = struct.pack("<I", 9) + struct.pack("<IQ", len(ids), 8)
    words = b"".join(struct.pack("<4H", (i - 1) % 0xFF00 + 0x100, (i - 1) // 0xFF00 + 0x100, 0, 0) for i in ids)
    at = 8 * len(ids)
    body += b"".join(struct.pack("<Q", at - 8 * k + 8 * k) for k in range(len(ids))) + words
    return struct.pack("<2sHHH4s", b"PF", 4, 0, 12, b"ABNK") + struct.pack("<4sIHHI", b"BANK", 8 + len(body), 1, 16, 0) + body


def test_edges():
    got = R.edges_of(bank(50_000, 7, 50_001), REG)
    assert [(e[1], e[3]) for e in got] == [("BANK", 50_000), ("BANK", 7), ("BANK", 50_001)]
    assert got[0][2].endswith("sounds[0].file")
    assert R.edges_of(b"no", REG) == []


def test_lists_and_kinds(spark):
    blobs = spark.createDataFrame([(3, bytearray(bank(50_001, 50_000, 50_001, 7))), (4, bytearray(b"OggS12345678")), (5, bytearray(b"strs12345678"))], "base_id long, data binary")
    ids = spark.createDataFrame([(50_001, 4), (7, 5)], "file_id long, base_id long")
    found = R.resolve(R.edges(blobs, REG), ids)
    assert found.where("to_base = -1").count() == 1
    assert [(r.file_id, r.place) for r in R.asset_list(found).orderBy("place").collect()] == [(50_001, 1), (50_000, 2)]
    kinds = {(r.file_id, r.kind) for r in R.classified(found, blobs).collect()}
    assert kinds == {(50_001, "other"), (50_000, ""), (7, "strings")}


def test_reference_kinds():
    from lodework.functions.classify import reference_kind

    def pf(container, fourcc=b"ABCD"):
        return struct.pack("<2sHHH4s", b"PF", 4, 0, 12, container) + struct.pack("<4sIHHI", fourcc, 8 + 8, 1, 16, 0) + bytes(8)

    want = {b"": "", b"strs": "", b"strs" + bytes(8): "strings", b"DDSx" + bytes(8): "texture", b"ATEX" + bytes(8): "texture", b"CTEX" + bytes(8): "texture", b"CTTX" + bytes(8): "other", b"asnd" + bytes(8): "other", b"OggS" + bytes(8): "other"}
    want |= {pf(b"MODL"): "packfile MODL", pf(b"XXXX", b"GEOM"): "model", pf(b"AMSP"): "audio", pf(b"ABNK"): "audio", pf(b"PIMG"): "image atlas", pf(b"cntc"): "packfile cntc"}
    assert {d: reference_kind(d) for d in want} == want


def test_text_and_effects():
    from lodework.functions.classify import decode_text
    from lodework.functions.media import looks_like_effect

    assert decode_text("é".encode()) == "é" and decode_text(b"\xe9\x80") == "é€" and decode_text(b"") == ""
    assert looks_like_effect(bytes([0, 0, 0, 255]) * 5000) and not looks_like_effect(bytes([200, 10, 10, 255]) * 5000) and not looks_like_effect(b"")
