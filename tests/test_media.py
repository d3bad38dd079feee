"""Blob parsers: audio, shaders, textures, tokens, text inputs and sinks."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodework.functions import columns as C
from lodework.functions import media as M
from lodework.sources import sinks, texts

FRAME = b"\xff\xfb\x90\x00" + bytes(417 - 4)  # MPEG 1 layer III, 128 kbit/s, 44.1 kHz


def test_audio():
    assert M.frame(FRAME, 0)[:3] == (417, 44100, 2)
    bank = b"PF" + bytes(10) + b"head" + FRAME * 4 + b"gap.gap." + FRAME * 3 + b"x" + FRAME * 2
    assert [(c[1], c[2], c[3], c[4]) for c in M.clips(bank)] == [("sound 1", "mp3", 16, 1668), ("sound 2", "mp3", 1692, 1251)]
    assert M.clips(b"zzOggSrest")[0][2:] == ("ogg", 2, 8)
    assert M.clips(b"RIFF1234WAVE")[0][2] == "wav" and M.clips(b"") == []
    assert M.probe_audio(bank)["seconds"] == round(4 * 1152 / 44100, 3)


def blob(stage=b"FSH", version=11, names=(b"World", b"LightBuffer"), code=b"DXBCcode"):
    out = stage + bytes([version]) + struct.pack("<II", 1, 2) + struct.pack("<H", len(names))
    for n in names:
        out += bytes([len(n)]) + n + struct.pack("<BBHHHH", 2 | 16, 1, 0, 1, 0, 0)
    return out + struct.pack("<I", len(code)) + code + bytes([2]) + struct.pack("<HHH", 1, 2, 64)


def test_shaders(spark):
    data = b"junkVSH" + blob() + b"more" + blob(b"VSH", names=(b"ViewProjection",))
    got = M.shader_rows(data)
    assert [(r[2], r[9]) for r in got] == [("F", "ps-lit (LightBuffer)"), ("V", "vs-depth/shadow (camera-only)")]
    assert M.shader(blob(code=b"nope")) is None and M.shader(blob()[:-3]) is None and M.shader(b"VSH") is None
    df = spark.createDataFrame([(1, bytearray(data)), (2, None)], "base_id long, data binary")
    assert M.explode_blobs(df, M.shader_rows, M.SHADER).count() == 2


def test_tokens():
    assert M.token_name(0x30000000 + 1) == "b" and M.token_name(0x30000000) == ""
    assert M.bone_token("Rig:bone:ab") == M.bone_token("ab") == 1 | 2 << 5
    assert M.bone_token("a12") >> 60 == (50 + 10 * 49) & 15
    assert M.vertex_layout(0x1 | 0x8 | 0x10000) == ([("position float3", 12, 0), ("normal float3", 12, 12), ("uv0 half2", 4, 24)], 28)
    assert M.vertex_layout(0x10000001)[1] == 6


def test_textures():
    body = struct.pack("<II", 16, 0) + bytes(8)
    data = b"ATEXDXT1" + struct.pack("<HH", 4, 4) + body + body
    assert M.texture_header(data) == {"magic": "ATEX", "format": "DXT1", "width": 4, "height": 4}
    assert [m[:3] for m in M.texture_mips(data)] == [(0, 4, 4), (1, 2, 2)]
    red = struct.pack("<HHI", 0xF800, 0x001F, 0)
    assert (M.decode_blocks("DXT1", red, 4, 4) == [255, 0, 0, 255]).all()
    clear = struct.pack("<HHI", 0x001F, 0xF800, 0xFFFFFFFF)
    assert (M.decode_blocks("DXT1", clear, 3, 2)[..., 3] == 0).all()
    alpha = bytes([200, 100]) + bytes(6) + red
    assert (M.decode_blocks("DXT5", alpha, 4, 4) == [255, 0, 0, 200]).all()
    flat = bytes([128, 127]) + bytes(6)
    assert (M.decode_blocks("3DCX", flat * 2, 4, 4)[..., 2] >= 254).all()
    assert (M.decode_blocks("3DCX", (bytes([255, 0]) + bytes(6)) * 2, 4, 4)[..., 2] == 128).all()
    assert (M.decode_blocks("DXTA", red, 4, 4) == 255).all()
    with pytest.raises(ValueError):
        M.decode_blocks("XXXX", b"", 4, 4)
    raw = M.png(np.zeros((2, 3, 4), np.uint8))
    assert raw[:4] == b"\x89PNG" and len(zlib.decompress(raw[41:-16])) == 2 * 13
    assert M.dds_header(b"DDS " + bytes(80) + b"DXT5" + bytes(60))["format"] == "BC3"


def bits(text: str) -> bytes:
    text = text.replace(" ", "")
    text += "0" * (-len(text) % 32)
    return b"".join(int(text[i : i + 32], 2).to_bytes(4, "little") for i in range(0, len(text), 32))


def level(flags: int, body: bytes) -> bytes:
    return struct.pack("<II", 8 + len(body), flags) + body


def test_texture_inflate():
    red, blue = struct.pack("<HHI", 0xF800, 0x001F, 0), struct.pack("<HHI", 0x001F, 0xF800, 7)
    # two blocks as stored: both endpoints first, then both indices
    plain = b"ATEXDXT1" + struct.pack("<HH", 8, 4) + level(0, red[:4] + blue[:4] + red[4:] + blue[4:])
    assert M.texture_surfaces(plain) == [(0, "DXT1", 8, 4, red + blue)]
    # a run of one that is white, then a run of one that isn't
    white = b"ATEXDXT1" + struct.pack("<HH", 8, 4) + level(1, bits("1 1 1 0") + red)
    assert M.texture_surfaces(white)[0][4] == b"\xff" * 8 + red
    # alpha 200, chosen for a run of one; 0 for the next; colours stored
    alpha = b"ATEXDXT5" + struct.pack("<HH", 8, 4) + level(4, bits("11001000 1 1 1 1 1 0") + red[:4] + blue[:4] + red[4:] + blue[4:])
    assert M.texture_surfaces(alpha)[0][4] == bytes([200, 200]) + bytes(6) + red + bytes(8) + blue
    # one colour over a run of 17 - 15 = 2
    color = b"ATEXDXT1" + struct.pack("<HH", 8, 4) + level(8, bits(f"{0x4080C0:024b} 00 1111 1"))
    px = M.decode_blocks("DXT1", M.texture_surfaces(color)[0][4], 8, 4)
    assert abs(px[..., :3].astype(int) - [0x40, 0x80, 0xC0]).max() <= 2 and (px[..., 3] == 255).all()
    assert M.texture_surfaces(b"ATEXZZZZ" + bytes(20)) == []


@pytest.mark.parametrize("rgb", [(0, 0, 0), (255, 255, 255), (1, 2, 3), (200, 17, 90), (128, 128, 128)])
def test_constant_color(rgb):
    for kind in ("DXT1", "DXT5"):
        block = M.constant_color(*rgb, kind == "DXT1")
        px = M.decode_blocks(kind, (b"" if kind == "DXT1" else bytes(8)) + block, 4, 4)
        assert abs(px[0, 0, :3].astype(int) - rgb).max() <= 4 and (px == px[0, 0]).all()


def test_text_inputs(spark, tmp_path):
    (tmp_path / "keys.csv").write_text("# c\ntextId,key8_hex\n5,aa\n\n0,bb\n4294967295,cc\ntextId,key8_hex\n5,dd\n6,ee\n")
    assert {tuple(r) for r in texts.key_table(spark, str(tmp_path / "keys.csv")).collect()} == {(5, "dd"), (6, "ee")}
    (tmp_path / "ids.txt").write_text("70\n\n71\n")
    assert [tuple(r) for r in texts.ordered_ids(spark, str(tmp_path / "ids.txt")).orderBy("index").collect()] == [(0, 70), (1, 71)]
    (tmp_path / "known.txt").write_text("Maps\n1\tOne\nOther\n2\tTwo words\n")
    assert {tuple(r) for r in texts.curated_ids(spark, str(tmp_path / "known.txt")).collect()} == {("Maps", 1, "One"), ("Other", 2, "Two words")}
    reg = texts.structs_to_registry("struct Sub\n{\n  word x;\n  float y[3];\n};\ntypedef struct {\n dword a;\n} Top;\n")
    assert reg["types"] == {"Sub": {"fields": [{"name": "x", "kind": "word"}, {"name": "y", "kind": "array", "element": "float", "count": 3}]}, "Top": {"fields": [{"name": "a", "kind": "dword"}]}}
    (tmp_path / "r.json").write_text(json.dumps(reg))
    assert texts.load_registry(str(tmp_path / "r.json")) == reg
    assert texts.registry_rows(spark, {"chunks": {"A": {"1": "k"}}, "fileTypes": {"M": {"A": {"2": "o"}}}}).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "base_id long, data binary")
    assert sinks.write_files(df, str(tmp_path / "out")).count() == 1 and (tmp_path / "out/1.bin").read_bytes() == b"abc"
    s = spark.createDataFrame([(1, "DXT1", 4, 4, bytearray(8))], "base_id long, format string, width int, height int, surface binary")
    assert bytes(sinks.images(s).first().png[:4]) == b"\x89PNG"
    v = spark.createDataFrame([(0, 0.0, 1.0, 2.0)], "vertex int, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 0, 0)], "triangle int, a int, b int, c int")
    assert [r.text for r in sinks.obj_lines(v, t).collect()] == ["v 0.000000 1.000000 2.000000", "f 1 1 1"]
    sinks.write_texts(spark.createDataFrame([(2, "b"), (1, 'a"')], "text_id long, text string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).count() == 2


def test_columns(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\xff\x80AB\x00\x07"),)], "b binary")
    got = df.select(C.u16(F.col("b"), 0).alias("h"), C.u32(F.col("b"), 0).alias("w"), C.fourcc(F.col("b"), 4).alias("f")).first()
    assert (got.h, got.w, got.f) == (0x0201, 0x80FF0201, "AB..")


def test_previews_and_raw_files(spark, tmp_path):
    from lodework import cli
    from lodework.functions.preview import preview_kind
    from lodework.functions.strtable import write_table
    from lodework.sources.texts import new_template, templates

    assert [preview_kind(d) for d in (b"", b"\x89PNGxxxxxxxx", b"strs", b"plain text", bytes(40), b"PF\4\0\0\0\x0c\0PIMG")] == ["none", "image", "strings", "text", "none", "atlas"]
    (tmp_path / "t.bin").write_bytes(write_table(["Alpha", "beta"]))
    got = cli.run(spark, ["strings", "--data", str(tmp_path / "t.bin")])
    assert got["ok"] and [r["text"] for r in got["records"]] == ["Alpha", "beta"]
    (tmp_path / "t.txt").write_bytes(b"caf\xe9 au lait")
    assert cli.run(spark, ["preview", "--data", str(tmp_path / "t.txt")]) == {"ok": True, "kind": "text", "text": "café au lait"}
    path = new_template(str(tmp_path / "templates"), "first")
    assert templates(str(tmp_path / "templates")) == {"first": path}
    with pytest.raises(FileExistsError):
        new_template(str(tmp_path / "templates"), "first")
