"""The archive engine on an archive of our own making: source, decoding, index, queries."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodework.functions.classify import index_kind, looks_like_text, sniff
from lodework.functions.inflate import BadStream, declared_size, deflate, inflate, strip_checksums
from lodework.functions.packfile import chunks, file_id, parse_linear, parse_packfile, variant
from lodework.functions.strtable import records, unpack, write_table
from lodework.operators.api import Archive, Index
from lodework.operators.index import build_index, half_size_siblings, plain
from lodework.sources.archive import BadArchive, read_archive, write_archive

REGISTRY = {
    "chunks": {"GEOM": {"1": "ModelGeom1"}, "SKEL": {"2": "Skel2"}},
    "fileTypes": {"MODL": {"GEOM": {"7": "OwnGeom7"}}},
    "types": {"OwnGeom7": {"fields": [{"name": "n", "kind": "dword"}]}},
}


def packfile(container: bytes, *parts: tuple[bytes, int, bytes], version: int = 4) -> bytes:
    out = struct.pack("<2sHHH4s", b"PF", version, 0, 12, container)
    for name, v, body in parts:
        out += struct.pack("<4sIHHI", name, 8 + len(body), v, 16, 0) + body
    return out


def stored(data: bytes) -> bytes:
    """Plain bytes as they lie in an archive: four more for each checksum."""
    step = 0x10000 - 4
    return b"".join(data[i : i + step] + b"\0\0\0\0" for i in range(0, len(data), step)) or b"\0\0\0\0"


def packed(data: bytes) -> bytes:
    return stored(struct.pack("<II", 8, len(data)) + deflate(data))


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("arc") / "a.dat")
    model = packfile(b"MODL", (b"GEOM", 7, struct.pack("<I", 5)), (b"SKEL", 9, b"abcd"))
    blobs = [
        (stored(model), 0),  # base 3
        (stored(packfile(b"ABIX", (b"GEOM", 1, b"x" * 8))), 0),
        (stored(write_table(["Alpha", "beta", "Gamma"])), 0),
        (packed(b"some plain text, some plain text " * 20), 8),
        (stored(b"\xff" * 40), 8),  # flagged, but no stream
        (b"\1\2\3\4\5\6\7", 8),  # flagged, with too few bytes
        (b"", 0),
        (stored(b"ATEXDXT5" + struct.pack("<HH", 64, 64)), 0),
        (stored(b"ATEXDXT5" + struct.pack("<HH", 32, 32)), 0),
    ]
    write_archive(path, blobs, [(100, 3), (101, 3), (7000, 4), (55, 5)])
    return path


@pytest.mark.parametrize("size,want", [(0, 0), (3, 3), (4, 4), (5, 1), (65535, 65531), (65536, 65532), (65537, 65529), (65540, 65532), (131071, 131063), (131072, 131060), (196708, 196692)])
def test_strip(size, want):
    assert len(strip_checksums(bytes(size))) == want


@pytest.mark.parametrize("size,want", [(0, 4294967292), (3, 4294967295), (4, 0), (5, 1), (65535, 65531), (65536, 65532), (65537, 65529), (65540, 65520), (131071, 4294836223), (131072, 131068), (196708, 196304)])
def test_declared_size(size, want):
    assert declared_size(size, 0) == want
    assert declared_size(size, 8) == 0


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.booleans())
def test_inflate_round_trip(data, copies):
    assert inflate(deflate(data, copies), len(data)) == data


def test_inflate_refuses():
    with pytest.raises(BadStream):
        inflate(b"\xff" * 40, 100)
    with pytest.raises(BadStream):
        inflate(b"", 1 << 40)


def test_strip_undoes_stored():
    data = bytes(range(256)) * 700
    assert strip_checksums(stored(data)) == data


def test_classifiers_differ_where_they_should():
    assert index_kind(b"\xff\xd8\0\0")[1] == "jpeg" and sniff(b"\xff\xd8\0\0")["type"] == "binary"
    assert index_kind(b"MZ\0\0")[1] == "exe" and index_kind(b"ab")[1] == "empty"
    assert sniff(b"CTTXDXT1")["format"] == "DXT1"
    assert looks_like_text(b"hello\n") and not looks_like_text(b"\0" * 10)


def test_chunks_and_variants():
    data = packfile(b"MODL", (b"GEOM", 7, b"1234"), (b"ODD\x01", 3, b""))
    assert [(c[1], c[2], c[3]) for c in chunks(data)] == [("GEOM", 7, 12), ("ODD.", 3, 8)]
    assert variant(REGISTRY, "MODL", "GEOM", 7) == "OwnGeom7"
    assert variant(REGISTRY, "XXXX", "GEOM", 7) == "?v7"
    assert variant(REGISTRY, "XXXX", "GEOM", 1) == "ModelGeom1"
    assert variant(REGISTRY, "MODL", "NOPE", 1) == ""


def test_tree_with_wide_and_narrow_pointers():
    def buffer(version):
        b = bytearray(72)
        struct.pack_into("<2sHHH4s", b, 0, b"PF", version, 0, 12, b"TEST")
        struct.pack_into("<4sIHHI", b, 12, b"TEST", 52, 0, 16, 44)
        struct.pack_into("<IfIQQ", b, 28, 0x11223344, 1.5, 3, 24, 20)
        b[64:67] = bytes([10, 20, 30])
        struct.pack_into("<HH", b, 68, 0xAAAA, 0xBBBB)
        return bytes(b)

    types = {
        "Root": {"fields": [{"name": "a", "kind": "dword"}, {"name": "b", "kind": "float"}, {"name": "arr", "kind": "array_ptr", "element": "byte"}, {"name": "sub", "kind": "ptr", "target": {"struct": "Sub"}}]},
        "Sub": {"fields": [{"name": "x", "kind": "word"}, {"name": "y", "kind": "word"}]},
    }
    reg = {"chunks": {"TEST": {"0": "Root"}}, "types": types}
    got = {r[4]: r[8] for r in parse_packfile(buffer(4), reg)}
    assert (got["a"], got["b"], got["arr[2]"], got["x"], got["y"]) == ("287454020", "1.500000", "30", "43690", "48059")
    assert {r[4]: r[8] for r in parse_packfile(buffer(0), reg)}["sub"] == "(null)"
    with pytest.raises(ValueError):
        parse_packfile(b"nope", reg)


def test_linear_template():
    t = {"magic": "ABCD", "fields": [{"name": "magic", "type": "char", "count": 4}, {"name": "n", "type": "uint8"}, {"name": "v", "type": "uint16", "count": "n"}, {"name": "s", "type": "cstring"}, {"name": "q", "type": "int32"}]}
    got = {r[4]: r[8] for r in parse_linear(b"ABCD\2\1\0\2\0hi\0\xff", t)}
    assert got == {"root": "", "magic": "ABCD", "n": "2", "v": "[1, 2]", "s": "hi", "q": "<eof>"}


def test_references():
    assert file_id((0x100, 0x100, 0, 0)) == (1, 0)
    assert file_id((0xFF, 0x100, 0, 0)) == (0, 0)
    assert file_id((0x200, 0x101, 0x10, 0)) == (0, 0)


def test_string_table():
    table = write_table(["a😀", "", "x\0"])
    assert [r[-1] for r in records(table)] == ["a😀", "", "x\0"]
    assert list(records(b"nope" + table[4:])) == []
    assert len(list(records(table + b"\3\0\0\0\0\0"))) == 3
    assert unpack(bytes([0b00100001, 0]), 65, 8) == "B"


def test_source(spark, archive):
    mft = read_archive(spark, archive, rows=4)
    assert mft.count() == 11
    assert [r.base_id for r in mft.where("base_id between 5 and 6").orderBy("base_id").collect()] == [5, 6]
    assert mft.where("comp_flag = 8").count() == 3
    assert {(r.file_id, r.base_id) for r in read_archive(spark, archive, "file_ids").collect()} == {(100, 3), (101, 3), (7000, 4), (55, 5)}
    assert read_archive(spark, archive, "header").first().mft_entries == 11


def test_source_refuses(spark, tmp_path):
    bad = tmp_path / "bad.dat"
    bad.write_bytes(b"short")
    with pytest.raises(Exception, match="shorter"):
        read_archive(spark, str(bad)).count()
    assert issubclass(BadArchive, ValueError)


def test_index_and_queries(spark, archive, tmp_path):
    index = str(tmp_path / "idx")
    assert build_index(spark, archive, index, REGISTRY) == {"processed": 11, "entries": 11, "skipped": 0}
    assert build_index(spark, archive, index, REGISTRY)["processed"] == 0
    ix = Index(spark, index)
    e = {r.base_id: r for r in ix.entries.collect()}
    assert (e[3].type, e[3].container, e[6].type, e[6].actually_compressed) == ("packfile", "MODL", "binary", 1)
    assert (e[7].error, e[7].actually_compressed) == ("flagged-compressed-but-not", 0)
    assert (e[8].error, e[8].actually_compressed, e[9].type, e[9].size_final) == ("", 0, "empty", 0)
    one = ix.lookup(file_id=101)
    assert one["file_ids"] == [100, 101] and [c["struct_variant"] for c in one["chunks"]] == ["OwnGeom7", "?v9"]
    assert ix.stats()["false_compressed"] == 2
    assert ix.query_page(type="packfile")[0] == 2
    assert ix.find_chunk_page("GEOM")[0] == 2
    assert {tuple(r)[:4] for r in ix.chunk_variants("GEOM").collect()} == {("MODL", "GEOM", 7, "OwnGeom7"), ("ABIX", "GEOM", 1, "ModelGeom1")}
    assert [r.base_id for r in ix.base_ids(ident=55).collect()] == [5]
    assert {(r.namespace, r.id) for r in ix.search_ids(10).collect()} == {("base", 10), ("file", 100), ("file", 101)}
    assert ix.search_ids(0).count() == 15
    with pytest.raises(KeyError):
        ix.lookup(base_id=999)
    with pytest.raises(ValueError):
        ix.lookup()
    with pytest.raises(FileNotFoundError):
        Index(spark, str(tmp_path / "none"))


def test_index_updates(spark, tmp_path):
    path, index = str(tmp_path / "b.dat"), str(tmp_path / "idx")
    base = [(stored(b"one one one"), 0), (stored(b"two two two"), 0), (stored(b"gone gone"), 0)]
    write_archive(path, base, [(10, 3)])
    build_index(spark, path, index)
    write_archive(path, [base[0], (stored(b"TWO two TWO two"), 0)], [(10, 3), (11, 4)])
    got = build_index(spark, path, index)
    assert got["entries"] == 5 and got["processed"] >= 1
    assert Index(spark, index).entries.where("base_id = 5").count() == 1  # vanished entries stay unless asked
    got = build_index(spark, path, index, reconcile=True)
    ix = Index(spark, index)
    assert got["entries"] == 4 and {(r.file_id, r.base_id) for r in ix.file_ids.collect()} == {(10, 3), (11, 4)}


def test_archive_reads(spark, archive):
    a = Archive(spark, archive)
    assert a.info()["file_ids"] == 4
    assert a.sniff(6)["type"] == "binary" and a.sniff(10)["format"] == "DXT5"
    assert [r.text for r in a.string_page(5, contains="a", only_confirmed=True).collect()] == ["Alpha", "beta", "Gamma"]
    assert [r.base_id for r in a.scan(b"plain text").collect()] == [6]
    assert {(r.namespace, r.base_id) for r in a.resolve(55).collect()} == {("file", 5)}
    assert a.names().where("base_id = 3").first().shown == "100,101"
    nodes = a.trees(REGISTRY, a.blobs(a.mft.where("base_id = 3")))
    assert nodes.where("name = 'n'").first().value == "5"


def test_half_size(spark):
    t = spark.createDataFrame([(1, "D", 64, 64), (2, "D", 32, 32), (3, "D", 64, 64), (9, "D", 32, 32)], "base_id long, format string, width int, height int")
    assert {(r.base_id, r.full_id) for r in half_size_siblings(t).collect()} == {(2, 1), (2, 3)}


def test_plain_keeps_stored_bytes_of_false_streams():
    assert plain(stored(b"\xff" * 40), 8)[1:] == (0, 40, "flagged-compressed-but-not")


def test_command_line(spark, archive, tmp_path):
    import json

    from lodework.cli import run

    reg = tmp_path / "reg.json"
    reg.write_text(json.dumps(REGISTRY))
    index, out = str(tmp_path / "idx"), str(tmp_path / "out.bin")
    assert run(spark, ["index", archive, "--out", index, "--registry", str(reg)])["processed"] == 11
    assert run(spark, ["info", archive])["mft_entries"] == 11
    assert len(run(spark, ["list", archive, "--limit", "3", "--offset", "9"])["entries"]) == 2
    assert run(spark, ["extract", archive, "--file-id", "7000", "--out", out])["bytes"] == 36
    assert run(spark, ["parse", archive, "--base-id", "3", "--registry", str(reg)])["tree"]["children"][1]["name"] == "GEOM v7"
    assert run(spark, ["texture", archive, "--base-id", "10"])["header"]["format"] == "DXT5"
    assert run(spark, ["find-chunk", index, "--fourcc", "GEOM"])["total"] == 2
    assert run(spark, ["stats", index])["entries"] == 11
    assert not run(spark, ["sniff", archive, "--base-id", "999"])["ok"]
    assert not run(spark, ["nonsense", archive])["ok"]
    assert not run(spark, ["extract", archive, "--out", out])["ok"]
