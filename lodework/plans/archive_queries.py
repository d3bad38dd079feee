"""Queries over a small archive of our own making, each beside the rows that its contents call for.

The archive is written to the folder that driver and executors share, once a session."""

from __future__ import annotations

import atexit
import os
import struct
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import reference_kind
from ..functions.inflate import deflate
from ..functions.media import explode_blobs
from ..functions.preview import preview_kind
from ..functions.strtable import write_table
from ..operators import references
from ..operators.api import Archive
from ..operators.index import decode_entries
from ..operators.relational import fingerprint
from ..sources.archive import write_archive

REGISTRY = {
    "chunks": {"GEOM": {"1": "ModelGeom1"}, "SKEL": {"2": "Skel2"}, "BANK": {"1": "Bank"}},
    "fileTypes": {"MODL": {"GEOM": {"7": "OwnGeom7"}}},
    "types": {"OwnGeom7": {"fields": [{"name": "n", "kind": "dword"}]}, "Bank": {"fields": [{"name": "n", "kind": "dword"}, {"name": "sound", "kind": "filename"}]}},
}


def _packfile(container: bytes, *parts: tuple[bytes, int, bytes]) -> bytes:
    out = struct.pack("<2sHHH4s", b"PF", 4, 0, 12, container)
    for name, version, body in parts:
        out += struct.pack("<4sIHHI", name, 8 + len(body), version, 16, 0) + body
    return out


def _stored(data: bytes) -> bytes:
    step = 0x10000 - 4
    return b"".join(data[i : i + step] + bytes(4) for i in range(0, len(data), step)) or bytes(4)


TEXT = b"some plain text, some plain text " * 20
BLOBS = [
    (_stored(_packfile(b"MODL", (b"GEOM", 7, struct.pack("<I", 5)), (b"SKEL", 9, b"abcd"))), 0),  # base id 3
    (_stored(_packfile(b"ABIX", (b"GEOM", 1, b"x" * 8), (b"ODDS", 1, b""))), 0),
    (_stored(write_table(["Alpha", "beta", "Gamma"])), 0),
    (_stored(struct.pack("<II", 8, len(TEXT)) + deflate(TEXT)), 8),
    (_stored(b"\xff" * 40), 8),  # flagged, but no stream
    (b"\1\2\3\4\5\6\7", 8),  # flagged, with too few bytes
    (b"", 0),
    (_stored(b"ATEXDXT5" + struct.pack("<HH", 64, 64)), 0),
    (_stored(bytes(70_000)), 0),  # more than one window of checksums
    (_stored(_packfile(b"ABNK", (b"BANK", 1, struct.pack("<IQ", 9, 8) + struct.pack("<4H", 50_000 % 0xFF00 + 0xFF, 256, 0, 0)))), 0),
]
IDS = [(100, 3), (101, 3), (7000, 4), (55, 5), (50_000, 6)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(columns: str, *rows: tuple, archive: Callable[[SparkSession], str] | None = None, queries: dict = QUERIES, oracle: dict = ORACLE) -> Callable:
    """columns: names and SQL types; rows: what the query has to give."""
    names, kinds = zip(*(c.split(" ") for c in columns.split(", ")), strict=True)
    shown = ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    sql = f"SELECT {', '.join(f'{n}::{k} AS {n}' for n, k in zip(names, kinds, strict=True))} FROM (VALUES {shown}) v({', '.join(names)})"

    def keep(f: Callable) -> Callable:
        queries[f.__name__] = lambda spark, sf_dir: f(Archive(spark, (archive or fixture)(spark))).select(*names)
        oracle[f.__name__] = sql
        return f

    return keep


def fixture(spark: SparkSession, name: str = "fixture", blobs: list[tuple[bytes, int]] | None = None, ids: list[tuple[int, int]] | None = None) -> str:
    """The archive's path, in the folder of spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder and ":" in folder and not folder.startswith("file:"):
        raise ValueError("an archive has to be in a folder that is mounted everywhere")
    where = "/" + folder.removeprefix("file:").lstrip("/") if folder else tempfile.gettempdir()
    os.makedirs(where, exist_ok=True)
    path = os.path.join(where, f"lodework-{name}-{spark.sparkContext.applicationId}.dat")
    if not os.path.exists(path):
        write_archive(path, blobs or BLOBS, ids or IDS)
        atexit.register(lambda: Path(path).unlink(missing_ok=True))
    return path


@query("version INTEGER, mft_entries BIGINT, header_size BIGINT", (151, 12, 40))
def archive_header(a: Archive) -> DataFrame:
    from ..sources.archive import read_archive

    return read_archive(a.spark, a.path, "header")


@query(
    "mft_index BIGINT, base_id BIGINT, size BIGINT, comp_flag INTEGER, mft_usize BIGINT",
    *[(k, k + 1, size, flag, usize) for k, (size, flag, usize) in enumerate([(40, 0, 36), (40, 0, 36), (56, 0, 52), (56, 0, 52), (len(BLOBS[2][0]), 0, len(BLOBS[2][0]) - 4), (len(BLOBS[3][0]), 8, 0), (44, 8, 0), (7, 8, 0), (0, 0, 4294967292), (16, 0, 12), (70008, 0, 52116), (52, 0, 48)])],
)
def archive_catalog(a: Archive) -> DataFrame:
    return a.mft


@query("file_id BIGINT, base_id BIGINT", *IDS)
def archive_file_ids(a: Archive) -> DataFrame:
    return a.file_ids


@query("base_id BIGINT, shown VARCHAR", (3, "100,101"), (4, "7000"), (5, "55"), (6, "50000"))
def archive_names(a: Archive) -> DataFrame:
    return a.names()


def _decoded(a: Archive) -> DataFrame:
    mft = a.mft.where("base_id > 2").withColumn("fingerprint", fingerprint("offset", "size", "crc", "comp_flag"))
    return decode_entries(mft.withColumn("file_ids", F.array().cast("array<long>")), a.path, REGISTRY)


@query(
    "base_id BIGINT, actually_compressed INTEGER, size_stripped BIGINT, size_final BIGINT, magic VARCHAR, type VARCHAR, container VARCHAR, error VARCHAR",
    (3, 0, 52, 52, "PF..", "packfile", "MODL", ""),
    (4, 0, 52, 52, "PF..", "packfile", "ABIX", ""),
    (5, 0, len(BLOBS[2][0]) - 4, len(BLOBS[2][0]) - 4, "strs", "strs", "", ""),
    (6, 1, len(BLOBS[3][0]) - 4, 660, "some", "binary", "", ""),
    (7, 0, 40, 40, "....", "binary", "", "flagged-compressed-but-not"),
    (8, 0, 3, 3, "", "empty", "", ""),
    (9, 0, 0, 0, "", "empty", "", ""),
    (10, 0, 12, 12, "ATEX", "texture", "", ""),
    (11, 0, 70000, 70000, "....", "binary", "", ""),
    (12, 0, 48, 48, "PF..", "packfile", "ABNK", ""),
)
def archive_entries(a: Archive) -> DataFrame:
    return _decoded(a)


@query(
    "base_id BIGINT, seq INTEGER, fourcc VARCHAR, version INTEGER, struct_variant VARCHAR, chunk_size BIGINT",
    (3, 0, "GEOM", 7, "OwnGeom7", 12),
    (3, 1, "SKEL", 9, "?v9", 12),
    (4, 0, "GEOM", 1, "ModelGeom1", 16),
    (4, 1, "ODDS", 1, "", 8),
    (12, 0, "BANK", 1, "Bank", 28),
)
def archive_chunks(a: Archive) -> DataFrame:
    return _decoded(a).select("base_id", F.explode("chunks").alias("c")).select("base_id", "c.*")


@query("base_id BIGINT, ord INTEGER, confirmed BOOLEAN, text VARCHAR", (5, 0, "true", "Alpha"), (5, 1, "true", "beta"), (5, 2, "true", "Gamma"))
def archive_strings(a: Archive) -> DataFrame:
    return a.strings()


@query("records BIGINT, confirmed BIGINT, packed BIGINT", (3, 3, 0))
def archive_string_counts(a: Archive) -> DataFrame:
    return a.string_counts().drop("base_id")


@query("base_id BIGINT, name VARCHAR, value VARCHAR", (3, "n", "5"), (12, "n", "9"))
def archive_tree_values(a: Archive) -> DataFrame:
    return a.trees(REGISTRY).where("name = 'n'")


@query("base_id BIGINT, file_id BIGINT, to_base BIGINT", (12, 50_000, 6))
def archive_edges(a: Archive) -> DataFrame:
    return references.resolve(references.edges(a.blobs(), REGISTRY), a.file_ids)


@query("base_id BIGINT, kind VARCHAR", (3, "model"), (4, "model"), (5, "strings"), (6, "other"), (7, "other"), (8, ""), (9, ""), (10, "texture"), (11, "other"), (12, "audio"))
def archive_reference_kinds(a: Archive) -> DataFrame:
    return explode_blobs(a.blobs(a.mft.where("base_id > 2")), lambda d: [(reference_kind(d),)], "kind string")


@query("base_id BIGINT, kind VARCHAR", (3, "model"), (4, "model"), (5, "strings"), (6, "text"), (7, "text"), (8, "none"), (9, "none"), (10, "image"), (11, "none"), (12, "audio"))
def archive_previews(a: Archive) -> DataFrame:
    return explode_blobs(a.blobs(a.mft.where("base_id > 2")), lambda d: [(preview_kind(d),)], "kind string")


@query("base_id BIGINT, place BIGINT", (6, 5))
def archive_scan(a: Archive) -> DataFrame:
    return a.scan(b"plain").withColumnRenamed("at", "place")
