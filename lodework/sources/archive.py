"""The archive as a Spark data source: spark.read.format("archive").option("table", ...).load(path).

Tables: header (one row), mft (a row an entry: index, base_id = index + 1, place, sizes, flags), file_ids (file_id,
base_id). Catalog scans read no blob. Rows are dealt in ranges of the catalog, and the options first and last cut them
to a range of rows. Filters are not pushed into the reader: Spark keeps one state of pushed filters for all scans of a
loaded frame, so a frame used twice in a plan would lose rows or conditions."""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD, TABLE_HEAD, ENTRY = struct.Struct("<B3sIIIIIQII"), struct.Struct("<4sQIII"), struct.Struct("<QIHHII")
ENTRIES = np.dtype([("offset", "<u8"), ("size", "<u4"), ("comp_flag", "<u2"), ("entry_flag", "<u2"), ("counter", "<u4"), ("crc", "<u4")])
PAIRS = np.dtype([("file_id", "<u4"), ("base_id", "<u4")])

SCHEMAS = {
    "header": "version int, id string, header_size long, chunk_size long, crc long, mft_offset long, mft_size long, flag long, mft_entries long, file_size long",
    "mft": "mft_index long, base_id long, offset long, size long, comp_flag int, entry_flag int, counter long, crc long, mft_usize long",
    "file_ids": "file_id long, base_id long",
}


class BadArchive(ValueError):
    """The file isn't an archive, or its catalog doesn't hold together."""


def open_catalog(path: str) -> tuple[tuple, int, int]:
    """(header fields, where the catalog's entries begin, how many there are)."""
    with open(path, "rb") as f:
        raw = f.read(HEAD.size)
        if len(raw) < HEAD.size:
            raise BadArchive(f"{path}: shorter than an archive's header")
        head = HEAD.unpack(raw)
        f.seek(head[7])
        raw = f.read(TABLE_HEAD.size)
        if len(raw) < TABLE_HEAD.size:
            raise BadArchive(f"{path}: the catalog lies beyond the end")
        # the count includes the slot that the catalog's own header takes
        n = TABLE_HEAD.unpack(raw)[2]
        if n == 0:
            raise BadArchive(f"{path}: an empty catalog")
        start = head[7] + TABLE_HEAD.size
        n = min(n - 1, (os.path.getsize(path) - start) // ENTRY.size)
        if n < 2:
            raise BadArchive(f"{path}: fewer than two entries")
    return head, start, n


def read_slice(path: str, offset: int, size: int) -> bytes:
    """Exactly these bytes, or an error."""
    with open(path, "rb") as f:
        f.seek(offset)
        raw = f.read(size)
    if len(raw) != size:
        raise EOFError(f"{len(raw)} of {size} bytes at {offset}")
    return raw


@dataclass
class Range(InputPartition):
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int, first: int, last: int):
        self.path, self.table, self.rows, self.first, self.last = path, table, rows, first, last

    def partitions(self) -> list[Range]:
        _, start, n = open_catalog(self.path)
        if self.table == "header":
            return [Range(0, 1)]
        if self.table == "file_ids":
            n = self._id_map(start)[1] // PAIRS.itemsize
        lo, hi = max(0, self.first), min(n, self.last + 1)
        return [Range(a, min(a + self.rows, hi)) for a in range(lo, hi, self.rows)] or [Range(0, 0)]

    def _id_map(self, start: int) -> tuple[int, int]:
        """Where the id map's bytes are: the payload of entry 1, which carries no checksums."""
        offset, size, *_ = ENTRY.unpack(read_slice(self.path, start + ENTRY.size, ENTRY.size))
        return offset, min(size, max(0, os.path.getsize(self.path) - offset))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        head, start, n = open_catalog(self.path)
        if self.table == "header":
            row = (head[0], head[1].decode("latin-1"), head[2], head[4], head[5], head[7], head[8], head[9], n, os.path.getsize(self.path))
            names = [c.split(" ")[0] for c in SCHEMAS["header"].split(", ")]
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)
            return
        if part.start >= part.end:
            return
        if self.table == "file_ids":
            at, _ = self._id_map(start)
            got = np.frombuffer(read_slice(self.path, at + part.start * PAIRS.itemsize, (part.end - part.start) * PAIRS.itemsize), PAIRS)
            yield pa.RecordBatch.from_arrays([pa.array(got[c].astype(np.int64)) for c in ("file_id", "base_id")], names=["file_id", "base_id"])
            return
        got = np.frombuffer(read_slice(self.path, start + part.start * ENTRY.size, (part.end - part.start) * ENTRY.size), ENTRIES)
        index = np.arange(part.start, part.end)
        size = got["size"].astype(np.int64)
        # what the catalog declares for stored entries, in 32 bits
        usize = np.where(size > 0x10000, size - 4 * (size % 0x10000 + 1), size - 4) & 0xFFFFFFFF
        cols = {"mft_index": index, "base_id": index + 1, **{c: got[c].astype(np.int64) for c in ENTRIES.names}, "mft_usize": np.where(got["comp_flag"] != 0, 0, usize)}
        names = [c.split(" ")[0] for c in SCHEMAS["mft"].split(", ")]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[c], k) for c, k in zip(names, kinds, strict=True)], names=names)


class ArchiveSource(DataSource):
    """Options: table (header, mft or file_ids), rows (entries in a partition), first and last (row numbers, inclusive)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def _table(self) -> str:
        table = self.options.get("table", "mft")
        if table not in SCHEMAS:
            raise ValueError(f"no table {table}; there are {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema: object) -> DataSourceReader:
        return ArchiveReader(self.options["path"].removeprefix("file:"), self._table(), int(self.options.get("rows", 65536)), int(self.options.get("first", 0)), int(self.options.get("last", 1 << 62)))


def read_archive(spark: SparkSession, path: str, table: str = "mft", rows: int = 65536, first: int = 0, last: int = 1 << 62) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("table", table).option("rows", rows).option("first", first).option("last", last).load(path)


class Slices:
    """Random reads from one archive, mapped once a task."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115  closed with the mapping
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)

    def __call__(self, offset: int, size: int) -> bytes:
        raw = self.map[offset : offset + size]
        if len(raw) != size:
            raise EOFError(f"{len(raw)} of {size} bytes at {offset}")
        return raw

    def close(self) -> None:
        self.map.close()
        self.file.close()


def write_archive(path: str, blobs: list[tuple[bytes, int]], file_ids: list[tuple[int, int]]) -> None:
    """An archive with these stored bytes and flags, for fixtures. Entry 0 is the archive's own header, 1 the id map."""
    pairs = b"".join(struct.pack("<II", *p) for p in file_ids)
    stored = [(b"\0" * HEAD.size, 0), (pairs, 0), *blobs]
    at, body, rows = HEAD.size, [], [(0, HEAD.size, 0, 0, 0, 0)]
    for raw, flag in stored[1:]:
        rows.append((at, len(raw), flag, 1, 0, (sum(raw) * 2654435761) & 0xFFFFFFFF))
        body.append(raw)
        at += len(raw)
    head = HEAD.pack(151, b"AN\x1a", HEAD.size, 0, 512, 0, 0, at, TABLE_HEAD.size + ENTRY.size * len(rows), 0)
    with open(path, "wb") as f:
        f.write(head + b"".join(body) + TABLE_HEAD.pack(b"Mft\x1a", 0, len(rows) + 1, 0, 0) + b"".join(ENTRY.pack(*r) for r in rows))
