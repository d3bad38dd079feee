"""The incremental index: catalog and blobs to four Parquet tables, in snapshots.

A run compares the catalog with the last snapshot by fingerprint, decodes what is new or changed once, and writes a
new snapshot of entries, file_ids, chunks and meta; a pointer file names the current one, so readers never see a half
written index. Decoding is dealt by bytes, not rows, and within a task goes through the archive in offset order."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import index_kind
from ..functions.inflate import BadStream, inflate, strip_checksums
from ..functions.packfile import chunks, variant
from ..sources.archive import Slices, open_catalog, read_archive
from .relational import changed, fingerprint

DONE = (
    "base_id long, offset long, size long, comp_flag int, crc long, mft_usize long, fingerprint string, actually_compressed int, size_stripped long, size_final long, magic string, type string, container string, error string, "
    "file_ids array<long>, chunks array<struct<seq:int,fourcc:string,version:int,struct_variant:string,chunk_size:long>>"
)
ENTRY_COLUMNS = [c.split(" ")[0] for c in DONE.split(", ")][:14]
TABLES = ("entries", "file_ids", "chunks", "meta")


def plain(raw: bytes, flag: int) -> tuple[bytes, int, int, str]:
    """(decoded bytes, whether they really were compressed, size without checksums, error) of stored bytes."""
    stripped = strip_checksums(raw)
    if flag and len(stripped) >= 8:
        try:
            return inflate(stripped[8:], int.from_bytes(stripped[4:8], "little")), 1, len(stripped), ""
        except BadStream:
            return stripped, 0, len(stripped), "flagged-compressed-but-not"
    return stripped, 0, len(stripped), ""


def describe(raw: bytes, flag: int, registry: dict) -> tuple:
    """actually_compressed to error, and the chunks, of one entry's stored bytes."""
    data, really, stripped, error = plain(raw, flag)
    magic, kind, container = index_kind(data)
    found = []
    if kind == "packfile" and len(data) >= 12:
        found = [{"seq": k, "fourcc": name, "version": v, "struct_variant": variant(registry, container, name, v), "chunk_size": size} for k, (_, name, v, size, _) in enumerate(chunks(data, "index"))]
    return (really, stripped, len(data), magic, kind, container, error), found


def decode_entries(mft: DataFrame, path: str, registry: dict) -> DataFrame:
    """mft (with fingerprint and file_ids) to rows of DONE. A bad blob becomes an error text, never a failed task."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 4]
    chunk = pa.list_(pa.struct([("seq", pa.int32()), ("fourcc", pa.string()), ("version", pa.int32()), ("struct_variant", pa.string()), ("chunk_size", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = Slices(path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found: list = []
                got = (0, 0, 0, "", "", "", "")
                if r["size"] == 0:
                    got = (0, 0, 0, "", "empty", "", "")
                else:
                    try:
                        got, found = describe(slices(r["offset"], r["size"]), r["comp_flag"], registry)
                    except (EOFError, OSError) as e:
                        got = (0, 0, 0, "", "", "", f"read: {e}")
                rows.append((r["base_id"], r["offset"], r["size"], r["comp_flag"], r["crc"], r["mft_usize"], r["fingerprint"], *got, r["file_ids"] or [], found))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 16
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, [*kinds, pa.list_(pa.int64()), chunk], strict=True)], names=[*ENTRY_COLUMNS, "file_ids", "chunks"])
        slices.close()

    return mft.mapInArrow(run, DONE)


def deal_by_bytes(mft: DataFrame, total: int, target: int = 128 << 20) -> DataFrame:
    """mft in partitions by place in the archive, each of the entries that begin in one stretch of `target` bytes. total: an upper
    bound of the places, which the file's size gives without a pass."""
    parts = -(-total // target)
    dealt = mft.repartitionById(parts, F.least(F.floor(F.col("offset") / target), F.lit(parts - 1)).cast("int")) if parts > 1 else mft.coalesce(1)
    return dealt.sortWithinPartitions("offset")


def clustered(df: DataFrame, rows: int, by: list[str], target: int = 200_000) -> DataFrame:
    """df sorted by these columns, in files of about `target` rows, so that a scan's filters skip row groups."""
    parts = -(-rows // target)
    dealt = df.repartitionByRange(parts, *by) if parts > 1 else df.coalesce(1)
    return dealt.sortWithinPartitions(*by)


def current(index: str) -> str | None:
    """The folder of the current snapshot."""
    try:
        with open(os.path.join(index, "CURRENT")) as f:
            return os.path.join(index, f.read().strip())
    except FileNotFoundError:
        return None


def _rows_in(folder: str) -> int:
    """The rows of a written table, from its files' footers."""
    return sum(pq.read_metadata(f).num_rows for f in Path(folder).glob("*.parquet"))


def build_index(spark: SparkSession, archive: str, index: str, registry: dict | None = None, full: bool = False, reconcile: bool = False) -> dict[str, int]:
    """Makes or updates the index. Entries whose fingerprint is unchanged keep their rows. `full` decodes all again;
    `reconcile` also drops vanished entries, retries failed reads and takes new file ids for unchanged entries."""
    registry = registry or {}
    mft = read_archive(spark, archive).withColumn("fingerprint", fingerprint("offset", "size", "crc", "comp_flag"))
    ids = read_archive(spark, archive, "file_ids").where("file_id <> 0 AND base_id <> 0").groupBy("file_id").agg(F.min("base_id").alias("base_id"))
    old = current(index)
    todo, kept = mft, None
    if old and not full:
        before = spark.read.parquet(f"{old}/entries")
        if reconcile:
            before = before.where("NOT startswith(error, 'read:')").join(mft.select("base_id"), "base_id", "left_semi")
        todo = changed(mft, before, "base_id", "fingerprint")
    if old:
        kept = spark.read.parquet(f"{old}/entries")
    if old and not full and not reconcile and todo.isEmpty():
        return {"processed": 0, "entries": (n := _rows_in(f"{old}/entries")), "skipped": n}
    per_entry = ids.groupBy("base_id").agg(F.array_sort(F.collect_list("file_id")).alias("file_ids"))
    os.makedirs(index, exist_ok=True)
    snapshot = f"snapshot={uuid.uuid4().hex[:12]}"
    where = os.path.join(index, snapshot)
    # Decoded once, into the snapshot's own folder; the tables are cut from that.
    decode_entries(deal_by_bytes(todo.join(per_entry, "base_id", "left"), os.path.getsize(archive)), archive, registry).write.parquet(f"{where}/decoded")
    done = spark.read.parquet(f"{where}/decoded")
    entries, chunk_rows = done.select(*ENTRY_COLUMNS), done.select("base_id", F.explode("chunks").alias("c")).select("base_id", "c.*")
    id_rows = done.select(F.explode("file_ids").alias("file_id"), "base_id")
    if kept is not None:
        stays = kept.join(done.select("base_id"), "base_id", "left_anti")
        if reconcile:
            stays = stays.join(mft.select("base_id"), "base_id", "left_semi")
        entries = entries.unionByName(stays.select(*ENTRY_COLUMNS))
        chunk_rows = chunk_rows.unionByName(spark.read.parquet(f"{old}/chunks").join(stays.select("base_id"), "base_id", "left_semi"))
        id_rows = id_rows.unionByName(spark.read.parquet(f"{old}/file_ids").join(stays.select("base_id"), "base_id", "left_semi"))
        if reconcile:
            id_rows = ids.join(entries.select("base_id"), "base_id", "left_semi").select("file_id", "base_id")
    rows = open_catalog(archive)[2]
    tables = {
        "entries": clustered(entries, rows, ["type", "container", "base_id"]),
        "chunks": clustered(chunk_rows, 4 * rows, ["fourcc", "base_id", "seq"]),
        "file_ids": id_rows.groupBy("file_id").agg(F.min("base_id").alias("base_id")),
    }
    with ThreadPoolExecutor(len(tables)) as pool:  # the cuts don't wait for each other
        list(pool.map(lambda kv: kv[1].write.parquet(f"{where}/{kv[0]}"), tables.items()))
    meta = {"key": ["dat_path", "dat_size", "mft_entries"], "value": [archive, str(os.path.getsize(archive)), str(rows)]}
    os.makedirs(f"{where}/meta")
    pq.write_table(pa.table(meta), f"{where}/meta/part-0.parquet")
    counts = {"processed": _rows_in(f"{where}/decoded"), "entries": _rows_in(f"{where}/entries")}
    counts["skipped"] = counts["entries"] - counts["processed"]
    temp = os.path.join(index, f".{snapshot}")
    with open(temp, "w") as f:
        f.write(snapshot)
    os.replace(temp, os.path.join(index, "CURRENT"))
    return counts


def text_chain(spark: SparkSession, records: DataFrame, bases: DataFrame) -> DataFrame:
    """(text_id, text) of string records: a file's records count on from its base (file_id, base_text_id)."""
    return records.join(bases, "file_id").select((F.col("base_text_id") + F.col("ord")).alias("text_id"), "text")


def locate_texts(texts: DataFrame, files: DataFrame, per_file: int = 1024) -> DataFrame:
    """Adds to (text_id, ...) the file that holds it and its row there: files are (index, file_id)."""
    placed = texts.withColumn("index", F.expr(f"text_id div {per_file}")).withColumn("row", F.expr(f"pmod(text_id, {per_file})"))
    return placed.join(files, "index")


def half_size_siblings(textures: DataFrame) -> DataFrame:
    """Of (base_id, format, width, height): entries next to one of the same format and exactly twice their size."""
    t = textures.select("base_id", "format", "width", "height")
    big = t.select((F.col("base_id")).alias("full_id"), F.col("format").alias("f"), F.col("width").alias("fw"), F.col("height").alias("fh"))
    near = t.select("*", F.explode(F.array(F.col("base_id") - 1, F.col("base_id") + 1)).alias("full_id"))
    return near.join(big, "full_id").where("f = format AND fw = 2 * width AND fh = 2 * height").select("base_id", "full_id", "format", "width", "height")


def dump_json(rows: list[tuple], depth: int | None = None) -> str:
    """A node tree's rows as nested JSON, cut at a depth."""
    made: dict[int, dict] = {}
    for node_id, parent, d, _, name, kind, offset, size, value in rows:
        if depth is not None and d > depth:
            continue
        made[node_id] = {"name": name, "type": kind, "offset": offset, "size": size, **({"value": value} if value else {})}
        if parent in made:
            made[parent].setdefault("children", []).append(made[node_id])
    return json.dumps(made.get(0, {}))
