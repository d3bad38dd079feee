"""The query interface over an index and an archive. Frames stay lazy; the methods that give dicts say so."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strtable
from ..functions.classify import sniff
from ..functions.packfile import NODE, parse_packfile
from ..sources.archive import Slices, read_archive
from . import relational as R
from .index import current, deal_by_bytes, plain


class Index:
    """The current snapshot of an index."""

    def __init__(self, spark: SparkSession, path: str):
        where = current(path)
        if not where or not os.path.isdir(f"{where}/entries"):
            raise FileNotFoundError(f"no index at {path}")
        self.spark, self.where = spark, where
        self.entries, self.chunks, self.file_ids, self.meta = (spark.read.parquet(f"{where}/{t}") for t in ("entries", "chunks", "file_ids", "meta"))

    def stats(self) -> dict:
        """Totals and histograms, as a dict."""
        e = self.entries
        totals = e.agg(F.count("*").alias("entries"), F.count_if((F.col("comp_flag") != 0) & (F.col("actually_compressed") == 0)).alias("false_compressed"), F.count_if(F.col("error") != "").alias("errors")).first().asDict()
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a row a type or container
        return totals | {
            "chunks": self.chunks.count(),
            "meta": dict(self.meta.collect()),
            "by_type": rows(R.histogram(e, "type")),
            "by_container": rows(R.histogram(e, "container", non_empty=True)),
            "by_compression": rows(R.histogram(e, "comp_flag", "actually_compressed")),
        }

    def lookup(self, base_id: int | None = None, file_id: int | None = None) -> dict:
        """One entry with its file ids and chunks, as a dict. Exactly one of the two ids is to be given."""
        if (base_id is None) == (file_id is None):
            raise ValueError("give base_id or file_id")
        if file_id is not None:
            found = self.file_ids.where(F.col("file_id") == file_id).first()
            if not found:
                raise KeyError(f"file_id {file_id}")
            base_id = found.base_id
        row = self.entries.where(F.col("base_id") == base_id).first()
        if not row:
            raise KeyError(f"base_id {base_id}")
        kids = self.chunks.where(F.col("base_id") == base_id).orderBy("seq").drop("base_id")
        ids = self.file_ids.where(F.col("base_id") == base_id).orderBy("file_id")
        return row.asDict() | {"file_ids": [r.file_id for r in ids.collect()], "chunks": [r.asDict() for r in kids.collect()]}

    def query(self, type: str | None = None, container: str | None = None, compressed: bool | None = None, false_compressed: bool | None = None, has_error: bool | None = None) -> DataFrame:  # noqa: A002
        """Entries under all conditions that are given."""
        where = []
        if compressed is not None:
            where.append((F.col("actually_compressed") != 0) == compressed)
        if false_compressed is not None:
            where.append(((F.col("comp_flag") != 0) & (F.col("actually_compressed") == 0)) == false_compressed)
        if has_error is not None:
            where.append((F.col("error") != "") == has_error)
        return R.optional_filter(self.entries, {"type": type, "container": container}, where=where)

    def query_page(self, limit: int = 50, offset: int = 0, **conditions: object) -> tuple[int, DataFrame]:
        """(how many there are, one page by base_id in the list's narrow columns)."""
        found = self.query(**conditions)
        narrow = found.select("base_id", "type", "container", "size", "size_final", "comp_flag", "actually_compressed", "error")
        return found.count(), R.page(narrow, ["base_id"], limit, offset)

    def find_chunk(self, fourcc: str, version: int | None = None, container: str | None = None) -> DataFrame:
        """Chunks of a name, with their entries' type and container; a row a chunk."""
        found = R.optional_filter(self.chunks, {"fourcc": fourcc, "version": version})
        return R.optional_filter(found.join(self.entries.select("base_id", "type", "container"), "base_id"), {"container": container})

    def find_chunk_page(self, fourcc: str, limit: int = 50, offset: int = 0, **conditions: object) -> tuple[int, DataFrame]:
        found = self.find_chunk(fourcc, **conditions)
        return found.count(), R.page(found, ["base_id", "seq"], limit, offset)

    def chunk_variants(self, fourcc: str | None = None) -> DataFrame:
        """How often each (container, name, version, variant) occurs."""
        keys = ["container", "fourcc", "version", "struct_variant"]
        joined = R.optional_filter(self.chunks, {"fourcc": fourcc}).groupBy("base_id", "fourcc", "version", "struct_variant").agg(F.count("*").alias("k"))
        return joined.join(self.entries.select("base_id", "container"), "base_id").groupBy(*keys).agg(F.sum("k").alias("n")).orderBy(F.desc("n"), *keys)

    def types(self) -> DataFrame:
        return R.distinct_values(self.entries, "type")

    def containers(self) -> DataFrame:
        return R.distinct_values(self.entries, "container")

    def base_ids(self, type: str | None = None, container: str | None = None, ident: int | None = None, limit: int = 300_000) -> DataFrame:  # noqa: A002
        """Ids under the conditions; ident is a base id or a file id."""
        found = R.optional_filter(self.entries, {"type": type, "container": container}).select("base_id")
        if ident is not None:
            own = self.file_ids.where(F.col("file_id") == ident).select("base_id")
            found = found.where(F.col("base_id") == ident).unionAll(found.join(own, "base_id", "left_semi")).distinct()
        return R.page(found, ["base_id"], limit)

    def search_ids(self, query: int) -> DataFrame:
        """(namespace, id): base and file ids whose digits hold the query's."""
        b = self.entries.where(R.id_contains("base_id", query)).select(F.lit("base").alias("namespace"), F.col("base_id").alias("id"))
        return b.unionAll(self.file_ids.where(R.id_contains("file_id", query)).select(F.lit("file"), "file_id"))

    def labels(self) -> DataFrame:
        """Each chunk's label."""
        from ..functions.columns import chunk_label

        return self.chunks.select("base_id", "seq", chunk_label(F.col("fourcc"), F.col("version"), F.col("struct_variant")).alias("label"))


class Archive:
    """An archive's catalog and blobs."""

    def __init__(self, spark: SparkSession, path: str, rows: int = 65536):
        self.spark, self.path = spark, path
        self.mft, self.file_ids = read_archive(spark, path, "mft", rows), read_archive(spark, path, "file_ids", rows)

    def info(self) -> dict:
        """The header's fields and the catalog's counts, as a dict."""
        return read_archive(self.spark, self.path, "header").first().asDict() | {"file_ids": self.file_ids.count()}

    def entry(self, base_id: int) -> DataFrame:
        """The catalog's row of one base id, without a scan of the others."""
        return read_archive(self.spark, self.path, "mft", 1, base_id - 1, base_id - 1).where(F.col("base_id") == base_id)

    def entries(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return R.page(self.mft, ["mft_index"], limit, offset)

    def resolve(self, ident: int) -> DataFrame:
        """One number in both namespaces: as a base id, and as a file id."""
        as_base = self.entry(ident).select(F.lit("base").alias("namespace"), "base_id", "offset", "size")
        ids = self.file_ids.where(F.col("file_id") == ident).select("base_id")
        return as_base.unionAll(self.mft.join(ids, "base_id", "left_semi").select(F.lit("file"), "base_id", "offset", "size"))

    def names(self) -> DataFrame:
        """Each base id's file ids, sorted, and their first eight as text."""
        return R.invert(self.file_ids, "base_id", "file_id", "file_ids").withColumn("shown", R.first_n(F.col("file_ids")))

    def blobs(self, mft: DataFrame | None = None, min_size: int = 0) -> DataFrame:
        """(base_id, data, actually_compressed, error): decoded bytes of the entries given, in the archive's order. The size
        condition comes before anything is read."""
        path = self.path
        rows = (self.mft if mft is None else mft).where(F.col("size") >= min_size).select("base_id", "offset", "size", "comp_flag")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slices = Slices(path)
            for batch in batches:
                for base_id, offset, size, flag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    try:
                        data, really, _, error = plain(slices(offset, size), flag) if size else (b"", 0, 0, "")
                    except (EOFError, OSError) as e:
                        data, really, error = b"", 0, f"read: {e}"
                    yield pa.RecordBatch.from_arrays([pa.array([base_id]), pa.array([data], pa.binary()), pa.array([really], pa.int32()), pa.array([error])], names=["base_id", "data", "actually_compressed", "error"])
            slices.close()

        return deal_by_bytes(rows, os.path.getsize(path)).mapInArrow(run, "base_id long, data binary, actually_compressed int, error string")

    def sniff(self, base_id: int) -> dict:
        """What an entry is, as a dict."""
        row = self.blobs(self.entry(base_id)).first()
        if not row:
            raise KeyError(f"base_id {base_id}")
        return sniff(bytes(row.data)) | {"size": len(row.data)}

    def scan(self, contains: bytes, min_size: int = 0, start: int = 0, count: int | None = None, step: int = 1, limit: int = 20) -> DataFrame:
        """(base_id, at): entries whose decoded bytes hold these, among each step-th of a range."""
        part = self.mft.where(F.col("mft_index") >= start)
        if count is not None:
            part = part.where(F.col("mft_index") < start + count * step)
        found = self.blobs(part.where(F.pmod(F.col("mft_index") - start, F.lit(step)) == 0), min_size)
        at = F.expr(f"locate(X'{contains.hex()}', data)")
        return found.select("base_id", (at - 1).alias("at")).where("at >= 0").limit(limit)

    def strings(self, blobs: DataFrame | None = None) -> DataFrame:
        """(base_id, and the columns of a record) of all string tables among the blobs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(b, *r) for b, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in strtable.records(d or b"")]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
                kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 3, pa.string(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["base_id", *(c.split(" ")[0] for c in strtable.RECORD.split(", "))])

        return (self.blobs() if blobs is None else blobs).select("base_id", "data").mapInArrow(run, f"base_id long, {strtable.RECORD}")

    def string_counts(self, blobs: DataFrame | None = None) -> DataFrame:
        """(base_id, records, confirmed, packed) of each string table."""
        found = self.strings(blobs).groupBy("base_id")
        return found.agg(F.count("*").alias("records"), F.count_if("confirmed").alias("confirmed"), F.count_if(F.col("mode") == "packed").alias("packed"))

    def string_page(self, base_id: int, contains: str | None = None, only_confirmed: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
        """One page of an entry's records; a text condition is case-sensitive and looks at confirmed ones only."""
        found = self.strings(self.blobs(self.entry(base_id)))
        if only_confirmed or contains is not None:
            found = found.where("confirmed")
        if contains is not None:
            found = found.where(F.contains("text", F.lit(contains)))
        return R.page(found, ["ord"], limit, offset)

    def trees(self, registry: dict, blobs: DataFrame | None = None, depth: int | None = None, **options: object) -> DataFrame:
        """(base_id, and the columns of a node) of all packfiles among the blobs."""
        names = [c.split(" ")[0] for c in NODE.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if d[:2] != b"PF" or len(d) < 12:
                        continue
                    rows = [(b, *r) for r in parse_packfile(d, registry, **options) if depth is None or r[2] <= depth]
                    kinds = (pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["base_id", *names])

        return (self.blobs() if blobs is None else blobs).select("base_id", "data").mapInArrow(run, f"base_id long, {NODE}")
