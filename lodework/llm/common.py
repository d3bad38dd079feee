"""What the training-data operators share: table access, scratch tables and small helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: The ASCII white space that separates words: [\x20\x09-\x0D], as bytes.split() has it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not getattr(scratch_dir, "own", None):
        scratch_dir.own = tempfile.TemporaryDirectory(prefix="lodework-")
        atexit.register(scratch_dir.own.cleanup)
    return "file://" + scratch_dir.own.name


def shared_folder(spark: SparkSession) -> str | None:
    """The shared folder as a path that files can be opened in, or None where it is a store that only Spark reaches."""
    scheme, colon, path = scratch_dir(spark).partition(":")
    return scheme if not colon else "/" + path.lstrip("/") if scheme == "file" else None


def task_folder(shared: str | None) -> str | None:
    """Where a task's own unnamed files go, which only it reads and a lost task's successor writes again: the shared folder
    or, if files can't be opened there, the folders that Spark gives its executors for spilling."""
    folder = shared or os.environ.get("SPARK_LOCAL_DIRS", os.environ.get("LOCAL_DIRS", "")).split(",")[0]
    if folder:
        os.makedirs(folder, exist_ok=True)
    return folder or None


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _written_by_workers(df: DataFrame, folder: str, codec: str, most: int = 8 << 20) -> None:
    """df as Parquet files, one a task that has rows. A file has a hidden name until the job is done, and only those of the
    attempts that counted get another. most: so many bytes are held for a row group."""
    os.makedirs(folder)
    schema = to_arrow_schema(df.schema)
    parent, run = getattr(df, "_made", (df, None))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        name, writer, held, size = f".{uuid.uuid4().hex}.parquet", None, [], 0
        try:
            for batch in run(batches) if run else batches:
                if batch.num_rows:
                    held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema))
                    size += batch.nbytes
                if size > most:
                    writer = writer or pq.ParquetWriter(f"{folder}/{name}", schema, compression=codec)
                    writer.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                writer = writer or pq.ParquetWriter(f"{folder}/{name}", schema, compression=codec)
                writer.write_table(pa.Table.from_batches(held))
        finally:
            if writer:
                writer.close()
            free()
        yield pa.RecordBatch.from_arrays([pa.array([name] if writer else [], pa.string())], names=["name"])

    for n, row in enumerate(parent.mapInArrow(task, "name string").collect()):
        os.rename(f"{folder}/{row.name}", f"{folder}/part-{n:05d}.parquet")
    for left in os.listdir(folder):
        if left.startswith("."):
            os.remove(f"{folder}/{left}")


class Scratch:
    """Tables written to the shared folder, so that what follows neither recomputes them nor needs the
    executors that made them. drop() removes those that nothing reads any more; a result that stays lazy
    keeps the ones it reads until the session ends.

    workers: where files can be opened in the shared folder, the Python workers write the tables. Spark's writer there
    starts a process of the JVM for the mode of each folder, file and checksum, three a task. The shuffle files of a table go
    as soon as it is written; those left to the garbage collector were seen to stay for several steps. Its inputs are read
    without vectored reads, whose threads each keep a direct buffer as large as the largest column chunk they have read."""

    def __init__(self, spark: SparkSession, name: str, workers: bool = False):
        self.spark = spark
        own = f"lodework-{name}-{uuid.uuid4().hex[:12]}"
        self.root = f"{scratch_dir(spark)}/{own}"
        self.conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": True, "parquet.hadoop.vectored.io.enabled": False} if workers else {}
        shared = shared_folder(spark) if workers else None
        self.folder = shared and f"{shared}/{own}"
        self.count = 0
        self.paths: dict[int, str] = {}
        atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            pass

    def write(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        with settings(self.spark, **self.conf):
            if self.folder:
                _written_by_workers(df, f"{self.folder}/{self.count}", codec)
            else:
                df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch = path
        return out

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, df._scratch)

    def keep(self, df: DataFrame) -> None:
        """Drops all tables but this one."""
        for path in self.paths.values():
            if path != df._scratch:
                delete(self.spark, path)
        self.paths = {id(df): df._scratch}


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: object) -> Iterator[None]:
    """SQL settings for the actions inside; dots are written as double underscores."""
    names = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what no plan refers to any more, and has each executor's JVM collect its garbage.
    One whose heap has grown for a step gives the free part back only then, and holds it beside all later steps' workers otherwise."""
    gc.collect()
    spark._jvm.System.gc()
    context = spark.sparkContext._jsc.sc()
    if not context.isLocal():
        executors = max(1, context.getExecutorMemoryStatus().size() - 1)  # the driver is among them; idle ones get a task each
        spark.range(0, executors, 1, executors).selectExpr("reflect('java.lang.System', 'gc')").collect()


def free() -> None:
    """Gives back to the system what this process no longer uses."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable, *forget: Callable[[], object]) -> Callable:
    """A mapInArrow function whose worker gives its memory back when its task ends, as later stages use the same workers.
    forget: calls that empty what the worker has cached."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            free()

    return task


def mapped(df: DataFrame, run: Callable, schema: object) -> DataFrame:
    """df.mapInArrow() of a tidy run, whose workers a Scratch can let write the result."""
    out = df.mapInArrow(tidy(run), schema)
    out._made = (df, tidy(run))
    return out


def in_few_files(df: DataFrame) -> DataFrame:
    """df in fewer partitions where there are many: a result's files needn't be as small as a task's share of a shuffle.
    Eight for each core are left at least."""
    spark = df.sparkSession
    return df.coalesce(max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


#: The bit table has so many words of 64 bits at most, whatever goes in: 4 MB.
WORDS = 1 << 18


def bit_table(ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """A bit for each id, by its hash: (word, bits), at most WORDS rows. The table's size has that bound by
    construction, so it may be broadcast; when it fills up it lets more rows through and never drops a wrong one."""
    h = F.pmod(F.xxhash64(F.col(column)), F.lit(64 * WORDS))
    return ids.select((h / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def maybe_in(rows: DataFrame, bits: DataFrame, column: str = "doc_id") -> DataFrame:
    """rows with `maybe`: false only where the id is surely not in the table. No shuffle of the rows."""
    h = F.pmod(F.xxhash64(F.col(column)), F.lit(64 * WORDS))
    keyed = rows.withColumn("_word", (h / 64).cast("int")).withColumn("_bit", F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int")))
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    joined = keyed.join(F.broadcast(bits.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))), "_word", "left")
    return joined.withColumn("maybe", hit).drop("_word", "_bit", "_bits")
