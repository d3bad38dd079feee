"""MinHash near-duplicate detection.

Every text's set of word shingles is hashed by many universal hash functions, whose minima make its signature.
Texts with equal sets are one class, whose smallest id stands for it from there on. Bands of the signature are
bucket keys. In each bucket every class is compared with the bucket's smallest; candidates are verified first on
signatures and then on the full sets, and connected components (large-star and small-star) join what is linked.
A bucket that still holds several components then has its pairs across components compared in blocks, on sketches
and then on full sets: those of its largest component stay where they are, and only the others are sent to each
block. Only links leave a block. So a group of thousands of copies costs a few rows a member and band rather than
all its pairs, and no link between a bucket's members is lost.

With ROWS rows in each of BANDS bands, a pair at similarity 0.8 shares no bucket with a probability of 7e-6, and its
sketches differ too much with one of 3e-7.

Nulls and edge cases: a text that is null or has no word has an empty set and is linked with nothing; one with
fewer words than a shingle takes has its whole sequence as the only shingle. Rows that repeat an id are one document,
linked by each of its texts; all are returned, each with its own n_shingles and the same component. A null id is
linked with nothing. Ties don't arise: the smallest id of a class, a bucket or a component stands for it. Very long
texts are hashed whole, in blocks. Columns beyond doc_id and text are ignored. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bit_table, mapped, maybe_in, table
from .components import components

BANDS, ROWS = 30, 5
#: Signatures agree in so many of 128 bytes at least, or the pair isn't verified further: five standard deviations
#: under what similarity 0.8 makes likely.
SKETCH = 128
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The set of word n-grams of a text, as sorted distinct 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    hashed = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    gram = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        gram = (gram ^ hashed[k : len(words) - n + 1 + k]) * _MIX
        gram ^= gram >> np.uint64(29)
    return np.unique(gram)


class Hasher:
    """`many` universal hash functions (a * x + b mod 2**64, high half) and the minima of a set under each."""

    def __init__(self, many: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, many, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, many, np.uint64)

    def minima(self, grams: np.ndarray, block: int = 512) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(grams), block):
            least = np.minimum(least, (self.a[:, None] * grams[i : i + block] + self.b[:, None]).min(axis=1))
        return (least >> np.uint64(32)).astype(np.uint32)


def signature(grams: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, bytes]:
    """(a key for each band, one byte of each of the first SKETCH minima)."""
    m = hasher.minima(grams)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for r in range(ROWS):
        keys = (keys ^ m[: BANDS * ROWS].reshape(BANDS, ROWS)[:, r]) * _MIX
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64), (m[:SKETCH] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, cls (a key of the set), and of sets that aren't empty bands and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(max(BANDS * ROWS, SKETCH))
        last: dict[bytes, tuple] = {}  # copies often stand near each other
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                grams = shingles(t, n)
                if not len(grams):
                    rows.append((0, None, None, None))
                    continue
                cls = xxhash.xxh3_128_digest(grams.tobytes())
                if cls not in last:
                    if len(last) > 500:
                        last.clear()
                    last[cls] = (len(grams), cls, *signature(grams, hasher))
                rows.append(last[cls])
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            made = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_shingles", "cls", "bands", "sketch"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, cls binary, bands array<long>, sketch binary")


def sketch_floor(percent: int) -> int:
    """So many of SKETCH bytes are equal, but for five standard deviations, at a similarity of `percent`."""
    p = percent / 100 + (1 - percent / 100) / 256
    return max(1, int(SKETCH * p - 5 * (SKETCH * p * (1 - p)) ** 0.5))


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of (u, v) whose sketches agree."""
    a, b = (sketches.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "uv")
    least = sketch_floor(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (2, 3)]
                yield batch.select([0, 1]).filter(pa.array((m[0] == m[1]).sum(axis=1) >= least))

    return mapped(pairs.join(a, "u").join(b, "v").select("u", "v", "su", "sv"), run, "u long, v long")


def _linked(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of (u, v) whose full sets are similar enough."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id"))
    texts = maybe_in(docs.select("doc_id", "text"), bit_table(ids)).where("maybe").drop("maybe")
    near = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, b = None, np.zeros(0, np.uint64)  # rows come by v, so a hot one's set is made once a task
        for batch in batches:
            keep = []
            for v, tu, tv in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (v, tv) != last:
                    last, b = (v, tv), shingles(tv, n)
                a = shingles(tu, n)
                both = np.concatenate([a, b])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(a) + len(b) - inter))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return mapped(near.select("u", "v", "tu", "tv"), run, "u long, v long")


class _Block:
    """A bucket's part: the rows at home there, which come first, and then the visitors that are compared with them.

    A home row of another than the bucket's largest component is a visitor of its own part, too."""

    def __init__(self) -> None:
        self.home: list[tuple] = []
        self.ready = False

    def take(self, row: tuple) -> Iterator[tuple]:
        if row[3]:
            self.home.append(row)
            return
        yield from self.begin()
        yield from self.visit(row)

    def begin(self) -> Iterator[tuple]:
        if not self.ready:
            self.ready = True
            self.index()
            for k, row in enumerate(self.home):
                if not row[2]:
                    yield from self.visit(row, k)

    def end(self) -> Iterator[tuple]:
        yield from self.begin()

    def index(self) -> None:
        raise NotImplementedError

    def visit(self, row: tuple, at: int | None = None) -> Iterator[tuple]:
        """at: the row's place in home, where it is at home."""
        raise NotImplementedError


class _NearRows(_Block):
    """Rows (doc_id, component, stays, own, sketch): gives those with a near sketch in another component."""

    least = 1

    def index(self) -> None:
        self.sketches = np.frombuffer(b"".join(r[4] for r in self.home), np.uint8).reshape(-1, SKETCH)
        self.comps = np.array([r[1] for r in self.home], np.int64)
        self.marked = np.zeros(len(self.home), bool)

    def visit(self, row: tuple, at: int | None = None) -> Iterator[tuple]:
        mine = np.frombuffer(row[4], np.uint8)
        other = np.flatnonzero(self.comps != row[1])
        near = other[(self.sketches[other] == mine).sum(axis=1) >= self.least]
        self.marked[near] = True
        if len(near) and at is None:
            yield row[:4]
        elif len(near):
            self.marked[at] = True  # rows of the largest component never visit, so none of them would mark it

    def end(self) -> Iterator[tuple]:
        yield from self.begin()
        for k in np.flatnonzero(self.marked):
            yield self.home[k][:4]


class _LinkedRows(_Block):
    """Rows (doc_id, component, stays, own, text): gives pairs that link components, once for each two that meet. All
    sets at home are in one inverted index, so a visitor is compared with all of them at once."""

    shingle, percent = 1, 80

    def index(self) -> None:
        sets = [shingles(r[4], self.shingle) for r in self.home]
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        both = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(both, kind="stable")
        self.grams, self.owner = both[order], np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.root: dict[int, int] = {}

    def find(self, c: int) -> int:
        while (up := self.root.get(c, c)) != c:
            c = up
        return c

    def visit(self, row: tuple, at: int | None = None) -> Iterator[tuple]:
        mine = shingles(row[4], self.shingle)
        lo, hi = np.searchsorted(self.grams, mine, "left"), np.searchsorted(self.grams, mine, "right")
        count = hi - lo
        hits = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        inter = np.bincount(self.owner[hits], minlength=len(self.home))
        for k in np.flatnonzero((inter > 0) & (100 * inter >= self.percent * (len(mine) + self.sizes - inter))):
            doc, comp = self.home[k][:2]
            if (x := self.find(row[1])) != (y := self.find(comp)):
                self.root[max(x, y)] = min(x, y)
                yield max(row[0], doc), min(row[0], doc)


def _in_blocks(rows: DataFrame, kind: type, what: str, out: str, keyed: bool, **settings: int) -> DataFrame:
    """Runs a kind of block over rows: band, part, doc_id, component, stays, own, and `what`."""
    names = [c.split(" ")[0] for c in out.split(", ")]

    def batch_of(got: list[tuple]) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        cols = list(zip(*got, strict=True)) if got else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[o.split(" ")[1]]) for c, o in zip(cols, out.split(", "), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, got = None, None, []
        for batch in batches:
            for band, part, *row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (band, part) != key:
                    if block:
                        got += [(*key, *r) if keyed else r for r in block.end()]
                    key, block = (band, part), kind()
                    for k, v in settings.items():
                        setattr(block, k, v)
                got += [(*key, *r) if keyed else r for r in block.take(tuple(row))]
                if len(got) > 10_000:
                    yield batch_of(got)
                    got = []
        if block:
            got += [(*key, *r) if keyed else r for r in block.end()]
        yield batch_of(got)

    dealt = rows.repartition("band", "part").sortWithinPartitions("band", "part", F.desc("own"))
    return mapped(dealt.select("band", "part", "doc_id", "component", "stays", "own", what), run, out)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = 2048, grams: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept (whether that is its own).

    A hot bucket's rows are dealt to parts of about `block` rows and `grams` shingles."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near", workers=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.write(_signed(docs, shingle))
    sound = signed.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    reps = sound.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    own = scratch.write(sound.join(reps, "cls").select("doc_id", "rep").distinct())
    # One row for each class; an id whose rows have several texts may stand for several classes.
    chosen = scratch.write(sound.join(reps.withColumnRenamed("rep", "doc_id"), ["cls", "doc_id"]).dropDuplicates(["cls"]).select("doc_id", "n_shingles", "bands", "sketch"))
    # Such an id links its classes.
    ties = own.join(own.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1"), "doc_id").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    sketches = chosen.select("doc_id", "sketch")
    bands = chosen.select(F.explode("bands").alias("band"), "doc_id", "n_shingles")
    buckets = scratch.write(bands.groupBy("band").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).where("many > 1"))
    members = scratch.write(bands.join(buckets, "band").select("band", "doc_id", "n_shingles", "least", "many"))
    stars = scratch.write(members.where("doc_id <> least").select(F.col("doc_id").alias("u"), F.col("least").alias("v")).distinct())
    near = scratch.write(_near(stars, sketches, percent))
    # written apart: a worker that writes what another one has made would be a second one in each task
    links = scratch.write(_linked(near, docs, shingle, percent)).unionAll(scratch.write(ties))
    comps = scratch.write(components(links, scratch))
    # Buckets of three and more that still hold several components: what the comparison with the smallest has left open.
    several = members.where("many > 2").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = several.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("grams"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("comps"), F.sum("n").alias("rows"), F.sum("grams").alias("grams")).where("comps > 1")
    parts = F.ceil(F.greatest(F.col("rows") / block, F.col("grams") / grams)).cast("int")
    placed = several.join(largest.drop("comps"), "band").withColumn("stays", F.col("component") == F.col("main")).withColumn("home", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    sent = placed.withColumn("part", F.explode(F.when(F.col("stays"), F.array("home")).otherwise(F.sequence(F.lit(0), parts - 1)))).withColumn("own", F.col("part") == F.col("home"))
    rows = sent.join(sketches, "doc_id").select("band", "part", "doc_id", "component", "stays", "own", "sketch")
    keys = "band long, part int, doc_id long, component long, stays boolean, own boolean"
    open_rows = scratch.write(_in_blocks(rows, _NearRows, "sketch", keys, True, least=sketch_floor(percent)))
    if open_rows.limit(1).count():
        few = maybe_in(docs, bit_table(open_rows)).where("maybe").drop("maybe")
        texts = open_rows.join(few, "doc_id").select("band", "part", "doc_id", "component", "stays", "own", "text")
        more = scratch.write(_in_blocks(texts, _LinkedRows, "text", "u long, v long", False, shingle=shingle, percent=percent))
        if more.limit(1).count():
            comps = scratch.write(components(links.unionAll(more), scratch))
    final = own.join(comps.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    joined = signed.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


QUERIES = {"op3_minhash_near_dedup": op3}
ORACLE = {
    "op3_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM g),
s AS (SELECT doc_id, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 80 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.v FROM r JOIN e ON r.y = e.u)
SELECT n.doc_id, n.n AS n_shingles, min(y) AS component_id, min(y) = n.doc_id AS kept FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n"""
}
