"""Exact top-k search by exhaustive term-at-a-time accumulation.

A dimension is a term and its value a posting's weight. Vectors are gathered into blocks; a block of candidates
holds for each term its postings (the candidates with a weight other than 0). For a block of queries, each term
in turn scatters its postings, weighted by the queries that hold the term, into a dense array of scores; a
partition selection then keeps each query's k best of that block, and the partial lists are merged.

Every query block meets every candidate block: that is the work asked for, done on a grid. Query blocks are dealt to rows
of its cells and candidate blocks to columns; a cell gets its row's queries and its column's candidates, holds the
queries with their best so far, and lets the candidates pass by. So only packed blocks move between machines, each about
as often as the square root of the number of cells, in one shuffle.

Nulls and edge cases: a vector that is null, empty, or holds a null or non-finite component takes no part. Shorter
vectors count as 0 where they end. Rows that share an id are each candidates; as queries they count once, as the
smallest of their vectors; a query's own rows are those of its id. Weights beyond 2**52 or scores beyond it
fall back to exact integer arithmetic; a score beyond a long is held at a long's end. Very long vectors are handled a
term at a time. Columns other than the id and the vector are ignored, whatever their names. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table, tidy

_LIMIT = 1 << 63
#: So many query blocks are held at once.
CELL = 4


def _array(rows: list[list[int]]) -> np.ndarray:
    """Rows of integers as a matrix, padded by 0: 64-bit where they fit, else Python's integers."""
    wide = max(map(len, rows))
    rows = [[*r, *[0] * (wide - len(r))] for r in rows]
    try:
        return np.array(rows, np.int64)
    except OverflowError:
        return np.array(rows, object)


def accumulate(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int, kind: type) -> np.ndarray:
    """Scores by candidate and query. postings: for each term the candidates that hold it and their weights."""
    scores = np.zeros((n, len(queries)), kind)
    for d, (rows, weights) in enumerate(postings[: queries.shape[1]]):
        q = queries[:, d].astype(kind)
        if not len(rows) or not q.any():
            continue
        if len(rows) == n:
            scores += weights.astype(kind)[:, None] * q
        else:
            scores[rows] += weights.astype(kind)[:, None] * q
    return scores


def best(queries: np.ndarray, query_ids: np.ndarray, cands: np.ndarray, cand_ids: np.ndarray, k: int, tile: int = 256) -> Iterator[tuple[int, int, int]]:
    """(query id, candidate id, score) of each query's k best in this block, ties to the smaller id."""
    order = np.argsort(cand_ids, kind="stable")
    cands, cand_ids = cands[order], cand_ids[order]
    n = len(cands)
    top = max(1, *(int(abs(x).max()) for x in (queries, cands)))
    bound = top * top * max(cands.shape[1], queries.shape[1])
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 52 else object
    postings = [(r := np.flatnonzero(cands[:, d]), cands[r, d]) for d in range(cands.shape[1])]
    for a in range(0, len(queries), tile):
        qs, ids = queries[a : a + tile], query_ids[a : a + tile]
        scores = np.ascontiguousarray(accumulate(qs, postings, n, kind).T)
        for row, q in zip(scores, ids, strict=True):
            own = slice(*np.searchsorted(cand_ids, [q, q + 1]))
            if kind is object:
                found = sorted((i for i in range(n) if not own.start <= i < own.stop), key=lambda i: (-row[i], i))[:k]
            else:
                # the k-th best score, then whatever beats it, and of its equals the first ones
                row[own] = -np.inf
                least = np.partition(row, n - k)[n - k] if n > k else -np.inf
                sure = np.flatnonzero(row > least)
                tied = np.flatnonzero((row == least) & (row > -np.inf))[: k - len(sure)]
                found = np.concatenate([sure, tied])
            for i in found:
                yield int(q), int(cand_ids[i]), max(-_LIMIT, min(_LIMIT - 1, int(row[i])))


def _pack(ids: list[int], rows: list[list[int]]) -> tuple[int, bytes, int, bytes | None, list | None]:
    m = _array(rows)
    if m.dtype == object:
        return len(ids), np.array(ids, "<i8").tobytes(), m.shape[1], None, [[str(x) for x in r] for r in m]
    most = int(abs(m).max(initial=0))
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if most < np.iinfo(t).max)
    return len(ids), np.array(ids, "<i8").tobytes(), m.shape[1], kind.encode() + m.astype(kind).tobytes(), None


def _unpack(n: int, ids: bytes, wide: int, data: bytes | None, odd: list | None) -> tuple[np.ndarray, np.ndarray]:
    if data is None:
        return np.frombuffer(ids, "<i8"), np.array([[int(x) for x in r] for r in odd], object)
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, data[:3].decode(), offset=3).reshape(n, wide).astype(np.int64)


BLOCK = "n int, ids binary, wide int, data binary, odd array<array<string>>"


def blocks(vectors: DataFrame, rows: int, scale: int) -> DataFrame:
    """Packed blocks of at most `rows` vectors (id, vector) with the components floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from math import floor

        ids: list[int] = []
        held: list[list[int]] = []

        def out() -> pa.RecordBatch:
            made = _pack(ids, held)
            ids.clear()
            held.clear()
            kinds = (pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.string())))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds, strict=True)], names=["n", "ids", "wide", "data", "odd"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                held.append([floor(scale * x) for x in v])
                if len(ids) >= rows:
                    yield out()
        if ids:
            yield out()

    return vectors.mapInArrow(tidy(run), BLOCK)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding", query_block: int = 1024, cand_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best of all vectors but its own."""
    spark = vectors.sparkSession
    v = F.col(vector)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    scratch = Scratch(spark, "topk")
    asked = rows.where("is_query").groupBy("id").agg(F.min("v").alias("v"))
    qs = scratch.write(blocks(asked, query_block, scale).withColumn("number", F.monotonically_increasing_id()))
    cs = scratch.write(blocks(rows.select("id", "v"), cand_block, scale).withColumn("number", F.monotonically_increasing_id()))
    # a cell holds at most about CELL query blocks; columns are added until there is work for all cores
    down = max(1, -(-qs.count() // CELL))
    across = max(1, min(cs.count(), max(-(-4 * spark.sparkContext.defaultParallelism // down), int(down**0.5))))
    # blocks are numbered by partition and place there; the sum of both goes round the rows or columns
    turn = lambda many: F.pmod(F.shiftright("number", 33) + F.col("number").bitwiseAND((1 << 33) - 1), F.lit(many)).cast("int")
    to = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    q = qs.withColumn("cell", F.explode(F.transform(to(across), lambda c: turn(down) * across + c)))
    c = cs.withColumn("cell", F.explode(F.transform(to(down), lambda r: r * across + turn(across))))
    kind = [x.split(" ")[0] for x in BLOCK.split(", ")]
    dealt = q.select("cell", F.lit(0).alias("side"), *kind).unionAll(c.select("cell", F.lit(1).alias("side"), *kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, tops = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            for found in tops:
                yield pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(3)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["cell"] != cell:
                    yield from out()
                    cell, asked, tops = r["cell"], [], []
                ids, vectors = _unpack(*(r[x] for x in kind))
                if not r["side"]:
                    asked.append((ids, vectors))
                    tops.append(np.zeros((0, 3), np.int64))
                    continue
                for i, (q_ids, q_rows) in enumerate(asked):
                    found = np.array(list(best(q_rows, q_ids, vectors, ids, k)), np.int64).reshape(-1, 3)
                    tops[i] = _best_of(np.concatenate([tops[i], found]), k)
        yield from out()

    # a cell's number is its partition's: no two cells meet in one task
    part = dealt.repartitionById(down * across, F.col("cell")).sortWithinPartitions("cell", "side").mapInArrow(tidy(run), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best_of(rows: np.ndarray, k: int) -> np.ndarray:
    """Of rows (query, vector, score) each query's k best."""
    rows = rows[np.lexsort((rows[:, 1], ~rows[:, 2], rows[:, 0]))]
    first = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[:1, 0] - 1)) if len(rows) else np.zeros(0, np.int64)
    return rows[np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)])) < k]


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 20 == 0)


QUERIES = {"op9_exact_topk": op9}
ORACLE = {
    "op9_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""
}
