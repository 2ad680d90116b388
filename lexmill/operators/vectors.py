"""Exact nearest vectors: one query as a column expression, a stated query set in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.score import EPSILON, cosine, norm
from lexmill.session import stored_batches, written_files, written_table

#: queries that a task takes through the vectors at a time
BLOCK_ROWS = 4_096
#: queries and vectors of one matrix product, and candidates that wait to be ranked
PRODUCT_QUERIES, PRODUCT_VECTORS = 256, 8_192
WAITING = 500_000


def usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, vec): vectors of the right length that aren't zero."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vec"))
    return rows.filter((F.size("vec") == dim) & F.forall("vec", lambda x: x.isNotNull()) & F.exists("vec", lambda x: x != 0))


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "row_id", vector: str = "embedding") -> DataFrame:
    """(key, score): the k rows most similar to one literal vector, score rounded to 6 decimals, ties to the smaller
    key; fewer where there are fewer. Scan, project, take-ordered: no shuffle of vectors."""
    rows = usable(vectors, key, vector, len(query))
    scored = rows.select(F.col("key").alias(key), F.round(cosine(F.col("vec"), query, norm(F.col("vec"))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(k)


def matrix(vec: pa.Array) -> np.ndarray:
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)


def _unit(vec: pa.Array) -> np.ndarray:
    rows = matrix(vec).astype(np.float64)
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + EPSILON)


class Best:
    """The k best of each of n queries so far: those with the largest scores to 6 decimals, ties to the smaller id. Held
    are k rows a query and those that wait to be ranked; a score below the k-th of its query never waits."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.low = np.full(n, -np.inf)  # no more than the k-th score
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))  # score: negative, in millionths
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many = 0

    def meet(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each of some queries, a column for each id."""
        low = self.low[queries]
        if scores.shape[1] >= self.k and np.isinf(low).any():
            cut = scores.shape[1] - self.k
            low = self.low[queries] = np.maximum(low, np.partition(scores, cut, axis=1)[:, cut])
        at, column = np.nonzero(scores >= low[:, None] - 2e-6)
        if len(at):
            self.waiting.append((queries[at], -np.rint(scores[at, column] * 1e6).astype(np.int64), ids[column]))
            self.many += len(at)
            if self.many > WAITING:
                self.settle()

    def settle(self) -> None:
        query, score, key = (np.concatenate(x) for x in zip((self.query, self.score, self.id), *self.waiting, strict=True))
        order = np.lexsort((key, score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < self.k]
        self.query, self.score, self.id = query[place < self.k], score[kept], key[kept]
        last = place == self.k - 1
        self.low[query[last]] = -score[order[last]] / 1e6
        self.waiting, self.many = [], 0


def batch_top_k(queries: DataFrame, vectors: DataFrame, k: int, dim: int, block_rows: int = BLOCK_ROWS, apart_from_self: bool = True) -> DataFrame:
    """(query_id, key, score, rank) for queries (key, vec) against all vectors (key, vec); with apart_from_self a key is
    never its own neighbour.

    The vectors are written once. Each task takes block_rows queries at a time through all of them, as matrix products
    of bounded size, and holds the k best of each query. So nothing but the queries is shuffled, a task's memory depends
    on neither side, and the query set may be as large as the table.
    """
    files = written_files(written_table(vectors.select("key", "vec"), "vectors"))
    count = queries.count()
    tasks = max(1, -(-count // block_rows), min(queries.sparkSession.sparkContext.defaultParallelism, -(-count // PRODUCT_QUERIES)))
    kept = k + apart_from_self  # the query itself among them

    def nearest(rows: pa.Table) -> pa.RecordBatch:
        keys, units = rows["key"].to_numpy(), _unit(rows["vec"].combine_chunks())
        best = Best(len(keys), kept)
        for batch in stored_batches(files, ["key", "vec"], PRODUCT_VECTORS):
            ids, others = batch.column("key").to_numpy(), _unit(batch.column("vec")).T
            for start in range(0, len(keys), PRODUCT_QUERIES):
                some = np.arange(start, min(start + PRODUCT_QUERIES, len(keys)))
                best.meet(some, units[some] @ others, ids)
        best.settle()
        query, score, key = best.query, -best.score / 1e6, best.id
        if apart_from_self:
            other = keys[query] != key
            query, score, key = query[other], score[other], key[other]
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        took = rank <= k
        return pa.RecordBatch.from_arrays([pa.array(keys[query[took]]), pa.array(key[took]), pa.array(score[took]), pa.array(rank[took].astype(np.int32))], names=["query_id", "key", "score", "rank"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, block_rows):
            yield nearest(rows)

    return queries.select("key", "vec").repartition(tasks).mapInArrow(compare, "query_id long, key long, score double, rank int")


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of the batches as tables of so many rows, the last one of fewer."""
    held, many = [], 0
    for batch in batches:
        while many + batch.num_rows >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, rows - many)])
            batch = batch.slice(rows - many)
            held, many = [], 0
        if batch.num_rows:
            held.append(batch)
            many += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
