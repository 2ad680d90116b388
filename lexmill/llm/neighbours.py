"""The k most similar vectors for every vector: learned partitions.

A sample of bounded size fits the index: its neighbour graph is cut into balanced partitions, and a small classifier
learns, for a vector, the distribution of its neighbours over the partitions. Every vector is then stored in its most
probable partition and looks for neighbours in several most probable ones, as many as held-out sample vectors need for
the target recall. Partitions are small and their number grows with the vectors, so that the share of the collection
that a vector meets falls. Vectors don't travel to partitions: they are written once in the order of the partitions, and
each task takes a block of its vectors through those that they visit, one matrix product in double precision for each
partition, and holds the best of each vector. So disk is a few times the vectors however many partitions a vector visits,
and no task holds more than a block and a batch. Equal vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.vectors import Best, gathered, matrix
from lexmill.session import stored_batches, written_files, written_table

DIM = 64
K = 10
#: vectors that fit the index, those with the smallest hashes
FIT_VECTORS = 10_000
#: distinct vectors that a partition should hold, and the sample's vectors that a partition needs to be learned: a larger
#: sample teaches more partitions
PARTITION_VECTORS = 100
TEACHING_VECTORS = 20
#: vectors that a task takes through the members at a time, members of one batch, and vectors of a file of members
BLOCK_VECTORS = 8_192
MEMBER_VECTORS = 4_096
FILE_VECTORS = 500_000
#: share of the true neighbours of held-out sample vectors that the probed partitions must hold
TARGET_RECALL = 0.95
GRAPH_DEGREE = 10
SLACK = 1.15


def unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def graph(points: np.ndarray, degree: int, step: int = 1_000) -> np.ndarray:
    """Row i: the degree points most similar to point i, by brute force over the sample."""
    degree = min(degree, len(points) - 1)
    small = points.astype(np.float32)
    out = np.empty((len(points), degree), np.int64)
    for start in range(0, len(points), step):
        sims = small[start : start + step] @ small.T
        sims[np.arange(len(sims)), np.arange(start, start + len(sims))] = -2
        out[start : start + step] = np.argpartition(-sims, degree - 1, axis=1)[:, :degree]
    return out


def balanced_partition(points: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Labels of a cut of the neighbour graph into parts of at most SLACK times the average size: balanced centres
    first, then each point moves to the part that holds most of its neighbours and has room."""
    room = int(np.ceil(SLACK * len(points) / parts))
    centres = points[rng.choice(len(points), parts, replace=False)]
    for _ in range(8):
        labels = _fill(points @ centres.T, room)
        centres = np.stack([points[labels == p].mean(0) if (labels == p).any() else points[rng.integers(len(points))] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    back = [[] for _ in points]
    for i, js in enumerate(near):
        for j in js:
            back[j].append(i)
    around = [np.concatenate([near[i], np.asarray(back[i], np.int64)]) for i in range(len(points))]
    sizes = np.bincount(labels, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(points)):
            votes = np.bincount(labels[around[i]], minlength=parts)
            old = labels[i]
            votes[(sizes >= room) & (np.arange(parts) != old)] = -1
            new = int(votes.argmax())
            if votes[new] > votes[old]:
                labels[i] = new
                sizes[old] -= 1
                sizes[new] += 1
                moved += 1
        if moved < len(points) // 200:
            break
    return labels


def _fill(sims: np.ndarray, room: int) -> np.ndarray:
    """Each point in its most similar part that has room, the surest points first."""
    order = np.argsort(-sims.max(1))
    labels, sizes = np.empty(len(sims), np.int64), np.zeros(sims.shape[1], np.int64)
    choice = np.argsort(-sims, axis=1)
    for i in order:
        for p in choice[i]:
            if sizes[p] < room:
                labels[i] = p
                sizes[p] += 1
                break
    return labels


@dataclass(frozen=True)
class Router:
    """A network of one hidden layer, and the number of partitions to look in."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, points: np.ndarray) -> np.ndarray:
        return np.maximum(points.astype(np.float32) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def route(self, points: np.ndarray, probes: int | None = None) -> np.ndarray:
        scores = self.scores(points)
        return np.argsort(-scores, axis=1, kind="stable")[:, : probes or self.probes]


def train(points: np.ndarray, targets: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 20, batch: int = 256, rate: float = 3e-3) -> tuple:
    """Soft-label cross-entropy by Adam."""
    x, y = points.astype(np.float32), targets.astype(np.float32)
    shapes = [(x.shape[1], hidden), (hidden,), (hidden, y.shape[1]), (y.shape[1],)]
    w = [(rng.standard_normal(s) * np.sqrt(2 / s[0]) if len(s) == 2 else np.zeros(s)).astype(np.float32) for s in shapes]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step = 0
    for epoch in range(epochs):
        pace = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(x))
        for start in range(0, len(x), batch):
            at = order[start : start + batch]
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            d = (z / z.sum(1, keepdims=True) - y[at]) / len(at)
            dh = (d @ w[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((x[at].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def fit(sample: np.ndarray, parts: int, target: float = TARGET_RECALL, seed: int = 7) -> Router:
    """The router of an index of so many partitions; one partition needs no learning."""
    rng = np.random.default_rng(seed)
    points = unit(sample)
    if parts <= 1 or len(points) <= 2 * K:
        return Router(np.zeros((points.shape[1], 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32), 1)
    near = graph(points, GRAPH_DEGREE)
    labels = balanced_partition(points, near, parts, rng)
    targets = np.zeros((len(points), parts), np.float32)
    np.add.at(targets, (np.repeat(np.arange(len(points)), near.shape[1]), labels[near].ravel()), 1)
    np.add.at(targets, (np.arange(len(points)), labels), near.shape[1] / 2)
    targets /= targets.sum(1, keepdims=True)
    held = rng.permutation(len(points)) < max(200, len(points) // 10)
    draft = Router(*train(points[~held], targets[~held], rng), 1)
    home = draft.route(points, 1)[:, 0]
    routes = draft.route(points[held], parts)
    place = np.empty_like(routes)  # of each partition on the route of a held-out vector
    np.put_along_axis(place, routes, np.broadcast_to(np.arange(parts), routes.shape), 1)
    probes = int(np.sort(np.take_along_axis(place, home[near[held]], 1).ravel())[int(np.ceil(target * near[held].size)) - 1]) + 1
    return Router(*train(points, targets, rng), probes)


def _key(vector: Column) -> list[Column]:
    return [F.xxhash64(F.lit("a"), vector).alias("ka"), F.xxhash64(F.lit("b"), vector).alias("kb")]


def usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, vec, ka, kb) of the vectors of the right length with finite numbers that aren't all zero. Two hashes stand
    for the vector where equal ones meet."""
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec"))
    return rows.filter(F.col("id").isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)).select("id", "vec", *_key(v))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row for each distinct vector: its smallest id and the k + 1 smallest ids of its copies. The ranking keeps
    only so many rows of a vector in each input partition before the shuffle, so copies by the million do no harm."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("ka", "kb").orderBy("id"))).filter(F.col("rank") <= k + 1)
    return ranked.groupBy("ka", "kb").agg(F.min("id").alias("rid"), F.array_sort(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec"))


def sample_vectors(rows: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """The number of distinct vectors, and a bounded sample of them to the driver: those with the smallest keys, which
    are hashes. Only keys are shuffled to find which."""
    keys = written_table(rows.select("ka", "kb").distinct(), "keys")
    last = keys.orderBy("ka", "kb").limit(size).agg(F.max(F.struct("ka", "kb")).alias("last")).first()["last"]
    if last is None:
        return 0, np.empty((0, DIM), np.float32)
    wanted = rows.filter((F.col("ka") < last["ka"]) | ((F.col("ka") == last["ka"]) & (F.col("kb") <= last["kb"])))
    found = wanted.groupBy("ka", "kb").agg(F.first("vec").alias("vec")).orderBy("ka", "kb").select("vec").toPandas()
    return keys.count(), np.stack(found["vec"].to_numpy())


def placed(distinct: DataFrame, router: Router) -> DataFrame:
    """distinct with part, the most probable partition of each vector."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.route(unit(matrix(batch.column("vec"))), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    return distinct.mapInArrow(place, "part int, rid long, ids array<long>, ka long, kb long, vec array<float>")


def search(distinct: DataFrame, files: list[str], router: Router, k: int, block: int, members: int) -> DataFrame:
    """(ids, ka, kb, found): the k + 1 best ids for each distinct vector, its own among them. A task takes a block of
    vectors through the members of the partitions that they visit, in the order of the files, and holds the best of each
    vector; a member stands for its smallest ids."""
    schema = "ids array<long>, ka long, kb long, found array<long>"

    def nearest(rows: pa.Table) -> pa.RecordBatch:
        points = unit(matrix(rows["vec"].combine_chunks()))
        to = router.route(points)
        visited = np.sort(to.ravel(), kind="stable")
        visitor = (np.argsort(to.ravel(), kind="stable") // to.shape[1]).astype(np.int64)
        best = Best(len(points), k + 1)
        copies: dict[int, list[int]] = {}
        for batch in stored_batches(files, ["part", "rid", "ids", "vec"], members):
            part, rid, ids = batch.column("part").to_numpy(), batch.column("rid").to_numpy(), batch.column("ids")
            others = unit(matrix(batch.column("vec")))
            order = np.argsort(part, kind="stable")
            here, opens = np.unique(part[order], return_index=True)
            seen = np.zeros(len(rid), bool)
            for p, at in zip(here, np.split(order, opens[1:]), strict=True):
                who = visitor[np.searchsorted(visited, p) : np.searchsorted(visited, p, "right")]
                if len(who):
                    best.meet(who, points[who] @ others[at].T, rid[at])
                    seen[at] = True
            several = np.flatnonzero(seen & (ids.value_lengths().to_numpy() > 1))
            if len(several):
                best.settle()
                several = several[np.isin(rid[several], best.id)]  # only what some vector still holds
                copies.update(zip(rid[several].tolist(), ids.take(pa.array(several)).to_pylist(), strict=True))
        best.settle()
        query, score, found = best.query, best.score, best.id
        held = np.isin(found, np.fromiter(copies, np.int64, len(copies)))
        if held.any():
            more = [copies[i] for i in found[held].tolist()]
            times = [len(x) for x in more]
            query, score, found = (np.concatenate(x) for x in ((query[~held], np.repeat(query[held], times)), (score[~held], np.repeat(score[held], times)), (found[~held], np.concatenate(more))))
            order = np.lexsort((found, score, query))
            query, found = query[order], found[order]
            kept = np.arange(len(query)) - np.searchsorted(query, query) <= k
            query, found = query[kept], found[kept]
        ends = np.searchsorted(query, np.arange(len(points) + 1))
        return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in ("ids", "ka", "kb")), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))], names=["ids", "ka", "kb", "found"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, block):
            yield nearest(rows)

    return distinct.select("ids", "ka", "kb", "vec").mapInArrow(compare, schema)


def nearest(vectors: DataFrame, key: str = "row_id", vector: str = "embedding", k: int = K, dim: int = DIM, fit_vectors: int = FIT_VECTORS, partition_vectors: int = PARTITION_VECTORS, block: int = BLOCK_VECTORS, target: float = TARGET_RECALL) -> DataFrame:
    """(id, neighbour_id): k rows for each usable vector, fewer only where there are fewer others.

    Cosine in double precision rounded to 6 decimals, ties to the smaller id. Null vectors, ones with a null or
    non-finite number, all-zero ones and ones of another length are left out on both sides. Equal vectors, however many,
    are neighbours of each other at no extra cost: the smallest k + 1 ids stand for all of them.
    """
    rows = usable(vectors, key, vector, dim)
    total, sample = sample_vectors(rows, fit_vectors)
    parts = max(1, min(fit_vectors // TEACHING_VECTORS, total // partition_vectors))
    router = fit(sample, parts, target) if total else fit(np.ones((1, dim)), 1)
    files = max(1, min(parts, max(-(-total // FILE_VECTORS), rows.sparkSession.sparkContext.defaultParallelism)))
    members = placed(distinct_vectors(rows, k).select("rid", "ids", "ka", "kb", "vec"), router)
    members = written_table(members.repartitionByRange(files, "part", "ka").sortWithinPartitions("part"), "members")
    found = written_table(search(members, written_files(members), router, k, block, MEMBER_VECTORS), "found")
    others = lambda i: F.explode(F.slice(F.filter("found", lambda f: f != i), 1, k)).alias("neighbour_id")
    listed = found.select(F.explode("ids").alias("id"), "found").select("id", others(F.col("id")))
    # the other copies of a vector that has more than are listed
    many = found.filter(F.size("ids") > k).select("ka", "kb", F.element_at("ids", -1).alias("last"), "found")
    more = rows.select("id", "ka", "kb").join(many, ["ka", "kb"]).filter("id > last")
    return listed.unionByName(more.select("id", others(F.col("id"))))
