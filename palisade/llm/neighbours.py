"""Approximate nearest neighbours by cosine with learned partitions.

On a bounded sample the neighbour graph is cut into balanced parts, and a small network learns which parts a vector's
neighbours are in. Every row is filed under its most probable part; a query goes to its several most probable parts,
whose rows are compared exactly, in double precision on the original vectors. A part with more rows than a block is
split by hash; a query then visits all blocks of the part. Copies of one vector are cut down before they are filed: a
query can need no more than the copies with the smallest ids.

Rules for odd input: rows with a null id, or whose vector is null, zero, or holds null or non-finite components take no
part; vectors of another length than the sample's usual one are compared with their like, all of them; equal scores go
to the smaller id; a repeated id counts once, with its best score, and is never its own neighbour; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.session import land

#: The sample for graph and network, neighbours in the graph, rows a part should have, parts at most (the sample bounds what can be learned).
SAMPLE, DEGREE, PART_ROWS, MOST_PARTS = 8192, 10, 1024, 256
#: A query visits parts until their probabilities reach ``MASS``, ``LEAST_PROBES`` at least.
MASS, LEAST_PROBES = 0.97, 3
BLOCK_ROWS = 4096
HIDDEN, EPOCHS, BATCH, RATE, SEED = 96, 30, 128, 0.004, 11
SLACK = 1.05


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(unit: np.ndarray, degree: int) -> np.ndarray:
    """The nearest ``degree`` rows of each row, itself not among them."""
    out = np.empty((len(unit), degree), np.int64)
    for at in range(0, len(unit), 512):
        near = unit[at:at + 512] @ unit.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -2
        out[at:at + 512] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Parts of nearly equal size with few edges between them: halves along the main direction, then moves that keep
    more of a row's neighbours with it while its new part has room."""
    part = np.zeros(len(unit), np.int64)
    stack = [(np.arange(len(unit)), 0, parts)]
    while stack:
        rows, first, count = stack.pop()
        if count == 1:
            part[rows] = first
            continue
        own = unit[rows] - unit[rows].mean(axis=0)
        direction = np.linalg.svd(own.T @ own)[0][:, 0]
        order = rows[np.argsort(own @ direction, kind="stable")]
        half = count // 2
        cut = len(rows) * half // count
        stack += [(order[:cut], first, half), (order[cut:], first + half, count - half)]
    room = int(np.ceil(len(unit) / parts * SLACK))
    ends = np.concatenate([graph.ravel(), np.repeat(np.arange(len(graph)), graph.shape[1])])
    starts = np.concatenate([np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()])
    for _ in range(rounds):
        ties = np.zeros((len(unit), parts), np.int32)
        np.add.at(ties, (starts, part[ends]), 1)
        wish = ties.argmax(axis=1)
        rows = np.arange(len(unit))
        gain = ties[rows, wish] - ties[rows, part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for r in np.argsort(-gain, kind="stable"):
            if gain[r] <= 0:
                break
            if sizes[wish[r]] < room:
                sizes[part[r]] -= 1
                sizes[wish[r]] += 1
                part[r] = wish[r]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """Two layers and a softmax over parts; ``width`` is the length of vectors it knows."""

    width: int
    parts: int
    layers: tuple[np.ndarray, ...] = ()

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.ones((len(vectors), 1))
        a, b, c, d = self.layers
        z = np.maximum(_unit(vectors) @ a + b, 0) @ c + d
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(sample: np.ndarray, parts: int) -> Router:
    if parts == 1:
        return Router(sample.shape[1], 1)
    unit = _unit(sample)
    graph = neighbour_graph(unit, min(DEGREE, len(unit) - 1))
    part = balanced_parts(unit, graph, parts)
    # what is learned: in which parts a row's neighbours, and the row itself, are
    goal = np.zeros((len(unit), parts))
    np.add.at(goal, (np.repeat(np.arange(len(unit)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    goal[np.arange(len(unit)), part] += 0.5
    rng = np.random.default_rng(SEED)
    p = [rng.normal(0, 1, (unit.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (2 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    mean, square, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(unit))
        for at in range(0, len(order), BATCH):
            x, y = unit[order[at:at + BATCH]], goal[order[at:at + BATCH]]
            h = np.maximum(x @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out = (e / e.sum(axis=1, keepdims=True) - y) / len(x)
            back = (out @ p[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((x.T @ back, back.sum(axis=0), h.T @ out, out.sum(axis=0))):
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                p[k] -= RATE * (1 - epoch / EPOCHS) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Router(unit.shape[1], parts, tuple(p))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [v.values.to_numpy(zero_copy_only=False).astype(float) for v in column]


def _by_width(vectors: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    widths = np.array([len(v) for v in vectors])
    for width in np.unique(widths):
        yield int(width), np.flatnonzero(widths == width)


def _file(rows: DataFrame, router: Router) -> DataFrame:
    """``vec_id, vector, part``: each row under its most probable part; other lengths under minus their length."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch.column(1))
            part = np.zeros(len(vectors), np.int32)
            for width, at in _by_width(vectors):
                part[at] = router.probabilities(np.stack([vectors[k] for k in at])).argmax(axis=1) if width == router.width else -width
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], ["vec_id", "vector", "part"])

    return rows.select("vec_id", "vector").mapInArrow(work, "vec_id long, vector array<float>, part int")


def _send(queries: DataFrame, router: Router, blocks: dict[int, int], everywhere: bool = False) -> DataFrame:
    """Each query once per block of the parts it visits."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch.column(1))
            take, parts, places = [], [], []

            def visit(row: int, part: int) -> None:
                for block in range(blocks.get(part, 0)):
                    take.append(row)
                    parts.append(part)
                    places.append(block)

            for width, at in _by_width(vectors):
                if width != router.width:
                    for k in at:
                        visit(int(k), -width)
                    continue
                p = router.probabilities(np.stack([vectors[k] for k in at]))
                order = np.argsort(-p, axis=1, kind="stable")
                mass = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
                for k, ranked, reached in zip(at, order, mass):
                    count = router.parts if everywhere else max(LEAST_PROBES, int(np.searchsorted(reached, MASS)) + 1)
                    for part in ranked[:count]:
                        visit(int(k), int(part))
            if take:
                chosen = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(parts, pa.int32()), pa.array(places, pa.int32())],
                                                 ["query_id", "vector", "part", "block"])

    return queries.select("vec_id", "vector").mapInArrow(work, "query_id long, vector array<float>, part int, block int")


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """Per query the k largest cosines (ties to smaller ids), its own id left out: arrays of query id, id, score."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    out = []
    for at in range(0, len(queries), 128):
        part = queries[at:at + 128]
        rough = (part @ vectors.T) / (norms * np.sqrt((part * part).sum(axis=1))[:, None])
        rough[query_ids[at:at + 128, None] == ids[None]] = -3
        last = np.partition(rough, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
        for row, limit in enumerate(last):
            # a matrix product may round equal rows differently: take what is as near but for rounding, and work it out one by one
            at_row = np.flatnonzero((rough[row] >= limit - 1e-9) & (rough[row] > -2))
            q = part[row]
            score = (vectors[at_row] * q).sum(axis=1) / (norms[at_row] * np.sqrt((q * q).sum()))
            best = np.lexsort((ids[at_row], -score))[:k]
            out.append((np.full(len(best), query_ids[at + row]), ids[at_row][best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _rerank(sent: DataFrame, filed: DataFrame, k: int) -> DataFrame:
    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(queries) and len(rows):
            found = nearest(queries["query_id"].to_numpy(), np.stack(_vectors(queries["vector"])), rows["vec_id"].to_numpy(), np.stack(_vectors(rows["vector"])), k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    keys = ["part", "block"]
    return sent.groupBy(*keys).cogroup(filed.groupBy(*keys)).applyInArrow(work, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k)


def search(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each row that ``is_query`` (over the column vec_id)."""
    valid = land(rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("vector")).where(
        F.col("vec_id").isNotNull() & usable(F.col("vector"))))
    # of copies of one vector, those with the smallest ids: one more than a result holds, as a query may be one of them
    copies = Window.partitionBy("vector").orderBy("vec_id")
    kept = land(valid.distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"))
    sizes = {r.width: r["count"] for r in kept.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(16).collect()}
    if not sizes:
        return _top(kept.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    width, total = next(iter(sizes.items()))
    parts = max(1, min(MOST_PARTS, total // PART_ROWS))
    draw = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30))
    sample = [r.vector for r in kept.where((F.size("vector") == width) & (draw < int(min(1.0, 2.0 * SAMPLE / total) * (1 << 30)))).select(
        "vector", draw.alias("draw"), "vec_id").orderBy("draw", "vec_id").limit(SAMPLE).collect()] if parts > 1 else [[0.0] * width]
    router = train(np.array(sample), parts)
    filed = land(_file(kept, router))
    # a row per part, and per odd length
    blocks = {r.part: -(-r["count"] // BLOCK_ROWS) for r in filed.groupBy("part").count().collect()}
    of_part = F.create_map(*[x for part, n in blocks.items() for x in (F.lit(part), F.lit(n))])
    filed = filed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(of_part, F.col("part"))).cast("int"))
    queries = valid.where(is_query).distinct()
    found = land(_top(_rerank(_send(queries, router, blocks), filed, k), k))
    # a query whose parts held fewer than k others visits all parts
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    lacking = land(queries.join(counts, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < k).select("vec_id", "vector"))
    if router.parts > 1 and not lacking.isEmpty():
        more = _rerank(_send(lacking, router, blocks, everywhere=True), filed, k)
        found = _top(found.select("query_id", "vec_id", "score").unionByName(more), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
