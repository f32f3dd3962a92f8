"""Hard negatives by exact integer scores, in the manner of the Four Russians.

The dimensions of an anchor are taken in groups of eight, and the sums of all 256 subsets of a group are worked out once.
A candidate is kept as bit planes in two's complement, eight dimensions a byte: a byte looks up what a plane adds in a
group, planes are shifted and added (the sign plane is subtracted), and the outcome is the full inner product, for all
anchors of a block at once. Nothing is estimated and nothing is left out.

Anchors and rows are dealt into blocks by their id; a task takes one block of each, so every row meets every anchor, in
bounded pieces, and neither labels nor copies make a group large. First each anchor's best rows of its own label are found,
then, for each of these positives, the best rows of other labels within the band of scores. Work is anchors times
rows by definition; what moves is rows times blocks of anchors, packed (72 bytes a row for 64 dimensions of nine bits).

Rules for odd input: rows with a null id, label or vector, or with a null component, take no part; nor does a row with a
component so large that an inner product could leave 63 bits; rows are compared with rows of their own length only; of
rows that share an id the one with the smallest label, then vector takes part; equal scores go to the smaller id; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.session import land

#: Rows and anchors of a block; rows scored at once; bytes of subset sums held at once; most tasks of a pass.
ROWS, ANCHORS, CHUNK, TABLE_BYTES, TASKS = 8192, 1024, 128, 1 << 24, 20_000
GROUP = 8
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
_PAIR = "anchor_id long, other_id long, score long"
_TRIPLE = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def pack(values: np.ndarray) -> np.ndarray:
    """Bit planes of integers (rows, dimensions) -> bytes (rows, planes, groups), the sign plane last."""
    if not values.size:
        return np.zeros((len(values), 1, 0), np.uint8)
    planes = max(int(values.max()).bit_length(), int(~values.min()).bit_length()) + 1
    return np.stack([np.packbits((values >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(planes)], axis=1)


def unpack(planes: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(planes, axis=2, bitorder="little")[:, :, :width].astype(np.int64)
    weights = 1 << np.arange(bits.shape[1], dtype=np.int64)
    weights[-1] *= -1
    return (bits * weights[None, :, None]).sum(axis=1)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): of each group of eight dimensions the sums of all its subsets."""
    count, width = anchors.shape
    groups = -(-width // GROUP)
    filled = np.zeros((count, groups * GROUP), np.int64)
    filled[:, :width] = anchors
    small = int(np.abs(filled).sum(axis=1).max(initial=0)) < 1 << 15
    parts = filled.reshape(count, groups, GROUP).transpose(1, 2, 0)
    sums = np.zeros((groups, 1 << GROUP, count), np.int16 if small else np.int64)
    for bit in range(GROUP):
        sums[:, 1 << bit:2 << bit] = sums[:, :1 << bit] + parts[:, bit, None].astype(sums.dtype)
    return sums


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (rows, anchors) from the anchors' subset sums and the rows' bit planes."""
    total = np.zeros((len(planes), sums.shape[2]), np.int64)
    plane, looked = np.empty(total.shape, sums.dtype), np.empty(total.shape, sums.dtype)
    if sums.dtype == np.int16 and planes.shape[1] <= 15:
        total = total.astype(np.int32)
    last = planes.shape[1] - 1
    for p in range(last, -1, -1):
        plane[:] = 0
        for g in range(len(sums)):
            np.take(sums[g], planes[:, p, g], axis=0, out=looked, mode="clip")
            plane += looked
        total <<= 1
        if p == last:
            total -= plane
        else:
            total += plane
    return total


class _Block:
    """Rows of one group, by label, then id: ids, labels, planes."""

    def __init__(self, table: pa.Table, ids: str, width: int):
        rows = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, -(-width // GROUP)) if width else np.zeros((1, 0), np.uint8) for x in table["planes"]]
        most = max(len(x) for x in rows)
        planes = np.stack([np.concatenate([x, np.repeat(x[-1:], most - len(x), axis=0)]) for x in rows])  # the sign goes on
        ids, labels = table[ids].to_numpy(), table["label"].to_numpy()
        self.order = np.lexsort((ids, labels))
        self.ids, self.labels, self.planes, self.width = ids[self.order], labels[self.order], planes[self.order], width

    def parts(self, first: int, last: int) -> Iterator[slice]:
        """Slices whose subset sums fit the bound."""
        step = max(1, TABLE_BYTES // max(1, -(-self.width // GROUP) * (1 << GROUP) * 8))
        for at in range(first, last, step):
            yield slice(at, min(at + step, last))

    def sums(self, part: slice) -> np.ndarray:
        return subset_sums(unpack(self.planes[part], self.width))


def _ranked(who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, -score, who))
    return who[order], score[order], ids[order]


def _positives(anchors: _Block, rows: _Block, count: int) -> Iterator[tuple[np.ndarray, ...]]:
    for label in np.intersect1d(anchors.labels, rows.labels):
        first, last = np.searchsorted(anchors.labels, [label, label + 1])
        start, stop = np.searchsorted(rows.labels, [label, label + 1])
        for part in anchors.parts(first, last):
            sums, own = anchors.sums(part), anchors.ids[part]
            kept = tuple(np.zeros(0, np.int64) for _ in range(3))
            least = np.full(len(own), np.iinfo(np.int64).min)
            for at in range(start, stop, CHUNK):
                chunk = slice(at, min(at + CHUNK, stop))
                found = scores(sums, rows.planes[chunk])
                r, a = np.nonzero((found >= least) & (rows.ids[chunk, None] != own))
                who, score, ids = _ranked(*(np.concatenate(x) for x in zip(kept, (a, found[r, a].astype(np.int64), rows.ids[chunk][r]))))
                place = np.arange(len(who)) - np.searchsorted(who, who)
                kept = who[place < count], score[place < count], ids[place < count]
                full = place == count - 1
                least[who[full]] = score[full]
            yield own[kept[0]], kept[2], kept[1]


def percent(score: np.ndarray, share: int, up: bool = False) -> np.ndarray:
    """``score * share / 100`` rounded down, or up; without leaving 64 bits."""
    whole, rest = score // 100, score % 100
    return whole * share + (-(-rest * share // 100) if up else rest * share // 100)


def _negatives(anchors: _Block, bands: list[list[tuple[int, int]]], rows: _Block, count: int, low: int, high: int) -> Iterator[tuple[np.ndarray, ...]]:
    for part in anchors.parts(0, len(anchors.ids)):
        sums, own, labels = anchors.sums(part), anchors.ids[part], anchors.labels[part]
        who = np.concatenate([np.full(len(bands[k]), k - part.start) for k in range(part.start, part.stop)])
        positive, score = (np.array([x[j] for k in range(part.start, part.stop) for x in bands[k]], np.int64) for j in (0, 1))
        top, floor = percent(score, high), percent(score, low, up=True)
        useful = top >= floor  # a negative score of the positive leaves no band
        who, positive, score, top, floor = (x[useful] for x in (who, positive, score, top, floor))
        most, least = np.full(len(own), np.iinfo(np.int64).min), np.full(len(own), np.iinfo(np.int64).max)
        np.maximum.at(most, who, top)
        np.minimum.at(least, who, floor)
        kept = tuple(np.zeros(0, np.int64) for _ in range(3))
        chosen = (np.zeros(0, np.int64),) * 2
        for at in range(0, len(rows.ids), CHUNK):
            chunk = slice(at, min(at + CHUNK, len(rows.ids)))
            found = scores(sums, rows.planes[chunk])
            fit = (found >= least) & (found <= most)
            for label in np.unique(rows.labels[chunk]):  # both sides lie by label
                fit[slice(*np.searchsorted(rows.labels[chunk], [label, label + 1])), slice(*np.searchsorted(labels, [label, label + 1]))] = False
            r, a = np.nonzero(fit)
            if not len(r):
                continue
            a, s, i = _ranked(*(np.concatenate(x) for x in zip(kept, (a, found[r, a].astype(np.int64), rows.ids[chunk][r]))))
            # a band's first row: scores of an anchor fall, so count those of the anchor that lie above the band
            starts = np.searchsorted(a, who)
            ends = np.searchsorted(a, who, side="right")
            first = np.array([b + np.searchsorted(-s[b:e], -t) for b, e, t in zip(starts, ends, top)], np.int64)
            take = first[:, None] + np.arange(count)
            valid = take < ends[:, None]
            valid[valid] &= s[take[valid]] >= np.broadcast_to(floor[:, None], take.shape)[valid]
            band = np.nonzero(valid)[0]
            rest = np.unique(take[valid])
            kept, chosen = (a[rest], s[rest], i[rest]), (band, np.searchsorted(rest, take[valid]))
            reached = np.where(valid[:, -1], s[np.minimum(take[:, -1], len(s) - 1)], floor)
            least = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(least, who, reached)
        band, at = chosen
        yield own[who[band]], positive[band], score[band], kept[2][at], kept[1][at]


def _packed(rows: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            out: list[bytes] = [b""] * len(vectors)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(widths)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                for k, planes in zip(at, pack(flat[(ends[at] - width)[:, None] + np.arange(width)].astype(np.int64))):
                    out[k] = planes.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(widths, pa.int32()), pa.array(out, pa.binary())],
                                             ["vec_id", "label", "width", "planes"])

    return rows.select("vec_id", "label", "vector").mapInArrow(work, "vec_id long, label long, width int, planes binary")


def _met(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], work, schema: str) -> DataFrame:
    """``work`` over every pair of an anchor block and a row block."""
    of_anchors, of_rows = sizes
    keys = ["width", "anchor_block", "row_block"]
    tasks = max(1, min(TASKS, 2 * of_anchors * of_rows))

    def dealt(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(count)).cast("int")
        return df.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition(tasks, *keys)

    left = dealt(anchors, "anchor_block", of_anchors, "row_block", of_rows)
    right = dealt(rows, "row_block", of_rows, "anchor_block", of_anchors)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def _table(found: Iterator[tuple[np.ndarray, ...]], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    parts = list(found)
    columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows`` of vec_id, label and vector
    (array<bigint>). ``is_anchor`` is a condition on vec_id. A negative's score lies between ``low`` and ``high`` percent of
    the positive's, both included; ranks count from 1."""
    size = F.greatest(F.size("vector"), F.lit(1))
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.sqrt(F.lit(2.0**62) / size)))
    usable = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(fine, F.lit(False)))
    once = usable.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")
    packed = land(_packed(once))
    anchors = packed.where(is_anchor)
    sizes = max(1, -(-anchors.count() // ANCHORS)), max(1, -(-packed.count() // ROWS))

    def best(key, own: pa.Table, others: pa.Table) -> pa.Table:
        return _table(_positives(_Block(own, "vec_id", key[0].as_py()), _Block(others, "vec_id", key[0].as_py()), positives) if len(own) and len(others) else iter(()), _PAIR)

    def hardest(key, own: pa.Table, others: pa.Table) -> pa.Table:
        if not len(own) or not len(others):
            return _table(iter(()), _TRIPLE)
        block, bands = _Block(own, "vec_id", key[0].as_py()), own["bands"].to_pylist()
        bands = [[(b["id"], b["score"]) for b in bands[k]] for k in block.order]
        return _table(_negatives(block, bands, _Block(others, "vec_id", key[0].as_py()), negatives, low, high), _TRIPLE)

    of_anchor = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    found = _met(anchors, packed, sizes, best, _PAIR).withColumn("rank", F.row_number().over(of_anchor)).where(F.col("rank") <= positives)
    bands = found.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("other_id").alias("id"), "score")).alias("bands"))
    banded = land(anchors.join(bands, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"))
    of_pair = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = _met(banded, packed, sizes, hardest, _TRIPLE).withColumn("rank", F.row_number().over(of_pair).cast("int"))
    return ranked.where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Of the query: scale of a component, anchors and re-labelled rows by id, labels.
SCALE, ANCHOR_EVERY, MOVED_EVERY, LABELS = 256, 50, 7, 10


def report(rows: DataFrame) -> DataFrame:
    """``mine`` over a table of embeddings: components become floor(256 x), every seventh id takes the next label, every
    fiftieth id is an anchor. Null and non-finite components keep a row out."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(
        F.isnan(x) | (F.abs(x) >= 2.0**52), F.lit(None)).otherwise(F.floor(x * SCALE)).cast("long"))  # beyond that no product fits anyway
    label = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), whole.alias("vector")), F.col("vec_id") % ANCHOR_EVERY == 0)


ORACLE = """
WITH rows AS (SELECT vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a, rows b WHERE a.id % 50 = 0 AND a.id <> b.id),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM pairs WHERE same) WHERE place <= 5)
SELECT * FROM (SELECT p.anchor_id, p.other_id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score) WHERE rank <= 3
"""
