"""SimHash near-duplicates with a hierarchical index over fingerprints in Gray order.

Two 64-bit fingerprints within two bits agree on one of three blocks of bits. Each fingerprint is therefore
dealt three times, each time with another block in front; rows that share their front bits form a group.
A group is sorted by Gray rank, in which equal leading bits stand together, and its bit patterns are factored
into a tree, four bits a level. A search goes down pairs of nodes and adds up the differences of their own
bits; a pair of nodes over the limit drops all fingerprints below both. A group of more than ``GROUP_ROWS``
fingerprints is dealt again by the same argument over its remaining bits, so no group outgrows a task: after
the third deal at most 2**20 fingerprints can share their front bits.

Rules for odd input: a null or empty text has no words and the fingerprint zero, which links like any other;
a null doc_id gets a row, and never is a component's id unless the component has no other; equal rows stay;
an empty table gives an empty table. Only the named columns are read, whatever else the input holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import fresh
from palisade.llm.components import components
from palisade.session import land

WORDS, SEED, BITS = 3, 42, 64
DISTANCE = 2
BLOCKS = DISTANCE + 1
#: Rows from which on a group is dealt again, and how often at most.
GROUP_ROWS, DEALS = 20_000, 3
#: Bits that a level of the tree factors out.
LEVEL = 4
_STEP, _PAIRS = 1 << 15, 1 << 21
_SIGN = np.uint64(1 << 63)


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text; shingles are hashed as they come and counted in slices."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(WORDS, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), _STEP):
        cut = zip(starts[k:k + _STEP].tolist(), ends[width - 1 + k:width - 1 + k + _STEP].tolist())
        hashes = np.array([digest(line[i:j], SEED) for i, j in cut], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """``row, doc_id, fp``: fp as a signed long; row: a column of longs that tells rows apart, if one is named."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.int64())], ["row", "doc_id", "fp"])

    asked = rows.select((F.col(row) if row else F.lit(None)).cast("long").alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return asked.mapInArrow(work, "row long, doc_id long, fp long")


# --- dealing: which bits stand in front -------------------------------------------------------------------

def widths(free: int) -> list[int]:
    """Three blocks over the free bits."""
    small = free // BLOCKS
    return [free - small * (BLOCKS - 1), *[small] * (BLOCKS - 1)]


def fixed_bits(path: tuple[int, ...]) -> int:
    """Front bits of a group that was dealt by these blocks."""
    fixed = 0
    for block in path:
        fixed += widths(BITS - fixed)[block]
    return fixed


def _turn(codes: np.ndarray, fixed: int, by: int) -> np.ndarray:
    """Rotate the bits after the first ``fixed`` ones to the left."""
    free = BITS - fixed
    if by % free == 0:
        return codes
    mask = np.uint64((1 << free) - 1)
    tail = codes & mask
    turned = ((tail << np.uint64(by)) | (tail >> np.uint64(free - by))) & mask
    return (codes & ~mask) | turned


def put_in_front(codes: np.ndarray, path: tuple[int, ...], block: int) -> np.ndarray:
    fixed = fixed_bits(path)
    return _turn(codes, fixed, sum(widths(BITS - fixed)[:block]))


def restore(codes: np.ndarray, path: tuple[int, ...]) -> np.ndarray:
    """The fingerprints behind codes that were dealt by ``path``."""
    for depth in reversed(range(len(path))):
        fixed = fixed_bits(path[:depth])
        by = sum(widths(BITS - fixed)[:path[depth]])
        codes = _turn(codes, fixed, (BITS - fixed - by) % (BITS - fixed))
    return codes


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of a code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def from_gray_rank(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


def _numbered(path: tuple[int, ...]) -> int:
    number = 0
    for block in path:
        number = number * BLOCKS + block + 1
    return number


def _path(number: int) -> tuple[int, ...]:
    path: tuple[int, ...] = ()
    while number:
        number, block = divmod(number - 1, BLOCKS)
        path = (block, *path)
    return path


DEALT = "path int, front long, rank long"


def deal(rows: DataFrame) -> DataFrame:
    """Each row (path, rank) once per block of its free bits: ``path, front, rank``; ranks are stored so that longs sort like them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            ranks = batch.column(1).to_numpy().view(np.uint64) ^ _SIGN
            for number in np.unique(numbers):
                path, codes = _path(int(number)), from_gray_rank(ranks[numbers == number])
                for block in range(BLOCKS):
                    dealt, to = put_in_front(codes, path, block), (*path, block)
                    front = (dealt >> np.uint64(BITS - fixed_bits(to))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(dealt), _numbered(to), np.int32)), pa.array(front),
                        pa.array((gray_rank(dealt) ^ _SIGN).view(np.int64))], ["path", "front", "rank"])

    return rows.select("path", "rank").mapInArrow(work, DEALT)


# --- the tree of one stretch of groups --------------------------------------------------------------------

def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n0, n1, …: 0 n0 times, 1 n1 times, …, and the place within each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class GrayTree:
    """Levels of nodes over distinct codes in Gray order; a node is a stretch of codes with equal leading bits."""

    def __init__(self, codes: np.ndarray, fixed: int):
        self.codes, self.levels = codes, []
        cuts = [*range(fixed, BITS, LEVEL), BITS]
        starts = None
        for depth, cut in enumerate(cuts):
            leading = codes >> np.uint64(BITS - cut) if cut else np.zeros(len(codes), np.uint64)
            begin = np.flatnonzero(np.concatenate(([True], leading[1:] != leading[:-1])))
            if starts is not None:
                first = np.searchsorted(begin, starts)
                self.levels[-1]["first"] = first
                self.levels[-1]["children"] = np.diff(np.append(first, len(begin)))
            own = np.uint64((1 << (cut - cuts[depth - 1])) - 1) if depth else np.uint64(0)
            self.levels.append({"own": leading[begin] & own, "size": np.diff(np.append(begin, len(codes)))})
            starts = begin

    def pairs(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of places of codes within the distance inside a group, in portions of bounded size."""
        top = np.flatnonzero(self.levels[0]["size"] > 1)
        stack = [(0, top, top, np.zeros(len(top), np.int8))]
        while stack:
            depth, a, b, far = stack.pop()
            if depth == len(self.levels) - 1:
                yield a, b
                continue
            level, below = self.levels[depth], self.levels[depth + 1]
            counts = level["children"][a] * level["children"][b]
            ends = np.cumsum(counts)
            if len(a) > 1 and ends[-1] > _PAIRS:
                half = max(1, min(len(a) - 1, int(np.searchsorted(ends, ends[-1] // 2))))
                stack += [(depth, a[half:], b[half:], far[half:]), (depth, a[:half], b[:half], far[:half])]
                continue
            owner, place = _spread(counts)
            wide = level["children"][b][owner]
            left, right = level["first"][a][owner] + place // np.maximum(wide, 1), level["first"][b][owner] + place % np.maximum(wide, 1)
            total = far[owner] + np.bitwise_count(below["own"][left] ^ below["own"][right]).astype(np.int8)
            keep = (total <= distance) & ((left < right) | ((left == right) & (below["size"][left] > 1)))
            if keep.any():
                stack.append((depth + 1, left[keep], right[keep], total[keep]))


def join_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each points at the smallest place known of its class) after the links a-b."""
    while len(a):
        left, right = label[a], label[b]
        apart = left != right
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        if len(a):
            np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
            while True:
                nearer = label[label]
                if (nearer == label).all():
                    break
                label = nearer
    return label


def _links(path: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is near within each group: one per fingerprint at most."""
    steps = _path(path)
    codes = from_gray_rank(ranks)
    label = np.arange(len(codes))
    for a, b in GrayTree(codes, fixed_bits(steps)).pairs(DISTANCE):
        label = join_up(label, a, b)
    moved = np.flatnonzero(label != np.arange(len(codes)))
    original = restore(codes, steps).view(np.int64)
    return original[moved], original[label[moved]]


def near_links(groups: DataFrame) -> DataFrame:
    """Links within the groups of a dealt table; distinct fingerprints are expected.

    Groups are hashed to tasks and read in Gray order; a task holds one stretch of whole groups at a time."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def out(path, rank):
            for number in np.unique(path):
                a, b = _links(int(number), rank[path == number])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64) ^ _SIGN))
            rows += batch.num_rows
            if rows >= _STEP:
                path, front, rank = (np.concatenate(x) for x in zip(*held))
                same = (path == path[-1]) & (front == front[-1])
                open_at = len(path) - int(same[::-1].argmin()) if not same.all() else 0
                if open_at:
                    yield from out(path[:open_at], rank[:open_at])
                held, rows = [(path[open_at:], front[open_at:], rank[open_at:])], 0
        if held:
            path, _, rank = (np.concatenate(x) for x in zip(*held))
            if len(path):
                yield from out(path, rank)

    sent = groups.repartition("path", "front").sortWithinPartitions("path", "rank")
    return sent.mapInArrow(work, "a long, b long")


def links(distinct: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(a, b)`` links that connect all fingerprints (column fp, distinct) within the distance."""
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = gray_rank(batch.column(0).to_numpy().view(np.uint64)) ^ _SIGN
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rank), np.int32)), pa.array(rank.view(np.int64))], ["path", "rank"])

    now = distinct.select("fp").mapInArrow(start, "path int, rank long")
    found = None
    for depth in range(1, DEALS + 1):
        dealt = land(deal(now))
        sizes = dealt.groupBy("path", "front").count()
        small, full = dealt, None
        if depth < DEALS:
            full = land(sizes.where(F.col("count") > group_rows).select("path", "front"))
            if not full.isEmpty():
                small = dealt.join(full, ["path", "front"], "left_anti")
            else:
                full = None
        some = near_links(small.select("path", "front", "rank"))
        found = some if found is None else found.unionByName(some)
        if full is None:
            break
        now = dealt.join(full, ["path", "front"], "left_semi")
    return found


def near_components(prints: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows of ``fingerprints`` (written ones: they are read twice) with ``root``, the component's smallest fingerprint, and
    ``component_id``, the smallest doc_id reachable over links of two bits or fewer."""
    distinct = land(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = land(components(links(distinct, group_rows)))
    linked = distinct.join(roots, F.col("fp") == F.col("node")).select(F.col("fp").alias("own"), "root", "first")
    ids = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(ids, "root").select("own", "root", "least")
    classes = distinct.join(named, F.col("fp") == F.col("own"), "left").select(
        F.col("fp").alias("class"), F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"))
    return prints.join(classes, F.col("fp") == F.col("class")).drop("class")


def one_of_each(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without their near copies: of each component the row with the smallest id stays (null ids last, one of
    equal rows); all columns as they are."""
    row = fresh(rows, "row")
    marked = land(rows.withColumn(row, F.monotonically_increasing_id()))
    found = land(near_components(land(fingerprints(marked, key, text, row))).select("root", "doc_id", "row"))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    losers = found.join(best.select(F.col("root").alias("of"), F.col("best.row").alias("kept")), F.col("root") == F.col("of")).where(
        F.col("row") != F.col("kept")).select(F.col("row").alias("lost"))
    return marked.join(losers, F.col(row) == F.col("lost"), "left_anti").drop(row)


def report(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return near_components(land(fingerprints(rows, key, text))).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
