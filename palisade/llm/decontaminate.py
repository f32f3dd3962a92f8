"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

An item is found in a document if the document has at least ``SIMILARITY`` of the item's distinct five-word shingles.
Items are partitioned by their number of shingles, n, into powers of two. Each partition has one sketch length: an
item's sketch is that many of its smallest shingle hashes (bottom-k MinHash). The length is the number of shingles
that the largest item of the partition may miss, plus one; so a document that contains the item has at least one sketch
hash, and the number of sketch hashes that an item of size n may miss is known exactly. The document side is not
sketched, because a short item vanishes in a long document's own minima: all shingles of the whole text are looked up,
and documents with fewer shingles than a partition's smallest item needs are not its candidates. So nothing is missed.

A Bloom filter of the sketches, of bounded size, goes to the tasks that scan the texts; documents that hit it are
written with their hits, joined with the sketches, and the pairs that remain are compared shingle by shingle.

Rules for odd input: null or empty texts, and items of fewer than five words, match nothing; a null doc_id or item_id is
an id like any other; of repeated ids the greatest containment is reported; an empty table on either side gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.words import mix, shingle_hashes, shingles, word_hashes
from palisade.session import land

WIDTH = 5
#: Share of an item's shingles, in tenths, so that sizes are compared in whole numbers.
SIMILARITY = 8
#: Bits of the filter for each sketch hash, its probes, and its bound: 2**28 bits are 32 MB.
FILTER_BITS, PROBES, MOST_BITS = 64, 3, 28
_PAGE = 1 << 15


def needed(n):
    """Shingles of n that have to be found."""
    return -(-n * SIMILARITY // 10)


def sketch_length(n: int) -> int:
    """Sketch length in the size partition of n: one more than its largest item may miss."""
    most = (1 << n.bit_length()) - 1
    return most - needed(most) + 1


def sketches(items: DataFrame, text: str = "text") -> DataFrame:
    """``item, n, least, most, hash``: a row per sketch hash of each distinct item text (column ``item``); least: shingles
    of the smallest item of its partition, most: sketch hashes it may miss."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for place, hashes in word_hashes(texts):
                found = np.unique(shingle_hashes(hashes, WIDTH))
                n = len(found)
                if not n:
                    continue
                k = min(sketch_length(n), n)
                # may miss n - needed(n) in all; if the sketch is longer, so many of its hashes must be there
                must = max(1, k - (n - needed(n)))
                least = 1 << (n.bit_length() - 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([texts[place]] * k), pa.array([n] * k, pa.int64()), pa.array([needed(least)] * k, pa.int64()),
                    pa.array([must] * k, pa.int64()), pa.array(found[:k].view(np.int64))], ["item", "n", "least", "must", "hash"])

    distinct = items.select(F.col(text).alias("item")).where(F.col("item").isNotNull()).distinct()
    return distinct.mapInArrow(work, "item string, n long, least long, must long, hash long")


class Filter:
    """Bits by hash, probed at several places."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        found, h = [], hashes
        for _ in range(PROBES):
            h = mix(h + np.uint64(1))
            found.append((h >> np.uint64(64 - size)).astype(np.int64))
        return found

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the set."""
        at = np.arange(len(hashes))
        h = hashes
        for _ in range(PROBES):
            h = mix(h + np.uint64(1))
            place = (h >> np.uint64(64 - self.size)).astype(np.int64)
            hit = (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            at, h = at[hit], h[hit]
            if not len(at):
                break
        return at


def build_filter(table: DataFrame) -> Filter:
    """The filter of all sketch hashes; pages of bits are put together by Spark, and only they come to the driver."""
    count = table.count()
    size = min(MOST_BITS, max(15, int(max(1, count * FILTER_BITS) - 1).bit_length()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in Filter.places(batch.column(0).to_numpy().view(np.uint64), size):
                yield pa.RecordBatch.from_arrays([pa.array(place + 1)], ["bit"])

    pages = table.select("hash").mapInArrow(work, "bit long").groupBy(F.bitmap_bucket_number("bit").alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros((1 << size) // 8, np.uint8)
    for row in pages:
        start = (row.page - 1) * _PAGE // 8
        bits[start:start + _PAGE // 8] = np.frombuffer(row.bits, np.uint8)
    return Filter(bits, size)


def _hits(rows: DataFrame, sieve: Filter, key: str, text: str) -> DataFrame:
    """Documents with a hash in the filter, their shingle count and those hashes."""
    shared = rows.sparkSession.sparkContext.broadcast((sieve.bits, sieve.size))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Filter(*shared.value)
        for batch in batches:
            keep, counts, hits = [], [], []
            for place, hashes in word_hashes(batch.column(1).to_pylist()):
                found = shingle_hashes(hashes, WIDTH)
                at = sieve.has(found)
                if len(at):
                    keep.append(place)
                    counts.append(len(found))
                    hits.append(np.unique(found[at]).view(np.int64))
            if keep:
                taken = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(counts, pa.int64()),
                                                  pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "text", "m", "hits"])

    return rows.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        work, "doc_id long, text string, m long, hits array<long>")


def _verified(pairs: DataFrame) -> DataFrame:
    """``doc_id, body, item, shared, n`` of the pairs that contain the item; pairs of a document follow each other."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            out = []
            for row, doc_id, text, body, item in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if row != last:
                    last, own = row, shingles(text, WIDTH)
                asked = shingles(item, WIDTH)
                shared = len(asked & own)
                if shared >= needed(len(asked)):
                    out.append((doc_id, body, item, shared, len(asked)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (
                    pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "body", "item", "shared", "shingles"])

    return pairs.select("row", "doc_id", "text", "body", "item").mapInArrow(
        work, "doc_id long, body long, item string, shared long, shingles long")


def contained(rows: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """``doc_id, body, item, shared, shingles``: a row per document row and distinct item text found in it; body: xxhash64
    of the document's text."""
    table = land(sketches(items, item_text))
    hits = land(_hits(rows, build_filter(table), key, text).withColumn("row", F.monotonically_increasing_id()))
    found = hits.select("row", "m", F.explode("hits").alias("hash"))
    candidates = found.join(table, "hash").where(F.col("m") >= F.col("least")).groupBy("row", "item", "must").agg(
        F.count("*").alias("shared")).where(F.col("shared") >= F.col("must")).select("row", "item")
    pairs = hits.select("row", "doc_id", "text", F.xxhash64("text").alias("body")).join(candidates, "row")
    return _verified(pairs.sortWithinPartitions("row"))


def report(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, shared, shingles, containment`` of all pairs found."""
    named = items.select("item_id", F.col("text").alias("said"))
    found = contained(rows, items).join(named, F.col("item") == F.col("said"))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        (F.col("shared") / F.col("shingles")).alias("containment"), "shared", "shingles")).alias("best")).select(
        "doc_id", "item_id", "best.shared", "best.shingles", "best.containment")


def clean(rows: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows in which no item is found; all columns as they are."""
    found = contained(rows, items, key, text).select(F.col("doc_id").alias("bad_id"), F.col("body").alias("bad_text")).distinct()
    bad = land(found)
    marked = rows.alias("own")
    return marked.join(bad.alias("bad"), F.col(f"own.{key}").eqNullSafe(F.col("bad.bad_id"))
                       & (F.xxhash64(F.col(f"own.{text}")) == F.col("bad.bad_text")), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM b, unnest(range(1, len(w) - 3)) AS t(i)),
n AS (SELECT item_id, count(*) AS shingles FROM bs GROUP BY item_id),
x AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, shingles, shared / shingles AS containment
FROM x JOIN n USING (item_id) WHERE shared * 10 >= shingles * 8
"""
