"""Token-id files: documents' ids in doc_id order as rANS blocks, and reading them back.

A store is a folder with two Parquet tables: ``frequencies`` (id, frequency), one table shared by all blocks and
counted over all documents; and ``blocks``, one row per block of whole documents. Spark's writer commits them,
so a lost executor or a repeated task leaves no half-written file, on any file system. A block row has:

* ``part``, ``block``: task and place in it; blocks ordered by both hold the documents in ascending doc_id order
* ``start``: ids before the block within its part; ``n_ids``: its ids; ``doc_ids``, ``lengths``: its documents
* ``states``, ``sizes``, ``payload``: the checkpoints and words of ``rans``, little-endian (uint64, uint32, uint32)
* ``payload_crc32``, ``ids_crc32``: checked when the block is read

Rules for odd input: a null or empty text is just the end id; a null doc_id comes first; equal doc_ids keep a row
each, ordered by their ids' checksum; an empty table gives an empty store; only the named columns are read.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import rans
from palisade.llm.memo import Memo
from palisade.session import checkpoint_root, land

END = 2
#: A block is closed at the first document's end at or after so many ids.
BLOCK_IDS = 1 << 20
#: Bytes of texts whose words are looked up together; a text is never cut.
PORTION = 1 << 22
BLOCKS = ("part int, block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, states binary, "
          "sizes binary, payload binary, payload_crc32 long, ids_crc32 long")


class WordEncoder:
    """Ids of whole texts by the tokenizers library, asked once per distinct word while it is remembered.

    The vocabulary drops white space and joins nothing across it, so a text's ids are its words' ids in turn.
    Words are cut at ASCII white space only; the library itself treats any other. A word of Latin letters, with or
    without marks behind, goes to the library's model directly (lower case, bytes spelled as the library spells
    them), where that was found to give what the whole library gives; any other word goes the whole way. Its letters
    and its marks are remembered each for themselves, so a word is asked for once in all its spellings.

    Texts are worked on many at a time: Arrow cuts them, finds their distinct words and puts ids in the words' places;
    only distinct runs of letters, distinct marks and the other words are looked up one by one."""

    LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿ"
    LATIN = r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
    MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenize = self.tokenizer.model.tokenize
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.letters, self.marks, self.others = Memo(self._spelled), Memo(self._asked, room=50_000), Memo(self._asked, room=50_000)
        self.spelling: dict[int, str] = {}
        if self.tokenizer.pre_tokenizer is not None:
            self.spelling = {ord(c): "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in self.LETTERS}
        tried = ["Hello", "ÄRGER,", "élève.", "don$", "ß!?", "Naïve...", "x", "straße)", "ÞÆÐ;", "the", "ññ&&&", self.LETTERS, self.LETTERS[:-2].upper() + "-"]
        self.direct = True
        self.direct = all(self.encode(w) == self._asked(w.encode()) for w in tried)

    def _asked(self, word: bytes) -> bytes:
        return array(self.kind, self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids).tobytes()

    def _spelled(self, letters: bytes) -> bytes:
        return array(self.kind, [t.id for t in self.tokenize(letters.decode("utf-8").translate(self.spelling))]).tobytes()

    def _words(self, words: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
        """Ids of these words in some order, and each word's place there."""
        letters = pc.ascii_rtrim(words, characters=self.MARKS)
        plain = pc.match_substring_regex(letters, self.LATIN) if self.direct else pa.repeat(False, len(words))
        marks = pc.utf8_ltrim(words.filter(plain), characters=self.LETTERS + self.LETTERS.upper())
        ids = pc.binary_join_element_wise(
            _looked_up(pc.utf8_lower(letters.filter(plain)), self.letters), _looked_up(marks, self.marks), pa.scalar(b"", pa.binary()))
        others = _looked_up(words.filter(pc.invert(plain)), self.others)
        flags = plain.to_numpy(zero_copy_only=False)
        return pa.concat_arrays([ids, others]), (np.where(flags, np.cumsum(flags), len(ids) + np.cumsum(~flags)) - 1).astype(np.int32)

    def encode_all(self, texts: pa.BinaryArray, last: bytes = b"") -> pa.BinaryArray:
        """Ids of each text, null being empty, with ``last`` behind."""
        words = pc.ascii_split_whitespace(texts.cast(pa.binary()).fill_null(b"").view(pa.string()))
        found, ends = words.values.dictionary_encode(), words.offsets.to_numpy()
        ids, places = self._words(found.dictionary)
        order = np.insert(places[found.indices.to_numpy()], ends[1:], len(ids))
        pieces = pa.concat_arrays([ids, pa.array([last], pa.binary())]).take(pa.array(order))
        _, cuts, data = pieces.buffers()
        cuts = np.frombuffer(cuts, np.int32)[ends + np.arange(len(ends))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts), data])

    def encode(self, text: str | bytes | None) -> bytes:
        return self.encode_all(pa.array([text.encode("utf-8") if isinstance(text, str) else text], pa.binary()))[0].as_py()


def _looked_up(words: pa.StringArray, memo: Memo) -> pa.BinaryArray:
    """What the memo has for each, asked once for equal ones."""
    found = words.dictionary_encode()
    keys = found.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    return pa.array(list(map(memo.__getitem__, keys)), pa.binary()).take(found.indices)


def _portions(batches: Iterator[pa.RecordBatch], size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes."""
    held, total = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
            if held and total + part.nbytes > size:
                yield pa.concat_batches(held)
                held, total = [], 0
            held.append(part)
            total += part.nbytes
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=2)
def encoder_of(model: str) -> WordEncoder:
    """One per worker process, kept over its tasks."""
    return WordEncoder(model)


def _added(counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Counts of each id, with these."""
    seen = np.bincount(ids, minlength=len(counts))
    seen[:len(counts)] += counts
    return seen


def token_ids(rows: DataFrame, model: str, key: str = "doc_id", text: str = "text", end: int = END, counted: bool = False) -> DataFrame:
    """``doc_id, ids``: little-endian unsigned ids of each whole text, with the end id; of 16 bits if the vocabulary allows, else of 32.
    ``counted``: also ``counts``, null for a document; after a task's documents, one row with nothing but how often each id came up."""
    names = ["doc_id", "ids", "counts"][:2 + counted]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        last, counts = array(encoder.kind, [end]).tobytes(), np.zeros(0, np.int64)
        for batch in _portions(batches):
            ids = encoder.encode_all(batch.column(1), last)
            columns = [batch.column(0), ids, pa.nulls(len(ids), pa.binary())]
            if counted:
                counts = _added(counts, np.frombuffer(ids.buffers()[2], f"<u{len(last)}", pc.sum(pc.binary_length(ids)).as_py() // len(last)))
            yield pa.RecordBatch.from_arrays(columns[:len(names)], names)
        if len(counts):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)

    return rows.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        work, "doc_id long, ids binary" + ", counts binary" * counted)


def id_type(model: str) -> str:
    """How ``token_ids`` spells them."""
    return f"<u{array(encoder_of(model).kind).itemsize}"


def count_ids(tokens: DataFrame) -> DataFrame:
    """``id, n`` over all documents, from the counts that the tasks of ``token_ids`` left."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                found = np.frombuffer(value, "<i8")
                total = np.zeros(max(len(counts), len(found)), np.int64)
                total[:len(counts)] += counts
                total[:len(found)] += found
                counts = total
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts[ids], pa.int64())], ["id", "n"])

    return tokens.where("counts IS NOT NULL").select("counts").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _to_blocks(frequencies: np.ndarray, kind: str):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("states", pa.binary()),
                        ("sizes", pa.binary()), ("payload", pa.binary()), ("payload_crc32", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, block, start = rans.Table(frequencies), TaskContext.get().partitionId(), 0, 0
        doc_ids, pieces, held = [], [], 0

        def close():
            nonlocal block, start, doc_ids, pieces, held
            ids = np.concatenate(pieces).astype("<u4")
            states, sizes, words = rans.encode(ids, table)
            payload = words.astype("<u4").tobytes()
            row = [part, block, start, len(ids), doc_ids, [len(p) for p in pieces], states.astype("<u8").tobytes(),
                   sizes.astype("<u4").tobytes(), payload, zlib.crc32(payload), zlib.crc32(ids.tobytes())]
            block, start, doc_ids, pieces, held = block + 1, start + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                pieces.append(np.frombuffer(value.as_buffer(), kind))
                held += len(pieces[-1])
                if held >= BLOCK_IDS:
                    yield close()
        if pieces:
            yield close()

    return work


def write(rows: DataFrame, model: str, folder: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Write the store; returns its folder, a new one in the shared folder unless one is given."""
    spark = rows.sparkSession
    folder = folder or f"{checkpoint_root(spark)}/tokens/{uuid.uuid4().hex}"
    landed = land(token_ids(rows, model, key, text, counted=True), compression="zstd")
    tokens, kind = landed.where("counts IS NULL"), id_type(model)
    counts = count_ids(landed).collect()  # a row per id of the vocabulary at most
    table = np.zeros(max((r.id for r in counts), default=-1) + 1, np.int64)
    for r in counts:
        table[r.id] = r.n
    frequencies = rans.scaled(table)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(frequencies) if f], "id long, frequency long").coalesce(1).write.parquet(f"{folder}/frequencies")
    order = ["doc_id", "mark", "row"]
    ordered = tokens.select("doc_id", "ids", F.crc32("ids").alias("mark"), F.monotonically_increasing_id().alias("row")).repartitionByRange(
        *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "ids").mapInArrow(_to_blocks(frequencies, kind), BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    return folder


def read_frequencies(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.schema("id long, frequency long").parquet(f"{folder}/frequencies").collect()
    table = np.zeros(max((r.id for r in rows), default=-1) + 1, np.uint64)
    for r in rows:
        table[r.id] = r.frequency
    return table


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ids little-endian unsigned 32-bit, start: ids before it in the store."""
    frequencies = read_frequencies(spark, folder)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(frequencies)
        for batch in batches:
            for row in range(batch.num_rows):
                part, block, start, length, doc_ids, lengths, states, sizes, payload, payload_crc, ids_crc = (c[row] for c in batch.columns)
                name = f"block {part}/{block}"
                if zlib.crc32(payload.as_buffer()) != payload_crc.as_py():
                    raise ValueError(f"{name}: its payload's checksum is wrong")
                ids = rans.decode(length.as_py(), np.frombuffer(states.as_buffer(), "<u8").reshape(-1, rans.LANES),
                                  np.frombuffer(sizes.as_buffer(), "<u4"), np.frombuffer(payload.as_buffer(), "<u4"), table).astype("<u4")
                raw = ids.tobytes()
                if zlib.crc32(raw) != ids_crc.as_py():
                    raise ValueError(f"{name}: its ids' checksum is wrong")
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([
                    doc_ids.values, pa.array(before[part.as_py()] + start.as_py() + ends - n), pa.array(n),
                    pa.array([raw[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), n.tolist())], pa.binary())], schema=schema)

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    # a row per writing task; each task gets them all, so that no document's ids are shuffled for its start
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before = dict(zip([r.part for r in sizes], accumulate([0] + [r.n for r in sizes])))
    return blocks.mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")


def report(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
