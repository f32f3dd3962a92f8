"""BPE encoding by a streaming transducer with bounded lookahead, and incremental decoding.

A merge can only change tokens before it through rules of falling priority, each of which takes the token in front of the
place that changed: its right part must begin with the left part of the rule before. The longest such chain in the merge
list, counted in bytes, is the *lookahead*: how a prefix is cut does not depend on anything further ahead. So the transducer
keeps a window of bytes, cuts it, emits tokens that end at least the lookahead before its end, and goes on behind them; a cut
that stays is a place no rule crosses, hence the rest can be cut by itself. State is one window, however long a word is.
Decoding is a machine over bytes too: whole characters are emitted, at most three bytes of an unfinished one are kept.

Texts go through in windows that end before white space: normalising (NFC, one letter at a time to lower case), splitting
into words, and the transducer for each word. A bounded memo of short words stands in front of the transducer; it changes
no result. Only what a tokenizer file of this family says is accepted; other settings raise ``ValueError``.

Rules for odd input: a null text is an empty one and has no ids; ids outside the vocabulary cannot be decoded and raise; a
null or repeated doc_id gets its row; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.memo import Memo

#: Characters of a window of text, and ids decoded at once.
WINDOW, IDS = 1 << 15, 1 << 14
#: Words up to this length are remembered, so many in each of two generations.
LONGEST, ROOM = 40, 200_000
#: White space as the tokenizer's pattern has it; a fixed value.
SPACE = "\t-\r \x85\xa0  -     　"
#: The settings of a tokenizer file that are implemented; fixed values.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_SHORT = 24
#: A rule is one number, its rank above the id it makes, so that the least is the first; this one comes after every rule.
_IDS_BELOW, _NO_RULE = 1 << 32, 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _ranges(kind: str) -> str:
    """A character class of all code points of a general category."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@functools.cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Words of ASCII texts, words of any text; by the interpreter's own tables of letters and numbers."""
    def of(letter: str, number: str) -> re.Pattern:
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+")

    return of("a-z", "0-9"), of(_ranges("L"), _ranges("N"))


def normalised(text: str) -> str:
    """NFC and lower case, each letter by itself: a sigma at a word's end is like any other."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """The text in parts that begin with white space, about ``size`` characters or as long as there is none."""
    at = 0
    while len(text) - at > size:
        cut = _ASCII_SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


_ASCII_SPACE = re.compile("[ \t\n\r]")


def words(part: str) -> list[str]:
    ascii_words, any_words = _patterns()
    if part.isascii():
        return ascii_words.findall(part.lower())
    return any_words.findall(normalised(part))


class Model:
    """Vocabulary, merge list and lookahead of a tokenizer file's content."""

    def __init__(self, content: str):
        read = json.loads(content)
        model = read["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if read["normalizer"] != NORMALIZER or read["pre_tokenizer"] != PRE_TOKENIZER or read["post_processor"] or read["decoder"]:
            raise ValueError("normalizer, pre_tokenizer, post_processor or decoder are not of the kind implemented")
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain BPE model")
        self.added = {t["content"]: t["id"] for t in read["added_tokens"]}
        if any(t[k] for t in read["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with conditions are not implemented")
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        vocabulary = model["vocab"]
        self.strings = {i: t for t, i in (vocabulary | self.added).items()}
        letters = byte_letters()
        self.inner = [vocabulary[x] for x in letters]
        self.last = [vocabulary[x + self.suffix] for x in letters]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        if any(t not in vocabulary for a, b in pairs for t in (a, b, a + b)):
            raise ValueError("a rule uses or makes a token that the vocabulary does not have")
        self.size = dict.fromkeys(self.inner + self.last, 1)  # bytes of a token
        self.rules: dict[tuple[int, int], int] = {}
        self.lookahead = self._read([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])

    def _read(self, merges: list[tuple[int, int, int]]) -> int:
        """Rules by pair; the longest chain, in the order of priority. ``before[t]`` is the longest chain so far that ends in a
        rule with t on its left; the rule's right part begins with t if t is on the left edge of how it was made."""
        edge: dict[int, set[int]] = {t: {t} for t in self.size}
        before: dict[int, int] = {}
        longest = 1
        for rank, (left, right, made) in enumerate(merges):
            if left not in edge or right not in edge:
                raise ValueError("a rule uses a token that no earlier rule makes")
            if (left, right) in self.rules or made in edge:
                raise ValueError("a token is made twice")
            self.rules[left, right] = rank * _IDS_BELOW + made
            self.size[made] = self.size[left] + self.size[right]
            chain = self.size[left] + max(before.get(t, 0) for t in edge[right])
            before[left] = max(before.get(left, 0), chain)
            longest = max(longest, chain)
            edge[made] = {made} | edge[left]
        return longest

    def cut(self, tokens: list[int]) -> list[int]:
        """Merge a list of tokens: always the pair of the highest priority, the leftmost of equal ones."""
        return self._cut_short(tokens) if len(tokens) <= _SHORT else self._cut_long(tokens)

    def _cut_short(self, tokens: list[int]) -> list[int]:
        rule = self.rules.get
        found = [rule(pair, _NO_RULE) for pair in zip(tokens, tokens[1:])]
        while found:
            best = min(found)
            if best == _NO_RULE:
                break
            at = found.index(best)
            tokens[at] = best % _IDS_BELOW
            del tokens[at + 1]
            del found[at]
            if at:
                found[at - 1] = rule((tokens[at - 1], tokens[at]), _NO_RULE)
            if at < len(found):
                found[at] = rule((tokens[at], tokens[at + 1]), _NO_RULE)
        return tokens

    def _cut_long(self, tokens: list[int]) -> list[int]:
        rules, end = self.rules, len(tokens)
        after, ahead = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(rule, k) for k in range(end - 1) if (rule := rules.get((tokens[k], tokens[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, k = heapq.heappop(heap)
            if tokens[k] < 0 or (n := after[k]) == end or rules.get((tokens[k], tokens[n])) != best:
                continue  # one of the two has been merged since
            made = best % _IDS_BELOW
            tokens[k], tokens[n] = made, -1
            after[k] = after[n]
            if after[k] < end:
                ahead[after[k]] = k
                if (rule := rules.get((made, tokens[after[k]]))) is not None:
                    heapq.heappush(heap, (rule, k))
            if (p := ahead[k]) >= 0 and (rule := rules.get((tokens[p], made))) is not None:
                heapq.heappush(heap, (rule, p))
        return [t for t in tokens if t >= 0]


class Transducer:
    """Bytes of one word in, ids out as soon as nothing that may follow can change them."""

    def __init__(self, model: Model):
        self.model, self.held = model, bytearray()
        self.window = 2 * model.lookahead + 2

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.model.lookahead):
            self.held += data[at:at + self.model.lookahead]
            if len(self.held) >= self.window:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        tokens = self.model.cut([self.model.inner[b] for b in self.held])
        end, safe, count = 0, len(self.held) - 1 - self.model.lookahead, 0  # the last byte may turn out to end the word
        for token in tokens:
            if end + self.model.size[token] > safe:
                break
            end += self.model.size[token]
            count += 1
        del self.held[:end]
        return tokens[:count]

    def finish(self) -> list[int]:
        if not self.held:
            return []
        tokens = [self.model.inner[b] for b in self.held[:-1]] + [self.model.last[self.held[-1]]]
        self.held = bytearray()
        return self.model.cut(tokens)


class Encoder:
    """``ids(text)`` gives the ids of a text part by part, as little-endian unsigned 32-bit integers."""

    def __init__(self, model: Model):
        self.model, self.transducer = model, Transducer(model)
        self.memo = Memo(self._word, ROOM, LONGEST)

    def _word(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        ids = self.transducer.feed(data) + self.transducer.finish()
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> Iterator[bytes]:
        special, at = self.model.special, 0
        if special is not None:
            for found in special.finditer(text):
                yield from self._plain(text[at:found.start()])
                yield struct.pack("<I", self.model.added[found.group()])
                at = found.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[bytes]:
        for part in windows(text):
            yield b"".join(map(self.memo.__getitem__, words(part)))


class Decoder:
    """Ids in, text out. As the library writes it when a file names no decoder: the tokens as they stand in the vocabulary,
    a space between them. ``plain``: the bytes that the tokens stand for, a space after each word's last token; what is not
    UTF-8 becomes U+FFFD."""

    def __init__(self, model: Model, plain: bool = False):
        self.held, self.between = b"", b"" if plain else b" "
        self.begun = False
        if plain:
            byte_of = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}

            def data(token: str) -> bytes:
                if token in model.added:
                    return token.encode()
                end = token.endswith(model.suffix) and bool(model.suffix)
                return b"".join(byte_of[x] for x in (token[:-len(model.suffix)] if end else token)) + b" " * end

        else:
            def data(token: str) -> bytes:
                return token.encode()

        self.data: list[bytes | None] = [None] * (max(model.strings) + 1)  # an id without a token cannot be joined
        for i, token in model.strings.items():
            self.data[i] = data(token)

    def feed(self, ids: np.ndarray) -> str:
        out = []
        for at in range(0, len(ids), IDS):
            data = self.between.join(map(self.data.__getitem__, ids[at:at + IDS].tolist()))
            out.append(self._step((self.between if self.begun else b"") + data))
            self.begun = True
        return "".join(out)

    def _step(self, data: bytes) -> str:
        """The characters that are whole; the bytes of one that is not are held for the next step."""
        data = self.held + data
        keep = unfinished(data)
        self.held = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held, self.begun = self.held.decode("utf-8", "replace"), b"", False
        return rest


def unfinished(data: bytes) -> int:
    """How many bytes at the end may be the beginning of a character that is not over."""
    for k in range(1, min(3, len(data)) + 1):
        byte = data[-k]
        if byte & 0xC0 == 0x80:
            continue
        wanted = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
        if wanted <= k:
            return 0
        if k > 1:  # the second byte is narrower after some first bytes
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
            if not low <= data[1 - k] <= high:
                return 0
        return k
    return 0


@functools.lru_cache(1)
def encoder(content: str) -> Encoder:
    """One for each Python worker, so that its memo serves all its tasks."""
    return Encoder(Model(content))


_TYPES = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _mapped(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work()`` gives what turns a value of the second column into the columns after the first, which stays."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in source:
            made = [step(v.as_py()) for v in batch.column(1)]
            columns = [pa.array([m[k] for m in made], _TYPES[kind]) for k, kind in enumerate(kinds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], list(names))

    return rows.mapInArrow(batches, schema)


def encode(rows: DataFrame, content: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` (array<int>) of every whole text."""
    def work():
        own = encoder(content)
        return lambda value: (np.frombuffer(b"".join(own.ids(value or "")), "<u4").astype(np.int32),)

    return _mapped(rows.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), work, "doc_id long, ids array<int>")


def decode(rows: DataFrame, content: str, plain: bool = False) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids are none. ``plain``: readable text instead of the library's."""
    def work():
        own = Decoder(encoder(content).model, plain)
        return lambda value: (own.feed(np.array(value or [], np.int64)) + own.finish(),)

    return _mapped(rows.select("doc_id", "ids"), work, "doc_id long, text string")


def report(rows: DataFrame, content: str) -> DataFrame:
    """Per document the number of ids, and the hashes of its ids and of the text they decode to. Ids are hashed and decoded
    as they come; no document's ids are held together."""
    def work():
        own = encoder(content)
        back = Decoder(own.model)

        def step(text: str | None) -> tuple[int, str, str]:
            count, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
            for part in own.ids(text or ""):
                count += len(part) // 4
                ids.update(part)
                decoded.update(back.feed(np.frombuffer(part, "<u4")).encode())
            decoded.update(back.finish().encode())
            return count, ids.hexdigest(), decoded.hexdigest()

        return step

    return _mapped(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work,
                   "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
