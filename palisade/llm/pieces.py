"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over a text character by character. For each position in a window of the longest piece it keeps the
best last piece and where that begins. Whenever the paths of all positions a later piece can still start from
run through one boundary, the ids up to it are committed and forgotten, so memory does not grow with the text.

For a unigram model a path's worth is its sum of scores. For a BPE model the right path is the one that the model's
merges give: a piece may follow another only if merging the two together leaves exactly these two, and then each
prefix has exactly one path. Both give the ids of the model's own definition. The pieces that end at a character are
found by walking their common beginnings, one step a character. No piece joins what stands before a space to what
follows it (checked when the model is read), so all paths meet there; the ids of a short stretch between two such
boundaries are remembered, with and without marks behind it, and the search gives all others.

Rules for odd input: a null text gives null ids and back null; an empty one no ids and back an empty text; a null
doc_id and equal rows are kept; an empty table gives an empty table; the extra columns of the input are kept, the
new ones get the names the caller chooses. Decoding restores a text exactly, but for U+2581, which the format uses
for the space, and models that normalise.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palisade.llm.memo import Memo

SPACE = "▁"
# Piece types and model kinds of the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            size = varint()
            value, at = data[at:at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at:at + size], at + size
        else:
            raise ValueError("not a model file")
        yield tag >> 3, value


class Found(dict):
    """``found[key]`` is ``make(key)``, worked out once while it is remembered; emptied when full."""

    def __init__(self, make: Callable, room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key):
        if len(self) >= self.room:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Model:
    """Pieces, scores and settings of a model file's content."""

    def __init__(self, content: bytes, searching: bool = True):
        """searching: also what encoding needs; decoding does without."""
        self.kind, self.prefix, self.squeeze, charsmap = UNIGRAM, True, True, b""
        self.pieces: list[tuple[str, float, int]] = []
        for number, value in _fields(content):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                charsmap, self.prefix, self.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or charsmap:
            raise ValueError("only unigram and BPE models without a character map can be read")
        # inside, the space is itself: strings of Latin text then take a byte a character
        self.pieces = [(p.replace(SPACE, " ") if t in (NORMAL, USER, UNUSED) else p, x, t) for p, x, t in self.pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER, UNUSED)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.characters = {p for p in self.ids if len(p) == 1}
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece holds a space after other characters")
        self.least = min((s for _, s, t in self.pieces if t == NORMAL), default=0.0) - UNKNOWN_PENALTY
        if not searching:
            return
        #: What may stand side by side inside a piece; between any other two characters all paths meet.
        self.inside = {piece[k:k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        self.beginnings = {piece[:k] for piece in self.ids for k in range(1, len(piece) + 1)}
        #: By the open beginning of a piece and a character: the longest one open after it, and the pieces that end there.
        self.step = Found(self._stepped, 200_000)
        #: By ``before`` times the number of pieces, plus ``piece``: whether they can stand side by side.
        self.fits = Found(lambda key: self._tried(*divmod(key, len(self.pieces))), 400_000)
        if self.kind == BPE:
            self._read_merges()

    def _stepped(self, read: str) -> tuple[str, tuple[tuple[int, int], ...]]:
        ends = [read[k:] for k in range(len(read))]
        ended = tuple((len(x), self.ids[x]) for x in ends if x in self.ids)
        return next((x for x in ends if x in self.beginnings), ""), ended

    def merged(self, text: str) -> list[str]:
        """A short text after all merges, the best score first, the leftmost among equals."""
        parts, self._last = list(text), None
        while len(parts) > 1:
            found = [(-self.pieces[i][1], k) for k, (a, b) in enumerate(pairwise(parts)) if (i := self.ids.get(a + b)) is not None]
            if not found:
                break
            k = min(found)[1]
            self._last = parts[k], parts[k + 1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _read_merges(self) -> None:
        """How each piece comes about: the two pieces of its last merge (none: a character). ``odd`` pieces are never the
        result of merges, or come about by a merge that ranks below one of its parts; pairs with them are tried out."""
        self.made: list[tuple[int, int] | None] = [None] * len(self.pieces)
        self.rank = [-score for _, score, _ in self.pieces]
        self.odd = set()
        for piece, number in self.ids.items():
            if len(piece) > 1:
                if self.merged(piece) != [piece]:
                    self.odd.add(number)
                else:
                    self.made[number] = tuple(self.ids.get(x, -1) for x in self._last)
        for number, parts in enumerate(self.made):
            if parts and (-1 in parts or any(x in self.odd or (self.made[x] and self.rank[x] >= self.rank[number]) for x in parts)):
                self.odd.add(number)

    def _tried(self, before: int, piece: int) -> bool:
        """Whether a BPE model can give these two pieces side by side (``before`` -1: the piece at the start).

        They stay apart if no merge over their seam ever comes first. That is read backwards: undo the later of the two
        last merges and ask whether what then touches at the seam would have merged before it. Among merges of one
        piece the left one comes first."""
        text = self.pieces
        if before < 0:
            return len(text[piece][0]) == 1 or self.merged(text[piece][0]) == [text[piece][0]]
        if before in self.odd or piece in self.odd:
            return self.merged(text[before][0] + text[piece][0]) == [text[before][0], text[piece][0]]
        made, rank, ids, left, right = self.made, self.rank, self.ids, before, piece
        limit, left_undone = float("inf"), False
        while True:
            over = ids.get(text[left][0] + text[right][0])
            if over is not None and (rank[over] < limit or (rank[over] == limit and not left_undone)):
                return False
            last_left, last_right = made[left], made[right]
            if last_left is None and last_right is None:
                return True
            left_undone = last_right is None or (last_left is not None and rank[left] > rank[right])
            if left_undone:
                limit, left = rank[left], last_left[1]
            else:
                limit, right = rank[right], last_right[0]

    def fallback(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode()] if self.bytes else [self.unknown]


def extend_bpe(model: Model, text: str, last: list[int], state: str) -> str:
    """Adds the best last piece for each position of the text that has none yet; from and to the beginning of a piece open there."""
    step, fits, many, add = model.step, model.fits, len(model.pieces), last.append
    for character in text[len(last) - 1:]:
        state, ended = step[state + character]
        for size, piece in ended:
            if fits[last[-size] * many + piece]:
                add(piece)
                break
        else:
            add(-1)
    return state


def start_of(model: Model, last: list[int], end: int) -> int:
    """Where the last piece of the path that ends there begins."""
    piece = last[end]
    return end - (len(model.pieces[piece][0]) if piece >= 0 else 1)


def trace(model: Model, text: str, last: list[int], end: int) -> list[int]:
    """Ids of the path that ends there."""
    out: list[int] = []
    while end > 0:
        piece = last[end]
        if piece >= 0:
            out.append(piece)
            end -= len(model.pieces[piece][0])
        else:
            out += reversed(model.fallback(text[end - 1]))
            end -= 1
    out.reverse()
    return out


class StreamingViterbi:
    """``feed`` characters, then ``finish``; both give the ids that have become certain."""

    #: Open characters from which on, and steps at which, a common boundary is looked for.
    LOOK = 256

    def __init__(self, model: Model):
        self.model, self.text = model, ""
        # for each open position, counted from the last commitment: best last piece (-1: a character without one),
        # and for a unigram model the worth of the path
        self.last, self.worth = [-1], [0.0]
        self.state = ""

    def feed(self, characters: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(characters), self.LOOK):
            self.text += characters[at:at + self.LOOK]
            if self.model.kind == BPE:
                self.state = extend_bpe(self.model, self.text, self.last, self.state)
            else:
                self._unigram()
            if len(self.text) >= self.LOOK:
                out += self._commit(range(max(0, len(self.text) - self.model.longest + 1), len(self.text) + 1))
        return out

    def finish(self) -> list[int]:
        return self._commit([len(self.text)])

    def _unigram(self) -> None:
        model, text = self.model, self.text
        for end in range(len(self.last), len(text) + 1):
            best = (self.worth[end - 1] + model.least, -1)
            for size in range(1, min(model.longest, end) + 1):
                number = model.ids.get(text[end - size:end])
                if number is not None and model.pieces[number][2] != UNUSED and self.worth[end - size] + model.pieces[number][1] > best[0]:
                    best = (self.worth[end - size] + model.pieces[number][1], number)
            self.worth.append(best[0])
            self.last.append(best[1])

    def _commit(self, positions) -> list[int]:
        """Ids up to the boundary that the paths of all these positions share; the rest stays open."""
        live = set(positions)
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(start_of(self.model, self.last, last))
        shared = live.pop()
        out = trace(self.model, self.text, self.last, shared)
        if shared:
            self.text, self.last = self.text[shared:], self.last[shared:]
            if self.worth[shared:]:
                self.worth = [w - self.worth[shared] for w in self.worth[shared:]]
        return out


class Codec:
    """Whole texts to little-endian 32-bit ids."""

    #: Spaces and what follows them up to the next space: no piece reaches over its ends.
    STRETCH = re.compile(" *[^ ]+| +")

    def __init__(self, content: bytes):
        self.model = Model(content)
        #: By what follows the first space of a stretch, and by a part without a space before it.
        self.memo, self.parts_memo = Memo(self._spaced, room=400_000), Memo(self._path, room=50_000)

    def _spaced(self, rest: str) -> bytes:
        """Ids of a space and what follows it."""
        return self._path(" " + rest) if rest.isalpha() else self._search(" " + rest)

    def _search(self, stretch: str) -> bytes:
        """A stretch's ids, by way of its parts between further boundaries that no piece reaches over."""
        inside = self.model.inside
        cuts = [0, *[k for k in range(1, len(stretch)) if stretch[k - 1:k + 1] not in inside], len(stretch)]
        if len(cuts) == 2:
            return self._path(stretch)
        first = stretch[:cuts[1]]
        return b"".join([self.memo[first[1:]] if first[0] == " " else self.parts_memo[first],
                         *[self.parts_memo[stretch[a:b]] for a, b in pairwise(cuts[1:])]])

    def _path(self, part: str) -> bytes:
        search = StreamingViterbi(self.model)
        return array("i", search.feed(part) + search.finish()).tobytes()

    def encode(self, text: str) -> bytes:
        if self.model.squeeze:
            text = re.sub(" +", " ", text.replace(SPACE, " ").strip(" "))
        if not text:
            return b""
        line = text.replace(SPACE, " ")
        if self.model.prefix:
            line = " " + line
        first, *rests = line.split(" ")
        if "" in rests:  # spaces in a row belong to the stretch that follows
            first, *stretches = self.STRETCH.findall(line)
            rests = [x[1:] for x in stretches]
            if first[0] == " ":
                rests.insert(0, first[1:])
                first = ""
        ids = b"".join(map(self.memo.__getitem__, rests))
        return self._search(first) + ids if first else ids


class Decoder:
    """Ids back to whole texts."""

    def __init__(self, content: bytes):
        self.model = model = Model(content, searching=False)
        self.parts = [p.encode() if t in (NORMAL, USER, UNUSED) else b"" for p, _, t in model.pieces]
        for value, i in model.bytes.items():
            self.parts[i] = bytes([value])

    def decode(self, ids) -> str:
        raw = b"".join(map(self.parts.__getitem__, ids))
        return (raw[1:] if self.model.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def decoder_of(content: bytes) -> Decoder:
    return Decoder(content)


@lru_cache(maxsize=2)
def codec_of(content: bytes) -> Codec:
    """One per worker process, kept over its tasks."""
    return Codec(content)


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(rows: DataFrame, model: bytes, text: str = "text", to: str = "ids", check: str | None = None) -> DataFrame:
    """The input with an array of ids for each whole text; a column named ``to`` is replaced. With ``check``, a column of that
    name says whether decoding the ids gave the text back, worked out where the ids are, so they are not sent on for it."""
    if text not in rows.columns or text in (to, check):
        raise ValueError("the text's column cannot take the ids")
    others = [c for c in rows.columns if c not in (to, check)]
    schema = T.StructType([f for f in rows.schema.fields if f.name in others] + [T.StructField(to, T.ArrayType(T.IntegerType(), False))]
                          + ([T.StructField(check, T.BooleanType())] if check else []))
    where = others.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, decoder = codec_of(model), decoder_of(model)
        for batch in batches:
            texts = batch.column(where).to_pylist()
            found = [None if t is None else codec.encode(t) for t in texts]
            ends = np.cumsum([0] + [0 if b is None else len(b) // 4 for b in found])
            values = np.frombuffer(b"".join(b for b in found if b), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), pa.int32()), pa.array(values, pa.int32()),
                                           mask=pa.array([b is None for b in found], pa.bool_()))
            same = [pa.array([t is None or decoder.decode(array("i", b)) == t for t, b in zip(texts, found)], pa.bool_())] if check else []
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, *same], schema.names)

    return rows.select(*others).mapInArrow(work, schema)


def decode(rows: DataFrame, model: bytes, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The input with the text of each array of ids; a column named ``to`` is replaced."""
    schema = _with_column(rows, to, T.StringType())
    others = [c for c in rows.columns if c != to]
    where = others.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_of(model)
        for batch in batches:
            column = batch.column(where)
            texts = [decoder.decode(v.values.to_pylist()) if v.is_valid else None for v in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [f.name for f in schema.fields])

    return rows.select(*others).mapInArrow(work, schema)
