"""Language of whole texts by a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes (lower case) are cut into windows of ``WINDOW`` bytes. Filters of several widths run over the
embedded bytes of a window, the largest response of each filter feeds a softmax, and a text's probabilities are the
means over all its windows, weighted by their letters. In use, a filter's response is read from tables over byte pairs
that are worked out once from the weights: the same sums, without a product per byte.

Rules for odd input: a null text, or one without a letter, is ``und`` with score 0; among equal probabilities the
language that sorts first wins; without labelled rows everything is ``und``; a null doc_id is neither trained on nor
held out by chance (it counts as the empty text); equal rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
WINDOW, EMBEDDING, FILTERS, WIDTHS = 256, 8, 12, (2, 3, 4)
#: The bounded sample: windows per language, drawn by hash; languages at most; passes over it.
SAMPLE, LANGUAGES, EPOCHS, BATCH, RATE, SEED = 1200, 200, 12, 64, 0.01, 7
FOLDS = 5
#: Windows worked on at once.
_MANY = 128


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def cut(raw: bytes) -> np.ndarray:
    """All windows of a text, the last one filled up with zeros."""
    count = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(count * WINDOW, b"\0"), np.uint8).reshape(count, WINDOW)


@dataclass
class ByteNet:
    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    shift: np.ndarray

    def tables(self) -> dict[int, list[tuple[int, int, np.ndarray]]]:
        """Per width: (offset, bytes, responses) parts whose sum is the convolution."""
        out: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for width, kernel in self.filters.items():
            single = [self.embedding @ kernel[k] for k in range(width)]
            out[width] = [(k, 2, np.ascontiguousarray((single[k][:, None] + single[k + 1][None]).reshape(-1, FILTERS)).astype(np.float32))
                          if k + 1 < width else (k, 1, single[k].astype(np.float32)) for k in range(0, width, 2)]
        return out

    def probabilities(self, windows: np.ndarray, tables=None) -> np.ndarray:
        tables = tables or self.tables()
        out = np.empty((len(windows), len(self.languages)))
        for at in range(0, len(windows), _MANY):
            part = windows[at:at + _MANY]
            single = part.astype(np.int64)
            pair = single[:, :-1] * 256 + single[:, 1:]
            pooled = []
            for width, parts in tables.items():
                count = WINDOW - width + 1
                total = None
                for offset, size, table in parts:
                    index = (pair if size == 2 else single)[:, offset:offset + count]
                    response = table.take(index, axis=0)
                    total = response if total is None else np.add(total, response, out=total)
                pooled.append(total.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
            out[at:at + _MANY] = _softmax(hidden @ self.weights + self.shift)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        tables = self.tables() if self.languages else None
        names, scores = [], []
        for text in texts:
            if not self.languages or not text or not any(map(str.isalpha, text)):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            windows = cut(prepared(text))
            total, mass = np.zeros(len(self.languages)), 0.0
            for at in range(0, len(windows), 16 * _MANY):
                part = windows[at:at + 16 * _MANY]
                letters = (((part >= 97) & (part <= 122)) | (part >= 128)).sum(axis=1) + 1e-3
                total += letters @ self.probabilities(part, tables)
                mass += letters.sum()
            best = int(np.argmax(total))
            names.append(self.languages[best])
            scores.append(float(min(1.0, total[best] / mass)))
        return names, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str]) -> ByteNet:
    """Adam on the cross-entropy; a gradient reaches only the place of each filter's largest response."""
    rng = np.random.default_rng(SEED)
    joined = FILTERS * len(WIDTHS)
    p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "b": np.zeros(joined), "s": np.zeros(len(languages)),
         "w": rng.normal(0, 0.3, (joined, len(languages)))}
    p |= {f"f{w}": rng.normal(0, 0.5 / w, (w, EMBEDDING, FILTERS)) for w in WIDTHS}
    p["e"][0] = 0
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    steps = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            x, y = windows[order[at:at + BATCH]].copy(), labels[order[at:at + BATCH]]
            short = rng.random(len(x)) < 0.3  # texts can be shorter than a window
            for k in np.flatnonzero(short):
                x[k, rng.integers(8, WINDOW):] = 0
            embedded = p["e"][x]
            rows, hidden, places = np.arange(len(x)), [], {}
            for w in WIDTHS:
                flat = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * EMBEDDING)
                response = flat @ p[f"f{w}"].reshape(-1, FILTERS)
                places[w] = response.argmax(axis=1), flat
                hidden.append(response.max(axis=1))
            before = np.concatenate(hidden, axis=1) + p["b"]
            h = np.maximum(before, 0)
            out = _softmax(h @ p["w"] + p["s"])
            out[rows, y] -= 1
            out /= len(x)
            back = (out @ p["w"].T) * (before > 0)
            g = {"w": h.T @ out, "s": out.sum(axis=0), "b": back.sum(axis=0), "e": np.zeros_like(p["e"])}
            for n, w in enumerate(WIDTHS):
                own = back[:, n * FILTERS:(n + 1) * FILTERS]
                place, flat = places[w]
                patch = flat[rows[:, None], place]  # rows, filters, w * embedding
                g[f"f{w}"] = np.einsum("bf,bfk->kf", own, patch).reshape(w, EMBEDDING, FILTERS)
                to = np.einsum("bf,wef->bfwe", own, p[f"f{w}"])
                np.add.at(g["e"], x[rows[:, None, None], place[:, :, None] + np.arange(w)], to)
            g["e"][0] = 0
            steps += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in p:
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.001 * (g[k] ** 2 - square[k])
                p[k] -= rate * (mean[k] / (1 - 0.9**steps)) / (np.sqrt(square[k] / (1 - 0.999**steps)) + 1e-8)
    return ByteNet(languages, p["e"], {w: p[f"f{w}"] for w in WIDTHS}, p["b"], p["w"], p["s"])


def train(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteNet:
    """Learns from a bounded sample of labelled rows that are not held out: windows at places drawn by hash."""
    usable = rows.select(F.col(key).alias("key"), F.col(text).alias("whole"), F.col(lang).alias("label")).where(
        F.col("key").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("key")))
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect()}
    if not counts:
        return ByteNet([], np.zeros((256, EMBEDDING)), {}, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    # first a hash share of each language (about four times the sample), then exactly the rows with the smallest hashes
    share = F.create_map(*[x for label, n in counts.items() for x in (F.lit(label), F.lit(min(1.0, 4.0 * SAMPLE / n)))])
    draw = F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 30))
    drawn = usable.where(F.element_at(share, F.col("label")) * (1 << 30) >= draw)
    room = F.greatest(F.length("whole") - WINDOW, F.lit(0)) + 1
    place = (F.pmod(F.xxhash64("key", F.lit("place")), room) + 1).cast("int")
    pieces = drawn.where(F.col("whole").rlike(r"\p{L}")).select("label", draw.alias("draw"), F.substring("whole", place, F.lit(WINDOW)).alias("piece"))
    ranked = pieces.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("draw", "piece"))).where(F.col("n") <= SAMPLE)
    found = ranked.select("label", "draw", "piece").orderBy("label", "draw", "piece").collect()
    if not found:
        return ByteNet([], np.zeros((256, EMBEDDING)), {}, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    languages = sorted({r.label for r in found})
    windows = np.stack([cut(prepared(r.piece) or b" ")[0] for r in found])
    return fit(windows, np.array([languages.index(r.label) for r in found]), languages)


def identify(rows: DataFrame, model: ByteNet, text: str = "text", to: str = "lang_pred", score: str = "score") -> DataFrame:
    """The input with the language and its probability; columns of these names are replaced."""
    kept = [f for f in rows.schema.fields if f.name not in (to, score)]
    schema = T.StructType([*kept, T.StructField(to, T.StringType()), T.StructField(score, T.DoubleType())])
    where = [f.name for f in kept].index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(where).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return rows.select(*[f.name for f in kept]).mapInArrow(work, schema)


def report(rows: DataFrame, model: ByteNet) -> DataFrame:
    asked = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(asked, model).select("doc_id", "held_out", "lang_pred", "score")
