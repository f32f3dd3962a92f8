"""BPE encoding and decoding against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from palisade.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def content():
    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(content):
    return Tokenizer.from_str(content)


@pytest.fixture(scope="module")
def model(content):
    return bpe.Model(content)


def ids_of(encoder, text):
    return np.frombuffer(b"".join(encoder.ids(text)), "<u4").tolist()


def test_every_character(model, library):
    """Each assigned character inside, beside and between words."""
    encoder = bpe.Encoder(model)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and bpe.unicodedata.category(chr(c)) not in ("Cn", "Co")]
    text = [f"a{chr(c)}b 1{chr(c)}- {chr(c)}" for c in points]
    want = library.encode_batch(text, add_special_tokens=False)
    assert not [hex(c) for c, t, w in zip(points, text, want) if ids_of(encoder, t) != w.ids]


def test_mixed_texts(model, library):
    rng, encoder = random.Random(1), bpe.Encoder(model)
    parts = ["aeiou", "th", "re", "a", "ab", "  ", "\n", "'s", "'", "’", "é", "é", "Σ", "İ", "ß", "漢", "字", "²", "<|endoftext|>", "<|startoftext|>",
             "<|ENDOFTEXT|>", "😀", "‍", "\x1c", "　", "́", "!!", "'LL", "QZ", "1", "\x85"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_long_words_by_window(model, library):
    """Words of many windows, among them repeated and overlapping merges; what is held never outgrows the window."""
    rng = random.Random(2)
    words = ["a" * 5000, "al" * 2500, "se" * 3001, "greg" * 900, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))]
    words += ["".join(rng.choice(["a", "be", "the", "re", "in", "ing", "s", "gre", "egg", "é", "漢"]) for _ in range(rng.randint(800, 4000))) for _ in range(30)]
    for word in words:
        machine, data, out, held = bpe.Transducer(model), word.encode(), [], 0
        step = rng.choice([1, 7, 100, 5000])
        for at in range(0, len(data), step):
            out += machine.feed(data[at:at + step])
            held = max(held, len(machine.held))
        assert held <= machine.window + model.lookahead
        assert out or len(data) < machine.window
        assert out + machine.finish() == library.encode(word, add_special_tokens=False).ids


def small(merges):
    """A model over a few letters, every byte in its vocabulary."""
    names = bpe.byte_letters()
    vocabulary = {x: i for i, x in enumerate([*names, *[x + "</w>" for x in names]])}
    for a, b in merges:
        vocabulary.setdefault(a + b, len(vocabulary))
    return json.dumps({"added_tokens": [], "normalizer": bpe.NORMALIZER, "pre_tokenizer": bpe.PRE_TOKENIZER, "post_processor": None, "decoder": None,
                       "model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": vocabulary, "merges": [list(m) for m in merges]}})


def test_lookahead_suffices_for_drawn_merge_lists():
    """Small merge lists reach their lookahead far more often than a real one: all words up to a length, emitted early."""
    rng = random.Random(3)
    for _ in range(60):
        known, merges = ["a", "b", "c"], []
        for _ in range(rng.randint(1, 9)):
            a, b = rng.choice(known), rng.choice(known)
            if a + b not in known and len(a + b) <= 6:
                merges.append((a, b))
                known.append(a + b)
        model = bpe.Model(small(merges))
        for _ in range(150):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60))).encode()
            machine, out = bpe.Transducer(model), []
            machine.window = model.lookahead + 2
            for k in range(len(word)):
                out += machine.feed(word[k:k + 1])
            whole = model.cut([model.inner[b] for b in word[:-1]] + [model.last[word[-1]]])
            assert out + machine.finish() == whole, (merges, word)


def test_lookahead_by_hand():
    assert bpe.Model(small([])).lookahead == 1
    assert bpe.Model(small([("a", "b")])).lookahead == 1
    # b c takes the b that a b needs, and a d decides over that: two rules back
    assert bpe.Model(small([("c", "d"), ("b", "c"), ("a", "b")])).lookahead == 3


def test_what_is_not_implemented_is_refused(content):
    read = json.loads(content)
    for change in ({"decoder": {"type": "ByteLevel"}}, {"normalizer": None}, {"model": read["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError):
            bpe.Model(json.dumps(read | change))
    with pytest.raises(ValueError):
        bpe.Model(small([("ab", "c")]))


def test_decoding_in_steps(model, library):
    rng = random.Random(4)
    for plain in (False, True):
        for _ in range(300):
            ids = [rng.randrange(49_408) for _ in range(rng.randint(0, 40))]
            machine, out, at = bpe.Decoder(model, plain), "", 0
            while at < len(ids):
                step = rng.randint(1, 5)
                out += machine.feed(np.array(ids[at:at + step]))
                at += step
            out += machine.finish()
            if plain:
                assert out == b"".join(machine.data[i] for i in ids).decode("utf-8", "replace")
            else:
                assert out == library.decode(ids, skip_special_tokens=False)
    for data in (b"\xf0\x9f\x98\x80\xe2\x82\xc3\xe0\x80\xf4\x90\xed\xa0z", bytes(range(256)), b"\xe6\xbc"):
        machine, out = bpe.Decoder(model, True), ""
        for b in data:
            out += machine._step(bytes([b]))
        assert out + machine.finish() == data.decode("utf-8", "replace")


def test_query_against_the_library(spark, content, library):
    docs = queries.documents(spark, SF)
    got = {r.doc_id: tuple(r)[1:] for r in bpe.report(docs, content).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_odd_rows(spark, content, library):
    texts = [None, "", " ", "Word " * 40_000, "x" * 100_000, "é" * 30_000 + " a", "same", "same"]
    rows = [(k if k else None, t, "a", 1, "b") for k, t in enumerate(texts)] + [(6, "same", "a", 1, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, ids_sha256 string")
    coded = bpe.encode(df, content)
    ids = sorted((r.doc_id or 0, r.ids) for r in coded.collect())
    want = sorted((d or 0, library.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in rows)
    assert ids == want
    readable = {r.doc_id: r.text for r in bpe.decode(coded, content, plain=True).collect()}
    assert readable[3].split() == texts[3].lower().split() and readable[5] == texts[5] + " " and readable[None] == ""
    assert sorted((r.doc_id or 0, r.n_tokens) for r in bpe.report(df, content).collect()) == [(d, len(i)) for d, i in want]
    assert bpe.report(df.limit(0), content).count() == 0 == bpe.decode(coded.limit(0), content).count()
