"""Decontamination, SentencePiece, token files, language ID and web text against brute force, and odd input."""

import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.llm import decontaminate, langid, pieces, queries, rans, tokenfile, webtext, words
from palisade.llm.memo import Memo
from palisade.session import read_table

COLUMNS = "doc_id long, text string, ids string, item string, row long, score string"


def table(spark, rows):
    """Rows of (doc_id, text) with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", 3, "z") for i, t in rows], COLUMNS)


# --- decontamination --------------------------------------------------------------------------------------

def said(rng, n):
    return " ".join(rng.choice(["lo", "mi", "ra", "te", "ku", "no"]) + rng.choice(["na", "so", "ve", "pi"]) + str(rng.randint(0, 40)) for _ in range(n))


def brute(docs, items):
    out = set()
    for d, t in docs:
        have = words.shingles(t, 5)
        for i, x in items:
            asked = words.shingles(x, 5)
            if asked and 10 * len(asked & have) >= 8 * len(asked):
                out.add((d, i, len(asked & have), len(asked)))
    return out


def test_decontamination_is_complete(spark):
    rng = random.Random(3)
    items = [(i, said(rng, rng.choice([3, 5, 6, 9, 14, 30, 33, 60, 130]))) for i in range(60)] + [(60, None), (61, ""), (None, said(rng, 12))]
    items.append((62, items[5][1]))
    docs = [(1, None), (2, ""), (3, "too short")]
    for k in range(80):
        parts = [said(rng, rng.randint(0, 200))]
        for _, x in rng.sample(items, 3):
            tokens = (x or "").upper().split()
            for _ in range(rng.randint(0, 4)):  # near misses on either side of the limit
                if tokens:
                    tokens[rng.randrange(len(tokens))] = "changed"
            parts.append(", ".join(tokens) + said(rng, 20))
        docs.append((k + 10, "\n".join(parts)))
    docs += [(10, docs[5][1]), (None, items[7][1]), (200, said(rng, 60_000) + " " + items[20][1])]
    rows = table(spark, docs)
    marks = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(rows, marks).collect()
    best = {}
    for d, i, a, b in brute(docs, items):
        best[d, i] = max(best.get((d, i), (0, 0)), (a, b))
    assert {(r.doc_id, r.item_id): (r.shared, r.shingles) for r in got} == best and len(got) == len(best) > 40
    bad = {t for d, t in docs for x in [brute([(d, t)], items)] if x}
    kept = decontaminate.clean(rows, marks)
    assert kept.columns == rows.columns
    assert sorted((str(r.doc_id), r.text or "-") for r in kept.collect()) == sorted((str(d), t or "-") for d, t in docs if t not in bad)


def test_decontamination_of_nothing(spark):
    rows, none = table(spark, [(1, "a b c d e f g")]), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(rows, none).count() == 0 and decontaminate.clean(rows, none).count() == 1
    assert decontaminate.report(rows.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_word_hashes_agree_with_words(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", "..", "Ünï-code ÉTÉ ǅ 日本語 42x", "a" * 300, *("".join(rng.choice("aB é.\n9ß") for _ in range(rng.randint(0, 90))) for _ in range(200))]
    own = {}
    for portion in (1 << 20, 16):
        monkeypatch.setattr(words, "PORTION", portion)
        found = dict(words.word_hashes(texts))
        assert sorted(found) == list(range(len(texts)))
        for k, hashes in found.items():
            spelled = words.words(texts[k])
            assert len(hashes) == len(spelled)
            for w, h in zip(spelled, hashes.tolist()):
                assert own.setdefault(w, h) == h
    assert len(set(own.values())) == len(own)


# --- SentencePiece ----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def piece_codec():
    return pieces.Codec(queries.piece_model())


def test_pieces_are_those_of_the_library(piece_codec):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    decoder = pieces.Decoder(queries.piece_model())
    rng = random.Random(2)
    alphabet = "abcdehilnorst  _=-éñ\n😀xyz0123"
    texts = ["", " ", "  a\n b ", "日本☃x", "a" * 3000, "ab" * 2000 + "zq" * 500, " " * 500, "import   numpy as np\n    def f(x):", "<s> </s> <0x0A>"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(150)]
    for text in texts:
        ids = np.frombuffer(piece_codec.encode(text), "<i4").tolist()
        assert ids == library.encode(text)
        assert decoder.decode(ids) == text


def test_window_is_bounded_and_commits_early(piece_codec):
    search = pieces.StreamingViterbi(piece_codec.model)
    text = "".join(random.Random(4).choice("abcdefgh") for _ in range(20_000))
    out, most = [], 0
    for k in range(0, len(text), 100):
        out += search.feed(text[k:k + 100])
        most = max(most, len(search.text))
    out += search.finish()
    assert most < 2 * search.LOOK
    whole = pieces.StreamingViterbi(piece_codec.model)
    whole.LOOK = 10**9
    assert out == whole.feed(text) + whole.finish()


@pytest.mark.parametrize("prefix", [True, False])
def test_stretches_give_the_ids_of_the_whole_line(prefix):
    codec, rng = pieces.Codec(queries.piece_model()), random.Random(9)
    codec.model.prefix = prefix
    texts = [" ", "   ", " a", "a ", "  a  b  ", "a\n b", "\n", ",", "▁a▁▁b", "日本 日本語、x", "word" * 100 + " " + "z!" * 300]
    texts += ["".join(rng.choices("abest ,.\né日!", k=rng.randint(1, 80))) for _ in range(200)]
    for text in texts:
        whole = pieces.StreamingViterbi(codec.model)
        ids = whole.feed((" " if prefix else "") + text.replace("▁", " ")) + whole.finish()
        assert np.frombuffer(codec.encode(text), "<i4").tolist() == ids


def test_the_streaming_search_sees_each_word_once(monkeypatch):
    codec, fed = pieces.Codec(queries.piece_model()), []
    feed = pieces.StreamingViterbi.feed
    monkeypatch.setattr(pieces.StreamingViterbi, "feed", lambda self, characters: fed.append(characters) or feed(self, characters))
    codec.encode("thandat, thandat! thandat thandat; then thandat,")
    assert fed.count(" thandat") == 1 and fed.count(" then") == 1
    assert "thandat" not in "".join(fed).replace(" thandat", "", 1)


class Toy:
    """A unigram model without a file."""
    kind, longest, bytes, unknown, least = pieces.UNIGRAM, 4, {}, 0, -30.0
    pieces = [("<unk>", 0.0, 2), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("aba", -3.2, 1), ("bab", -3.1, 1), ("abab", -6.5, 1), ("c", -1.0, 1)]
    ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == 1}

    def fallback(self, character):
        return [0]


def test_unigram_path_is_the_best():
    model, rng = Toy(), random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("aabbabc?") for _ in range(rng.randint(1, 40)))
        best = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for size in range(1, min(4, end) + 1):
                i = model.ids.get(text[end - size:end])
                score = model.pieces[i][1] if i is not None else model.least if size == 1 else None
                if score is not None:
                    best[end] = max(best[end], best[end - size] + score)
        search = pieces.StreamingViterbi(model)
        search.LOOK = 8
        ids = search.feed(text) + search.finish()
        assert abs(sum(model.pieces[i][1] if i else model.least for i in ids) - best[-1]) < 1e-9


def test_pieces_of_odd_rows(spark):
    model = queries.piece_model()
    rows = table(spark, [(1, None), (None, ""), (2, "a  b\n"), (2, "a  b\n"), (3, "x" * 150_000)])
    coded = pieces.encode(rows, model)
    assert set(coded.columns) == set(rows.columns)  # the column named ids is replaced
    back = pieces.decode(coded, model)
    assert all(r.decoded == r.text for r in back.collect()) and back.count() == 5
    assert pieces.decode(pieces.encode(rows.limit(0), model), model).count() == 0


def test_memo_forgets_but_stays_right():
    calls = []
    memo = Memo(lambda k: calls.append(k) or k * 2, room=10, longest=4)
    for k in range(100):
        assert memo[f"{k % 25}"] == f"{k % 25}" * 2
    assert memo["longer"] == "longerlonger" and "longer" not in memo and len(memo) <= 10 and len(memo.older) <= 10


# --- token files ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, rans.SEGMENT, rans.SEGMENT + 1, 100_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n) % 5000
    counts = np.bincount(ids, minlength=5001) if n else np.zeros(5001, int)
    counts[7] += 1
    coder = rans.Table(rans.scaled(counts))
    assert int(coder.frequency.sum()) == 1 << rans.SCALE
    states, sizes, stream = rans.encode(ids, coder)
    assert (rans.decode(n, states, sizes, stream, coder) == ids).all()
    for k in range(len(sizes)):
        assert (rans.decode_segment(k, n, states, sizes, stream, coder) == ids[k * rans.SEGMENT:(k + 1) * rans.SEGMENT]).all()


@pytest.mark.parametrize("length", [1, 33, rans.SEGMENT * 3 + 5])
def test_rans_of_one_id_alone(length):
    ids = np.full(length, 3)
    coder = rans.Table(rans.scaled(np.array([0, 0, 0, length])))
    states, sizes, stream = rans.encode(ids, coder)
    assert not len(stream) and (rans.decode(length, states, sizes, stream, coder) == ids).all()


def word_model():
    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def test_words_have_the_ids_of_the_library():
    from tokenizers import Tokenizer

    model, rng = word_model(), random.Random(3)
    library, encoder = Tokenizer.from_str(model), tokenfile.WordEncoder(model)
    assert encoder.direct
    words = ["it's", "'s", "!", "a\x1fb", "e\u0301t", "日本,", "x9", "İ,", "ſ", "ÿ_", "Ünï!!", "a-b", "<|endoftext|>"]
    words += ["".join(rng.choices("abTHeéÉßØø", k=rng.randint(1, 12))) + "".join(rng.choices("!,.'\"-_9<~`", k=rng.randint(0, 3))) for _ in range(3000)]
    for word in words:
        assert list(np.frombuffer(encoder.encode(word), f"<u{array(encoder.kind).itemsize}")) == library.encode(word, add_special_tokens=False).ids


def test_a_word_is_asked_for_once_in_all_its_spellings():
    encoder, asked = tokenfile.WordEncoder(word_model()), []
    tokenize = encoder.tokenize
    encoder.tokenize = lambda letters: asked.append(letters) or tokenize(letters)
    encoder.encode("thandat Thandat, THANDAT! thandat; the thandat.")
    assert asked.count("thandat") == 1


def test_a_repeated_word_is_looked_up_once():
    encoder, asked = tokenfile.WordEncoder(word_model()), []

    class Seen(Memo):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    for name, memo in list(vars(encoder).items()):
        if isinstance(memo, Memo):
            setattr(encoder, name, Seen(memo.make, memo.room, memo.longest))
    once = encoder.encode("The end, x9 (end) ÄRGER!")
    asked.clear()
    assert encoder.encode("The end, x9 (end) ÄRGER! " * 1000) == once * 1000
    assert len(asked) <= 10


def test_texts_together_have_the_ids_of_each_alone():
    from tokenizers import Tokenizer

    rng, library, encoder = random.Random(5), Tokenizer.from_str(word_model()), tokenfile.WordEncoder(word_model())
    near = "abcHÉéßøþÿ" + "\u212a\u212b\u0130\u1e9e\u0178÷×ªµ\u0301" + "'.,!9" + " \t\n\r\x0b\x0c\x1c\xa0\u3000\0"
    texts = [None, "", " ", "\n the  the\n", *("".join(rng.choices(near, k=rng.randint(1, 40))) for _ in range(3000)), None]
    column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    for part, some in ((column, texts), (column.slice(1, 9), texts[1:10]), (column.slice(0, 0), []), (column.cast(pa.large_binary()), texts)):
        got = encoder.encode_all(part, array(encoder.kind, [2]).tobytes()).to_pylist()
        assert [list(array(encoder.kind, g)) for g in got] == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in some]


@pytest.mark.parametrize("size", [1, 40, 90, 10_000])
def test_portions_hold_every_row_in_order(size):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([3, None, 1, 4]), "text": pa.array([b"a" * 50, None, b"", b"b"])})
    portions = list(tokenfile._portions(iter([batch, batch.slice(0, 0), batch.slice(1, 2), batch]), size))
    assert pa.Table.from_batches(portions) == pa.Table.from_batches([batch, batch.slice(1, 2), batch])
    assert all(p.num_rows == 1 or p.nbytes <= size + 16 for p in portions)
    assert not list(tokenfile._portions(iter([])))


def test_token_file(spark):
    from tokenizers import Tokenizer

    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as file:
        model = file.read()
    texts = ["Hello <|endoftext|> wörld x\x1fy", "", None, "tab\tand\x0bmore 日本語  é", "word " * 40_000, "x" * 20_000]
    rows = [(9, texts[0]), (3, texts[1]), (None, texts[2]), (5, texts[3]), (1, texts[4]), (9, texts[5]), (9, texts[0])]
    folder = tokenfile.write(table(spark, rows), model)
    library = Tokenizer.from_str(model)
    want = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]
    got = tokenfile.read(spark, folder).orderBy("start").collect()
    assert sorted((str(r.doc_id), list(np.frombuffer(r.ids, "<u4"))) for r in got) == sorted((str(d), i) for d, i in want)
    assert [r.doc_id for r in got] == [None, 1, 3, 5, 9, 9, 9]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert all(r.ids_crc32 == zlib.crc32(np.array(i, "<u4").tobytes()) for r, i in zip(
        tokenfile.report(spark, folder).orderBy("start").limit(4).collect(), [want[2][1], want[4][1], want[1][1], want[3][1]]))
    blocks = spark.read.parquet(f"{folder}/blocks")
    damaged = blocks.withColumn("payload", F.concat(F.substring("payload", 1, 4), F.lit(b"\0\0\0\0"), F.expr("substring(payload, 9)")))
    damaged.write.parquet(f"{folder}-bad/blocks")
    spark.read.parquet(f"{folder}/frequencies").write.parquet(f"{folder}-bad/frequencies")
    with pytest.raises(Exception, match="checksum is wrong"):
        tokenfile.read(spark, f"{folder}-bad").collect()


def test_tasks_count_the_ids_they_write(spark):
    rows = spark.createDataFrame([(None, "the end"), (1, None), (2, "the the!"), (None, None)], "doc_id long, text string").repartition(3)
    tokens = tokenfile.token_ids(rows, word_model(), counted=True)
    documents = tokens.where("counts IS NULL").collect()
    ids = np.frombuffer(b"".join(r.ids for r in documents), tokenfile.id_type(word_model()))
    assert len(documents) == 4
    assert {r.id: r.n for r in tokenfile.count_ids(tokens).collect()} == dict(zip(*np.unique(ids, return_counts=True)))
    assert tokenfile.token_ids(rows, word_model()).columns == ["doc_id", "ids"]


def test_empty_token_file(spark):
    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as file:
        folder = tokenfile.write(table(spark, []), file.read())
    assert tokenfile.report(spark, folder).count() == 0


# --- language ID ------------------------------------------------------------------------------------------

def test_tables_give_the_convolution():
    rng = np.random.default_rng(0)
    joined = langid.FILTERS * len(langid.WIDTHS)
    net = langid.ByteNet(["a", "b"], rng.normal(size=(256, langid.EMBEDDING)), {w: rng.normal(size=(w, langid.EMBEDDING, langid.FILTERS)) for w in langid.WIDTHS},
                         rng.normal(size=joined), rng.normal(size=(joined, 2)), rng.normal(size=2))
    windows = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    pooled = []
    for w, kernel in net.filters.items():
        embedded = net.embedding[windows]
        pooled.append(np.stack([[max((embedded[i, p:p + w] * kernel[:, :, f]).sum() for p in range(langid.WINDOW - w + 1))
                                 for f in range(langid.FILTERS)] for i in range(3)]))
    hidden = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0)
    assert np.allclose(langid._softmax(hidden @ net.weights + net.shift), net.probabilities(windows), atol=1e-4)


def test_language_of_held_out_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in langid.report(docs, langid.train(docs)).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    asked = [r for r in rows if got[r.doc_id].held_out and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in asked) / len(asked) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_rows(spark):
    learn = spark.createDataFrame([(i, ("the and of with " if i % 2 else "der die und mit ") * 9, "en" if i % 2 else "de", "q") for i in range(200)]
                                  + [(None, "x", "en", "q"), (900, None, "en", "q"), (901, "und", None, "q"), (902, "12", "xx", "q")],
                                  "doc_id long, text string, lang string, lang_pred string")
    net = langid.train(learn)
    assert net.languages == ["de", "en"]
    asked = table(spark, [(1, None), (2, ""), (3, "12 + 3!"), (None, "the and of"), (4, "der die und " * 30_000), (4, "der die und " * 30_000)])
    got = langid.identify(asked, net)
    assert got.columns == ["doc_id", "text", "ids", "item", "row", "lang_pred", "score"]
    assert [(r.doc_id, r.lang_pred) for r in got.collect()] == [(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "de"), (4, "de")]
    assert langid.report(asked.limit(0), net).count() == 0
    nothing = langid.train(learn.limit(0))
    assert [r.lang_pred for r in langid.report(asked, nothing).collect()] == ["und"] * 6


# --- web text ---------------------------------------------------------------------------------------------

def test_article_text_of_all_pages(spark):
    import html
    import re

    for row in webtext.extract(pages := read_table(spark, "/root/testdata/sf0.01", "pages")).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search("<article>(.*?)</article>", row.html, re.S)[1]
        want = " ".join(html.unescape(re.sub("</?(?:p|br|h1)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert row.text == want and row.n_chars == len(want)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<", "<"), ("a<b", "a"), ("<!-- x", ""), ("<script>alert('</p>')</script>", ""), ("<p>x &lt;b&gt; &#233;&nbsp;\n y</p>", "x <b> é y"),
    ("<p>it's <b>bo</b>ld<p title=\"a>b\">next", "it's bold next"), ("<style>p{}</style><p>one</p><script>two", "one"),
    ("<article><p>" + "keep " * 9 + "</p></article><div class='comment-list'><p>" + "drop " * 40 + "</p></div>", ("keep " * 9).strip()),
    ("<nav><a href=x>a</a></nav><main><p>" + "keep " * 20 + "</p><aside>drop</aside></main><form>drop <input></form>", ("keep " * 20).strip()),
    ("<textarea><p>x</p></textarea><p>y</p>", "y"),
])
def test_page(page, text):
    assert webtext.main_text(page, webtext.train()) == text


def test_pages_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, "t"), (1, "u", "<p>a b</p>", "t"), (1, "u", "<p>a b</p>", "t"), (2, "v", "<p>w</p> " * 30_000, "t")],
                                 "page_id long, url string, html string, text string")
    got = webtext.extract(rows).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(None, 0), (1, 3), (1, 3), (2, 59_999)]
    assert webtext.extract(rows.limit(0)).count() == 0
