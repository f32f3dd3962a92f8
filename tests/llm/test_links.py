"""SimHash components, nearest neighbours and the pipeline against brute force, and odd input."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import neighbours, queries, simhash, words
from palisade.llm.components import components
from palisade.session import land, read_table

SF = "/root/testdata/sf0.001"


# --- SimHash ----------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    found, word = [], ""
    for c in (text or "").translate({i: i + 32 for i in range(65, 91)}) + " ":
        if c in " \t\n\x0b\x0c\r":
            found += [word] if word else []
            word = ""
        else:
            word += c
    if not found:
        return 0
    sets = [" ".join(found[i:i + 3]) for i in range(max(1, len(found) - 2))]
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in sets) for b in range(64)]
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(sets))


def plain_components(prints):
    """Smallest id reachable for each of (id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        best[r] = min((x for x in (best.get(r), d) if x is not None), default=None)
    return [best[find(i)] for i in range(len(prints))]


TEXTS = [None, "", " \t\n", "One", "ONE", "one two", "One\x0bTwo ", "one two", "É a b", "é a b", "x " * 70_000, "a b c a b c a b c", "0\x1f1 2"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_slices_of_shingles_do_not_matter(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_STEP", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def cluster(rng, centres, each):
    out = {0}
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("path", [(0,), (1,), (2,), (0, 1), (2, 0, 1), (1, 2, 2)])
def test_tree_finds_all_pairs_of_its_groups(path, monkeypatch):
    monkeypatch.setattr(simhash, "_PAIRS", 300)
    x = cluster(random.Random(6), 15, 40)
    codes = x.copy()
    for depth in range(len(path)):
        codes = simhash.put_in_front(codes, path[:depth], path[depth])
    assert (simhash.restore(codes, path) == x).all()
    assert simhash._path(simhash._numbered(path)) == path
    rank = simhash.gray_rank(codes)
    assert (simhash.from_gray_rank(rank) == codes).all()
    codes = codes[np.argsort(rank)]
    assert all(bin(int(a) ^ int(b)).count("1") >= 1 for a, b in zip(codes, codes[1:]))
    fixed = simhash.fixed_bits(path)
    found = {(int(i), int(j)) for a, b in simhash.GrayTree(codes, fixed).pairs(2) for i, j in zip(a, b)}
    far = np.bitwise_count(codes[:, None] ^ codes[None])
    front = codes >> np.uint64(64 - fixed)
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero((far <= 2) & (front[:, None] == front[None]))) if i < j}


def test_gray_order_changes_one_bit():
    order = simhash.from_gray_rank(np.arange(4096, dtype=np.uint64))
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


@pytest.mark.parametrize("group_rows", [20_000, 5])
def test_links_connect_what_is_near(spark, group_rows):
    """A small limit sends nearly all groups through the second and third deal."""
    x = cluster(random.Random(8), 12, 50)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(land(df), group_rows)).collect()}
    want = plain_components([(int(v.view(np.int64)), int(v)) for v in x])
    assert [roots.get(int(v.view(np.int64)), int(v.view(np.int64))) for v in x] == want


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    random.Random(1).shuffle(chain)
    rows = chain + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5), (None, 3), (3, None), (1000, 1001), (1001, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert len(got) == 301 + 400 and all(v == (0 if k <= 300 else 1000) for k, v in got.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(k, t) for k, t in enumerate(TEXTS, 20)] + [(7, base), (7, base), (3, base.upper()), (50, base + " more"), (None, base), (None, "alone here"), (4, "x")]
    df = spark.createDataFrame([(d, t, 1, "r", 2) for d, t in rows], "doc_id long, text string, fp int, root string, row int")
    want = list(zip([d for d, _ in rows], plain_components([(d, plain_fingerprint(t)) for d, t in rows])))
    got = simhash.report(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(d), str(c)) for d, c in want)
    assert {r.fingerprint for r in got} == {f"{plain_fingerprint(t):016x}" for _, t in rows}
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(c) for c in set(c for _, c in want))
    assert simhash.report(df.limit(0)).count() == 0 and simhash.one_of_each(df.limit(0)).count() == 0


# --- nearest neighbours -----------------------------------------------------------------------------------

def exact(ids, x, query, k):
    q = x[query]
    score = (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
    rows = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), float(score[i])) for i in rows]


def test_recall_with_several_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 60)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 25)
    rows = read_table(spark, SF, "embeddings")
    data = sorted((r.vec_id, r.embedding) for r in rows.collect())
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    found = {}
    for r in neighbours.search(rows, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for at in np.flatnonzero(ids % 10 == 0):
        want = exact(ids, x, at, 5)
        got = found[int(ids[at])]
        assert [r for r, _, _ in got] == [1, 2, 3, 4, 5]
        score = dict(exact(ids, x, at, len(ids)))
        assert all(abs(s - score[i]) < 1e-12 for _, i, s in got)
        hit += len({i for i, _ in want} & {i for _, i, _ in got})
        total += 5
    assert hit / total >= 0.9


def test_parts_are_balanced():
    x = neighbours._unit(np.random.default_rng(1).normal(size=(900, 16)))
    part = neighbours.balanced_parts(x, neighbours.neighbour_graph(x, 8), 7)
    assert np.bincount(part, minlength=7).max() <= np.ceil(900 / 7 * neighbours.SLACK)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 2.0, 0.5]) for i in range(100, 140)]
    rows = [(0, [1.0, 2.0, 0.5]), (50, [1.0, 0.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [None, 1.0, 1.0]),
            (None, [1.0, 0.0, 0.0]), (7, [2.0, 0.0, 0.0]), (7, [2.0, 0.0, 0.0]), (8, [1.0, 1.0]), (200, [1.0, 0.5]), (9, [-1.0, 0.0, 0.0]), *same]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, vector int, part int")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert [i for i, _ in got[0]] == [100, 101, 102, 103, 104]  # ties go to smaller ids, its own left out
    assert [i for i, _ in got[100]] == [0, 101, 102, 103, 104]
    assert got[50][0] == (7, 1.0) and [i for i, _ in got[50]][1:] == [0, 100, 101, 102]
    assert got[200] == [(8, round(1.5 / (2**0.5 * 1.25**0.5), 6))]
    assert set(got) == {0, 50, 100, 200}
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------

def test_stages_take_effect(spark):
    docs = queries.documents(spark, SF)
    first, columns = docs.collect(), docs.columns
    planted = first[0].text + " " + read_table(spark, SF, "benchmark").first().text
    extra = [(900_000, None), (900_001, "12345 67"), (900_002, planted), (900_003, "  ".join(first[3].text.upper().split(" "))), (900_004, first[5].text + " a@b.example.org")]
    docs = land(docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in extra], docs.schema)))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "SimHash near-dedup", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(land(stage(spark, out[-1], SF)))
    assert all(df.columns == columns for df in out[:-1])
    rows = [{r.doc_id: r for r in df.collect()} for df in out]
    assert rows[0].keys() - rows[1].keys() == {900_000, 900_001}
    want = plain_components([(d, simhash.fingerprint(r.text)) for d, r in sorted(rows[1].items())])
    assert rows[2].keys() == set(want) and 900_003 not in rows[2]
    items = [words.shingles(r.text, 5) for r in read_table(spark, SF, "benchmark").collect()]
    bad = {d for d, r in rows[2].items() if any(10 * len(i & words.shingles(r.text, 5)) >= 8 * len(i) for i in items if i)}
    assert rows[3].keys() == rows[2].keys() - bad and 900_002 in bad
    assert rows[4].keys() == rows[3].keys()
    assert all("@" not in r.text or not pii_left(r.text) for r in rows[4].values())
    assert any(rows[4][d].text != rows[3][d].text for d in rows[4])
    assert all(r.n_chars == len(r.text) for r in rows[4].values())
    assert rows[5].keys() == rows[4].keys() and all(r.restored and r.n_ids == len(r.ids) for r in rows[5].values())


def pii_left(text):
    import re

    return re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)


def test_stages_on_empty_and_clashing_tables(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "s", 19, "p", 2, "q", 1.0), (None, None, None, None, None, None, None, None, None),
                                  (1, "the cat and the dog", "en", "s", 19, "p", 2, "q", 1.0), (2, "", "en", "s", 0, "p", 2, "q", 1.0)],
                                 "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, row int, base_pii string, score double")
    for table in (docs, docs.limit(0)):
        now = land(table)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = land(stage(spark, now, SF))
            assert now.columns == docs.columns
        assert now.count() == (1 if table is docs else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(queries.ready(spark), SF)
    assert got.columns == ["doc_id", "ids", "n_ids", "restored"] and got.where("restored").count() == got.count() > 100
