"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest

from palisade.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int, tree long, at string, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc, source, lang, n, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def plain_tree(nodes):
    """(root, for each node its levels of (left, right))"""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        for k, i in enumerate(at):
            run = i // 16 * 16
            paths[k].append(("".join(now[run:i]), "".join(now[i + 1:run + 16])))
            at[k] = i // 16
        now = [h(*now[i:i + 16]) for i in range(0, len(now), 16)]
    return now[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        parts.append((own, *plain_tree([plain_leaf(*r) for r in own])))
    if not parts:
        return []
    root, tops = plain_tree([p[1] for p in parts])
    out = []
    for (own, subroot, paths), top in zip(parts, tops):
        for r, path in zip(own, paths):
            now, chosen = plain_leaf(*r), r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            if chosen and r[4] is not None:
                now = plain_leaf(*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))
            for left, right in path + top:
                now = h(left, now, right)
            out.append((r[0], plain_leaf(*r), subroot, root, h(*[x for p in path + top for x in p]), now, now == root))
    return out


def sizes(*counts):
    rows, at = [], 0
    for k, n in enumerate(counts):
        source = None if k == 0 else ["é", "Z", "a", "", "zz"][k % 5] + str(k // 5)
        for _ in range(n):
            rows.append((at, source, "en" if at % 3 else None, at if at % 4 else None, f"Text {at} Ünï " * (at % 3)))
            at += 1
    return rows


odd = [(None, None, None, None, None), (None, None, None, None, None), (1, "a", "en", 3, ""), (1, "a", "en", 3, None), (1, "a", "en", 3, "AbC"),
       (1, "a", "en", 3, "AbC"), (None, "a", "", 0, "X"), (-5, "b", "en", 3, "ÀÉ A"), (7, "", "en", 300_000, "Word " * 60_000), (10, " ", "e", 1, "1:2-")]


@pytest.mark.parametrize("rows", [
    sizes(1), sizes(0, 1, 16, 17), sizes(256, 257, 2, 15, 16, 1, 1), sizes(4097, 33), [r for k in range(300) for r in [(k, f"s{k}", "x", k, f"T{k}")]], odd, []],
    ids=["one", "runs", "blocks", "three rounds", "many sources", "odd", "empty"])
def test_manifest(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], SCHEMA)
    got = [tuple(r) for r in merkle.report(df).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_tampering_shows(spark):
    rows = merkle.report(queries.documents(spark, "/root/testdata/sf0.001"))
    texts = {r.doc_id: r.text for r in queries.documents(spark, "/root/testdata/sf0.001").collect()}
    seen = {r.doc_id: r.verified for r in rows.collect()}
    changed = {d for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 == 0 and t and any("A" <= c <= "Z" for c in t)}
    assert changed and {d for d, ok in seen.items() if not ok} == changed
