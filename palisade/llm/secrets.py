"""Secrets: fixed patterns, and sliding-window Shannon entropy per character class; DataFrame functions only.

A candidate is a run of one character class, or what base spans, UUIDs and stretches of a narrower class leave of
it, at least a window long. A window moves over it character by character; its entropy follows from the counts of the
one character that enters and the one that leaves. Windows at or over the class's threshold that overlap or touch make
one stretch, and every stretch is a secret unless the allow-list explains that stretch from its first to its last character.
So a key is found behind a path, a date, a checksum or another secret in the same run.

Rules for odd input: a null text is empty; equal rows each give a row; an empty table gives an empty table;
ties need no rule, since spans are places. Only the named columns are read, whatever else the input holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import count_kind, found_spans, let, span_names

# What the base spans look like; a look-behind only keeps runs from being read twice.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
KINDS = ["assign", "access", "hex", "entropy"]


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``characters`` are searched with a window; ``bits`` per character make it suspicious."""

    characters: str
    window: int
    bits: float


#: A random window has about 3.4 bits (hexadecimal) and 4.2 bits (letters and digits); words and numbers stay well below.
CLASSES = [CharacterClass("0-9A-Fa-f", 20, 3.0), CharacterClass(r"A-Za-z0-9+/_=-", 24, 3.9)]
#: What no name has: a name is words, each with at most four digits behind it, and numbers of at most eight digits.
NO_NAME = r"[0-9][A-Za-z]|[A-Za-z][0-9]{5}|[0-9]{9}"
NUMBER = r"^[0-9_=+/-]*$"
#: Public wherever it stands, so it is cut out before anything is measured.
UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
#: Alphabets and digits in their order, from end to end (possessive: long runs need no stack).
SEQUENCE = r"(?i)^(?:[/_=+-]*(?:0?1234567890?|abcdef(?:ghijklmnopqrstuvwxyz)?))++[/_=+-]*$"
#: A key printed in documentation says so at its end.
DOCUMENTED = r"(?i)(?:example|placeholder|changeme)(?:_?key)?$"
DOCUMENTED_LENGTH = 64
#: Just before the candidate: a checksum or a revision that is meant to be public, and how long such a one is at most.
ALLOWED_BEFORE = r"(?i)(?:sha-?(?:1|256|512)|md5|crc32|checksum|commit|revision|etag)\W{0,3}$"
BEFORE, DIGEST_LENGTH = 12, 128


def suspicious(match: Column, kind: CharacterClass) -> Column:
    """Stretches covered by windows at or over the threshold: ``array<struct<first,last>>``, places from 0, last exclusive."""
    w = kind.window
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 2)])
    # entropy = log2(w) - load / w with load = sum of c * log2(c) over the window's character counts
    most = w * (math.log2(w) - kind.bits) + 1e-9
    none = F.array().cast("array<struct<first:int,last:int>>")

    def times(part: Column, c: Column) -> Column:
        return F.size(F.filter(part, lambda x: x == c))

    def term(count: Column) -> Column:
        return F.element_at(weight, count + 1)

    def state_of(load: Column, done: Column, first: Column, last: Column) -> Column:
        return F.struct(load.alias("load"), done.alias("done"), first.cast("int").alias("first"), last.cast("int").alias("last"))

    def finished(state: Column) -> Column:
        open_one = F.array(F.struct(state["first"].alias("first"), state["last"].alias("last")))
        return F.when(state["first"] >= 0, F.concat(state.done, open_one)).otherwise(state.done)

    def search(chars: Column) -> Column:
        head = F.slice(chars, 1, w)
        load = F.aggregate(F.array_distinct(head), F.lit(0.0), lambda acc, c: acc + term(times(head, c)))
        start = let(load, lambda x: state_of(x, none, F.when(x <= most, 0).otherwise(-1), F.when(x <= most, w).otherwise(-1)))

        def slide(state: Column, i: Column) -> Column:
            """i: place of the entering character, from 1; the one that leaves stands w places before."""
            entering, leaving = F.element_at(chars, i), F.element_at(chars, i - w)
            kept = F.slice(chars, i - w + 1, F.lit(w - 1))  # what both windows share
            gone, come = times(kept, leaving), times(kept, entering)
            load = state.load - term(gone + 1) + term(gone) - term(come) + term(come + 1)
            apart = state["last"] < i - w
            return let(load, lambda x: F.when(x > most, state_of(x, state.done, state["first"], state["last"]))
                       .when(apart, state_of(x, finished(state), i - w, i)).otherwise(state_of(x, state.done, state["first"], i)))

        places = F.when(F.size(chars) > w, F.sequence(F.lit(w + 1), F.size(chars))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, slide, finished)

    return let(F.split(match, ""), search)


def base_spans(text: Column, kind: str) -> Column:
    if kind == "assign":
        spans = F.filter(found_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s.match, ASSIGN, 1)) >= ASSIGN_LENGTH)
    elif kind == "access":
        spans = F.filter(found_spans(text, ACCESS), lambda s: F.length(s.match) >= ACCESS_LENGTH)
    else:
        spans = found_spans(text, HEX)
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(kind).alias("kind")))


def _no_name(match: Column) -> Column:
    """Neither words nor a number. A part of a name is a name, so what fails here needs no measuring."""
    return match.rlike(NO_NAME) & ~match.rlike(NUMBER)


def _parts(text: Column, kind: CharacterClass, cuts: Column) -> Column:
    """Candidates of a class: what the cuts leave of its runs, at least a window long."""
    run = rf"(?<![{kind.characters}])[{kind.characters}]{{{kind.window},}}+"

    def free(s: Column) -> Column:
        def of(near: Column) -> Column:
            starts = F.array_distinct(F.concat(F.array(s.start), F.transform(near, lambda c: c.end)))
            starts = F.filter(starts, lambda p: (p < s.end) & ~F.exists(near, lambda c: (c.start <= p) & (p < c.end)))
            ends = F.transform(starts, lambda p: F.struct(p.alias("start"), F.least(s.end, F.coalesce(
                F.array_min(F.transform(F.filter(near, lambda c: c.start > p), lambda c: c.start)), s.end)).alias("end")))
            return F.transform(F.filter(ends, lambda x: x.end - x.start >= kind.window), lambda x: F.struct(
                x.start.alias("start"), F.substring(s.match, (x.start - s.start).cast("int") + 1, (x.end - x.start).cast("int")).alias("match")))

        return let(F.filter(cuts, lambda c: (c.start < s.end) & (s.start < c.end)), of)

    runs = F.filter(found_spans(text, run), lambda s: _no_name(s.match))
    return F.filter(F.flatten(F.transform(runs, free)), lambda x: _no_name(x.match))


def _explained(part: Column, stretch: Column, first: Column, last: Column, before: Column) -> Column:
    return (~_no_name(stretch) | stretch.rlike(SEQUENCE)
            | (part.rlike(DOCUMENTED) & (F.length(part) - first <= DOCUMENTED_LENGTH))
            | (before.rlike(ALLOWED_BEFORE) & (last <= DIGEST_LENGTH)))


def entropy_spans(text: Column, kind: CharacterClass, cuts: Column) -> Column:
    """Suspicious stretches of one class outside ``cuts``, each with whether the allow-list explains it."""
    def stretches(part: Column) -> Column:
        at = part.start.cast("int")
        before = F.substring(text, F.greatest(at - BEFORE, F.lit(0)) + 1, F.least(at, F.lit(BEFORE)))
        return F.transform(suspicious(part.match, kind), lambda p: F.struct(
            (part.start + p["first"]).alias("start"), (part.start + p["last"]).alias("end"), F.lit("entropy").alias("kind"),
            _explained(part.match, F.substring(part.match, p["first"] + 1, p["last"] - p["first"]), p["first"], p["last"], before).alias("explained")))

    return F.flatten(F.transform(_parts(text, kind, cuts), stretches))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))


def scan(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts and digest of the base spans, and all spans by name.

    Narrower classes come first; what they find, secret or explained, is cut out of the runs of wider ones."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    uuids = F.transform(found_spans(whole, UUID), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit("uuid").alias("kind")))
    found = rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", "text", F.concat(*[base_spans(whole, k) for k in KINDS[:3]]).alias("base"), uuids.alias("uuids"))
    cuts, added = [F.col("base"), F.col("uuids")], []
    for i, kind in enumerate(CLASSES):
        found = found.withColumn(f"class_{i}", entropy_spans(whole, kind, F.concat(*cuts)))
        cuts.append(_plain(F.col(f"class_{i}")))
        added.append(_plain(F.filter(F.col(f"class_{i}"), lambda s: ~s.explained)))
    counts = [count_kind("base", k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.withColumn("added", F.concat(*added)).select(
        "doc_id", *counts, F.sha2(span_names(F.col("base"), KINDS), 256).alias("base_sha256"),
        span_names(F.concat("base", "added"), KINDS).alias("spans"), F.size("added").cast("long").alias("n_entropy"))


def oracle() -> str:
    """The same over ``documents`` as DuckDB SQL: free characters counted one by one, each window afresh."""
    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    def no_name(value: str) -> str:
        return f"(regexp_matches({value}, '{NO_NAME}') AND NOT regexp_matches({value}, '{NUMBER}'))"

    def one_class(i: int, c: CharacterClass) -> str:
        cuts = "SELECT r, a, e FROM base UNION ALL SELECT r, a, e FROM placed_ends WHERE kind = 'uuid'"
        cuts += "".join(f" UNION ALL SELECT r, a, e FROM found_{j}" for j in range(i))
        return f"""
cuts_{i} AS ({cuts}),
runs_{i} AS (SELECT row_number() OVER () AS run, r, t, m, a FROM placed WHERE kind = '{i}' AND {no_name("m")}),
taken_{i} AS (SELECT DISTINCT run, unnest(range(greatest(c.a, s.a), least(c.e, s.a + length(s.m)))) AS p
  FROM runs_{i} s JOIN cuts_{i} c ON c.r = s.r AND c.a < s.a + length(s.m) AND s.a < c.e),
cells_{i} AS (SELECT run, unnest(range(a, a + length(m))) AS p FROM runs_{i}),
numbered_{i} AS (SELECT run, p, p - row_number() OVER (PARTITION BY run ORDER BY p) AS g FROM cells_{i} ANTI JOIN taken_{i} USING (run, p)),
parts_{i} AS (SELECT row_number() OVER () AS part, s.r, x.p AS a, substr(s.m, x.p - s.a + 1, n) AS m, right(left(s.t, x.p), {BEFORE}) AS b
  FROM (SELECT run, g, min(p) AS p, count(*) AS n FROM numbered_{i} GROUP BY run, g HAVING count(*) >= {c.window}) x JOIN runs_{i} s USING (run)),
windows_{i} AS (SELECT part, i, unnest(string_split(substr(m, i + 1, {c.window}), '')) AS ch FROM parts_{i}, unnest(range(0, length(m) - {c.window} + 1)) AS u(i)
  WHERE {no_name("m")}),
entropy_{i} AS (SELECT part, i, sum(n * log2(n)) AS load FROM (SELECT part, i, ch, count(*) AS n FROM windows_{i} GROUP BY part, i, ch) GROUP BY part, i),
steps_{i} AS (SELECT part, i, coalesce(CAST(i > lag(i) OVER (PARTITION BY part ORDER BY i) + {c.window} AS INT), 1) AS fresh
  FROM entropy_{i} WHERE load <= {c.window} * (log2({c.window}) - {c.bits}) + 1e-9),
stretches_{i} AS (SELECT part, min(i) AS first, max(i) + {c.window} AS last FROM (
  SELECT part, i, sum(fresh) OVER (PARTITION BY part ORDER BY i) AS island FROM steps_{i}) GROUP BY part, island),
found_{i} AS (SELECT r, a + first AS a, a + last AS e, NOT {no_name("substr(m, first + 1, last - first)")}
  OR regexp_matches(substr(m, first + 1, last - first), '{SEQUENCE.replace("++", "+")}')
  OR (regexp_matches(m, '{DOCUMENTED}') AND length(m) - first <= {DOCUMENTED_LENGTH})
  OR (regexp_matches(b, '{quoted(ALLOWED_BEFORE)}') AND last <= {DIGEST_LENGTH}) AS explained FROM stretches_{i} JOIN parts_{i} USING (part)),"""

    runs = ", ".join(f"('{i}', 9, '[{quoted(c.characters)}]{{{c.window},}}')" for i, c in enumerate(CLASSES))
    added = " UNION ALL ".join(f"SELECT r, 'entropy', 4, a, e FROM found_{i} WHERE NOT explained" for i in range(len(CLASSES)))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
patterns(kind, rank, pattern) AS (VALUES ('assign', 1, '{quoted(ASSIGN)}'), ('access', 2, '{quoted(ACCESS)}'), ('hex', 3, '[0-9a-f]{{24,}}'), ('uuid', 9, '{UUID}'), {runs}),
matched AS (SELECT r, t, kind, rank, regexp_extract_all(t, pattern) AS ms, string_split_regex(t, pattern) AS gs FROM d, patterns),
placed AS (SELECT r, t, kind, rank, ms[k] AS m, CAST(list_sum(list_transform(gs[1:k], lambda x: length(x)))
  + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM matched, unnest(range(1, len(ms) + 1)) AS u(k)),
placed_ends AS (SELECT r, kind, a, a + length(m) AS e FROM placed),
base AS (SELECT r, kind, rank, a, a + length(m) AS e FROM placed WHERE (kind = 'assign' AND length(regexp_extract(m, '{quoted(ASSIGN)}', 1)) >= {ASSIGN_LENGTH})
  OR (kind = 'access' AND length(m) >= {ACCESS_LENGTH}) OR kind = 'hex'),{"".join(one_class(i, c) for i, c in enumerate(CLASSES))}
spans(r, kind, rank, a, e) AS (SELECT * FROM base UNION ALL {added}),
sums AS (SELECT r, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex, count_if(kind = 'entropy') AS n_entropy,
  string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank, e) FILTER (kind <> 'entropy') AS plain,
  string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank, e) AS spans FROM spans GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(plain, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_entropy, 0) AS BIGINT) AS n_entropy
FROM d LEFT JOIN sums USING (r)
"""
