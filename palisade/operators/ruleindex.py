"""Large rule packs through a predicate index: work grows with what matches, not with the number of rules.

Written out as one expression, a pack costs every event every rule. Here each rule is filed under one condition that must
hold for it to match, the one it shares with the fewest other rules:

* ``equals`` and ``in`` by the value: events look their own values up in a table of (field, value) keys;
* ``contains``, and the literal parts that every match of a ``regex`` must hold, in one automaton over all literals: each
  distinct text of a field goes through it once.

What an event finds are candidates. All conditions of a candidate are then verified by one expression over the event's
fields and the rule's conditions as data, with the meaning ``rules.condition_column`` gives them. Rules without such a
condition are evaluated as before, each in every event.

Keys and rules are as many as the pack, which the driver holds anyway; they are broadcast when they are measured small.
Found texts and matches may be as many as the events. They are landed, so that their size decides how they are joined: a
caller that filters on ``matchedRules`` makes the last join an inner one, in which the planner may broadcast the events.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as sre
from re import _parser as sre_parser
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.operators import rules as plain
from palisade.operators.joins import lookup_join
from palisade.session import land, number_rows

#: Literals shorter than this are in nearly every text and no way to file a rule.
LEAST_LITERAL = 3
#: What Java and Python read differently in patterns, or what turns off the meaning of plain letters.
_OTHER_DIALECT = re.compile(r"\(\?[^:]|\\[QEpPhHRXGkN]|&&|[+*?}]\+|\[\[")
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

TEST = T.StructType([
    T.StructField("field", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("negated", T.BooleanType()),
    T.StructField("text", T.StringType()), T.StructField("number", T.DoubleType()), T.StructField("whole", T.LongType()),
    T.StructField("strings", T.ArrayType(T.StringType())), T.StructField("numbers", T.ArrayType(T.DoubleType())),
    T.StructField("wholes", T.ArrayType(T.LongType())), T.StructField("flags", T.ArrayType(T.BooleanType())), T.StructField("absent", T.BooleanType())])


@dataclass
class Test:
    """A condition as data; ``kind`` is never, present, in, contains, regex, or above or below a number, whole, flag or
    text."""

    field: int
    kind: str
    negated: bool = False
    text: str | None = None
    number: float | None = None
    whole: int | None = None
    strings: list[str] = field(default_factory=list)
    numbers: list[float] = field(default_factory=list)
    wholes: list[int] = field(default_factory=list)
    flags: list[bool] = field(default_factory=list)
    absent: bool = False

    def row(self) -> tuple:
        return tuple(getattr(self, f.name) for f in TEST.fields)


def _is_integral(schema: T.StructType, path: str) -> bool:
    at: Any = schema
    for step in path.split("."):
        at = at[step].dataType if isinstance(at, T.StructType) and step in at.fieldNames() else None
    return isinstance(at, _INTEGRAL)


def _add_value(test: Test, kind: str, integral: bool, value: Any) -> None:
    """What ``equals`` means for this kind of field and this value."""
    wanted = plain._literal_kind(value)
    if value is None:
        test.absent = True
    elif kind == "missing" or wanted == "other":
        return
    elif wanted == "string" and kind in ("string", "variant"):
        test.strings.append(value)
    elif wanted == "boolean" and kind in ("boolean", "variant"):
        test.flags.append(value)
    elif wanted == "number" and kind == "number" and integral and isinstance(value, int):
        test.wholes.append(value)
    elif (wanted == "number" and kind in ("number", "variant")) or {wanted, kind} == {"number", "boolean"}:
        test.numbers.append(float(value))


def compile_test(at: int, kind: str, integral: bool, condition: plain.Condition) -> Test:
    """A condition on the field at place ``at``, of that kind."""
    value, operator = condition.value, condition.operator
    negated, name = operator.startswith("not_"), operator.removeprefix("not_")
    if name == "exists":
        return Test(at, "present", negated)
    if name in ("equals", "in"):
        test = Test(at, "in", negated)
        for v in ([value] if name == "equals" else value if isinstance(value, list) else []):
            _add_value(test, kind, integral, v)
        return test
    if name in ("contains", "regex"):
        return Test(at, name, negated, text=str(value))
    way, wanted = "above" if name == "greater_than" else "below", plain._literal_kind(value)
    if wanted == "string" and kind in ("string", "variant"):
        return Test(at, f"{way} text", text=value)
    if wanted == "number" and kind == "number" and integral and isinstance(value, int):
        return Test(at, f"{way} whole", whole=value)
    if wanted == "boolean" and kind in ("boolean", "variant"):
        return Test(at, f"{way} flag", number=float(value))
    if wanted == "number" and kind in ("number", "boolean", "variant"):
        return Test(at, f"{way} number", number=float(value))
    return Test(at, "never")


def views(schema: T.StructType, path: str) -> Column:
    """An event's field as each kind of test sees it."""
    f = plain.resolve(schema, path)

    def of(kind: str, cast: str) -> Column:
        if f.kind == "variant":
            return plain._variant_as(f.column, kind)
        return f.column.cast(cast) if f.kind == kind else F.lit(None).cast(cast)

    number = f.column.cast("double") if f.kind == "boolean" else of("number", "double")
    whole = f.column.cast("long") if _is_integral(schema, path) else F.lit(None).cast("long")
    return F.struct(of("string", "string").alias("s"), number.alias("d"), whole.alias("l"), of("boolean", "boolean").alias("b"),
                    plain._text(f).alias("t"), plain._present(f).alias("p"))


def holds(test: Column, value: Column) -> Column:
    """Whether a field passes a test; never null."""
    def has(values: Column, one: Column) -> Column:
        return F.coalesce(F.array_contains(values, one), F.lit(False))

    listed = has(test.strings, value.s) | has(test.numbers, value.d) | has(test.wholes, value.l) | has(test.flags, value.b) | (test.absent & ~value.p)
    kinds = {
        "in": listed, "present": value.p, "contains": F.contains(value.t, test.text), "regex": F.rlike(value.t, test.text),
        "above number": value.d > test.number, "below number": value.d < test.number, "above whole": value.l > test.whole,
        "below whole": value.l < test.whole, "above flag": value.b.cast("double") > test.number,
        "below flag": value.b.cast("double") < test.number, "above text": value.s > test.text, "below text": value.s < test.text}
    found = F.lit(False)
    for kind, passes in kinds.items():
        found = F.when(test.kind == kind, F.coalesce(passes, F.lit(False))).otherwise(found)
    return found != test.negated


def literals(pattern: str) -> list[str] | None:
    """Strings one of which is in every match of a pattern; null if that cannot be said."""
    if _OTHER_DIALECT.search(pattern):
        return None
    try:
        return _literals(sre_parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return None


def _literals(parts) -> list[str] | None:
    best, run = None, ""

    def better(one: list[str] | None) -> None:
        nonlocal best
        if one and (best is None or min(map(len, one)) > min(map(len, best))):
            best = one

    for op, value in parts:
        if op is sre.LITERAL:
            run += chr(value)
            continue
        better([run] if run else None)
        run = ""
        if op is sre.SUBPATTERN and not value[1] and not value[2]:
            better(_literals(value[3]))
        elif op is sre.BRANCH:
            branches = [_literals(b) for b in value[1]]
            better([x for b in branches for x in b] if all(branches) else None)
        elif op is sre.MAX_REPEAT and value[0] >= 1:
            better(_literals(value[2]))
    better([run] if run else None)
    return best


@dataclass
class Index:
    """``keys``: key -> ordinals, ``words``: (field, literal) -> ordinals, ``rest``: rules that could not be filed."""

    paths: list[str]
    tests: dict[int, list[Test]]
    keys: dict[str, list[int]]
    words: dict[tuple[int, str], list[int]]
    rest: list[tuple[int, plain.Rule]]


def _ways(test: Test) -> list[list[tuple]]:
    """The keys or literals under any of which a rule with this condition may be filed."""
    if test.negated:
        return []
    if test.kind == "in" and not test.absent and not test.numbers and (test.strings or test.wholes or test.flags):
        values = [("s", v) for v in test.strings] + [("l", str(v)) for v in test.wholes] + [("b", str(v).lower()) for v in test.flags]
        return [[("key", f"{test.field}{kind}:{value}") for kind, value in dict.fromkeys(values)]]
    found = [test.text] if test.kind == "contains" else literals(test.text) if test.kind == "regex" else None
    if found and min(map(len, found)) >= LEAST_LITERAL:
        return [[("word", test.field, x) for x in dict.fromkeys(found)]]
    return []


def build(schema: T.StructType, numbered: list[tuple[int, plain.Rule]]) -> Index:
    paths = sorted({c.field for _, r in numbered for c in r.conditions})
    place = {p: (i, plain.resolve(schema, p).kind, _is_integral(schema, p)) for i, p in enumerate(paths)}
    index = Index(paths, {}, {}, {}, [])
    filed = []
    for ordinal, rule in numbered:
        tests = [compile_test(*place[c.field], c) for c in rule.conditions]
        ways = [way for test in tests for way in _ways(test)]
        index.tests[ordinal] = tests
        filed.append((ordinal, rule, ways))
    shared = Counter(entry for _, _, ways in filed for way in ways for entry in way)
    for ordinal, rule, ways in filed:
        if not ways:
            index.rest.append((ordinal, rule))
            continue
        for entry in min(ways, key=lambda way: (sum(shared[e] for e in way), way[0][0])):
            table, name = (index.keys, entry[1]) if entry[0] == "key" else (index.words, entry[1:])
            table.setdefault(name, []).append(ordinal)
    return index


def _found_words(texts: DataFrame, words: dict[tuple[int, str], list[int]]) -> DataFrame:
    """(at, text) to the ordinals whose literal it holds."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines: dict[int, ahocorasick.Automaton] = {}
        for (at, word), ordinals in words.items():
            machines.setdefault(at, ahocorasick.Automaton()).add_word(word, ordinals)
        for machine in machines.values():
            machine.make_automaton()
        for batch in batches:
            hits = [sorted({o for _, found in machines[at].iter(text) for o in found}) for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            table = pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(pa.int32()))], ["at", "text", "ordinals"])
            yield table.filter(pa.array([bool(h) for h in hits]))

    return texts.mapInArrow(work, "at int, text string, ordinals array<int>")


def _candidates(rows: DataFrame, index: Index) -> DataFrame | None:
    """(rowId, fields, ordinal): every filed rule an event finds."""
    spark, found = rows.sparkSession, None
    value = {i: F.col("fields")[i] for i in range(len(index.paths))}
    if index.keys:
        asked = sorted({(int(k.split(":", 1)[0][:-1]), k.split(":", 1)[0][-1]) for k in index.keys})
        own = F.array_compact(F.array(*[F.concat(F.lit(f"{at}{kind}:"), value[at][kind].cast("string")) for at, kind in asked]))
        keys = spark.createDataFrame(list(index.keys.items()), "key string, ordinals array<int>")
        exploded = rows.select("rowId", "fields", F.explode(own).alias("key"))
        found = lookup_join(exploded, keys, ["key"], how="inner").select("rowId", "fields", F.explode("ordinals").alias("ordinal"))
    if index.words:
        fields = sorted({at for at, _ in index.words})
        own = F.filter(F.array(*[F.struct(F.lit(at).alias("at"), value[at].t.alias("text")) for at in fields]), lambda x: x.text.isNotNull())
        exploded = rows.select("rowId", "fields", F.explode(own).alias("own")).select("rowId", "fields", "own.at", "own.text")
        held = land(_found_words(exploded.select("at", "text").distinct(), index.words))
        more = lookup_join(exploded, held, ["at", "text"], how="inner").select("rowId", "fields", F.explode("ordinals").alias("ordinal"))
        found = more if found is None else found.unionByName(more)
    return found


def with_matched_rules(events: DataFrame, rules: list[plain.Rule]) -> DataFrame:
    """``matchedRules`` as ``rules.with_matched_rules`` gives it."""
    numbered = [(i, r) for i, r in enumerate(rules, start=1) if r.enabled]
    index = build(events.schema, numbered)
    rest = plain.matched_numbered(events.schema, index.rest)
    named = "rowId" in events.columns
    rows = number_rows(events)
    spark = events.sparkSession
    candidates = _candidates(rows.select("rowId", F.array(*[views(events.schema, p) for p in index.paths]).alias("fields")), index) if index.paths else None
    if candidates is None:
        return events.withColumn("matchedRules", rest)
    filed = {o for ordinals in (*index.keys.values(), *index.words.values()) for o in ordinals}
    side = spark.createDataFrame(
        [(o, [t.row() for t in index.tests[o]], (o, r.id, r.name, r.severity, r.description, list(r.tags))) for o, r in numbered if o in filed],
        T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("tests", T.ArrayType(TEST)),
                      T.StructField("record", T.DataType.fromDDL(plain.MATCHED_TYPE).elementType)]))
    verified = lookup_join(candidates, side, ["ordinal"], how="inner").where(
        F.forall("tests", lambda t: holds(t, F.get(F.col("fields"), t.field))))
    matched = land(verified.groupBy("rowId").agg(F.collect_list("record").alias("__matched")))
    joined = lookup_join(rows, matched, ["rowId"])
    every = F.concat(rest, F.coalesce("__matched", F.array().cast(plain.MATCHED_TYPE)))
    done = joined.withColumn("matchedRules", F.array_sort(every)).drop("__matched")
    return done if named else done.drop("rowId")
