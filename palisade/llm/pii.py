"""Personal data by candidate gradient boosting, in DataFrame functions only.

Fixed patterns give the base spans. Wider generators propose further, overlapping candidates of the same
kinds; boosted trees judge them by format and context, and thresholds calibrated on held-out examples
choose which are added. Base spans always stay.

Rules for odd input: a null text is empty; a null doc_id is a value like any other; equal rows each give a
row; an empty table gives an empty table; without any base span in the sample there is no model and only
base spans are found. Only the named columns are read, whatever else the input holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.boosting import Boosted, calibrate, fit, threshold
from palisade.llm.common import count_kind, found_spans, fresh, let, span_names
from palisade.session import land

KINDS = ["email", "ip", "card", "phone"]
# What the base spans look like. Guards and possessive quantifiers change no match; they keep
# long runs from being read again from each of their characters.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: Generators: wider than the base patterns, so that spelled-out or oddly separated data is proposed as well.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:[.,_][0-9]{1,4}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){11,21}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?[(]?[0-9](?:[\x20()./-]{0,3}[0-9]){7,15}+(?![0-9A-Za-z])",
}
#: Where several readings of card numbers may lie: digits and separators.
DIGIT_RUN = r"(?<![0-9])[0-9][0-9\x20._/-]{13,}+"
#: Words before a span that speak for a kind.
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|mailto)\W*$", "ip": r"(?i)(?:\bip|address|host|addr)\W*$",
    "card": r"(?i)(?:card|visa|payment|credit)\W*(?:no|number)?\W*$", "phone": r"(?i)(?:tel|phone|call|mobile|fax)\W*$",
}
FEATURES = ["kind", "digits", "letters", "marks", "plus", "valid", "cue", "glued", "groups", "repeated"]
CONTEXT = 24
#: Bound of the labelled sample: about so many rows, drawn by hash, and characters read at a place drawn by hash in each.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 4000
PRECISION, LEAST_PROBABILITY = 0.99, 0.9


def luhn(digits: Column) -> Column:
    """Luhn check of up to 19 digits."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(19):
        digit = F.substring(padded, i + 1, 1).cast("int")
        doubled = digit * 2
        total = total + (digit if i % 2 == 0 else F.when(doubled > 9, doubled - 9).otherwise(doubled))
    return total % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def passes(kind: str, match: Column) -> Column:
    """What a match of a base pattern has to fulfil beside its form."""
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(14, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _kinded(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s.start.alias("start"), s.end.alias("end"), F.lit(kind).alias("kind"), s.match.alias("match")))


def base_spans(text: Column, kind: str) -> Column:
    return _kinded(F.filter(found_spans(text, BASE[kind]), lambda s: passes(kind, s.match)), kind)


def card_readings(text: Column) -> Column:
    """Every stretch of whole groups of digits, up to two separators apart, that has a card's length and check digit."""
    def readings(groups: Column, first: Column, i: Column) -> Column:
        """Ends of the stretches that start with the group at place i."""
        none = F.array().cast("array<struct<end:bigint,digits:string>>")

        def longer(state: Column, group: Column) -> Column:
            digits = F.concat(state.digits, group.match)
            ends = F.when(F.length(digits) >= 14, F.concat(state.ends, F.array(F.struct(
                group.end.alias("end"), digits.alias("digits"))))).otherwise(state.ends)
            joins = (group.start - state["last"] <= 2) & (F.length(digits) <= 19)
            return F.when(joins, F.struct(digits.alias("digits"), group.end.alias("last"), ends.alias("ends"))).otherwise(
                F.struct(state.digits.alias("digits"), F.lit(-9).cast("long").alias("last"), state.ends.alias("ends")))

        start = F.struct(F.lit("").alias("digits"), first.start.alias("last"), none.alias("ends"))
        ends = F.aggregate(F.slice(groups, i + 1, F.lit(19)), start, longer, lambda state: state.ends)
        return F.transform(F.filter(ends, lambda e: luhn(e.digits)), lambda e: F.struct(first.start.alias("start"), e.end.alias("end")))

    def of_run(run: Column) -> Column:
        places = let(found_spans(run.match, r"[0-9]++"), lambda groups: F.flatten(
            F.transform(groups, lambda g, i: readings(groups, g, i))))
        return F.transform(places, lambda p: F.struct(
            (run.start + p.start).alias("start"), (run.start + p.end).alias("end"),
            F.substring(run.match, p.start.cast("int") + 1, (p.end - p.start).cast("int")).alias("match")))

    runs = F.filter(found_spans(text, DIGIT_RUN), lambda s: F.length(_digits(s.match)) >= 14)
    return F.flatten(F.transform(runs, of_run))


def wide_spans(text: Column, kind: str) -> Column:
    """Matches of the kind's generator; of a card, all readings beside the longest."""
    spans = found_spans(text, WIDE[kind])
    return _kinded(F.array_distinct(F.concat(spans, card_readings(text))) if kind == "card" else spans, kind)


def _features(text: Column, span: Column, kind: str) -> Column:
    """Format and context of a candidate, as small whole numbers."""
    match, start, end = span.match, span.start.cast("int"), span.end.cast("int")
    before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    after = F.substring(text, end + 1, F.lit(1))
    digits = _digits(match)
    fits = {
        "email": match.rlike("@"), "ip": match.rlike(rf"^{OCTET}(?:[.,_]{OCTET}){{3}}$"),
        "card": F.length(digits).between(14, 19) & luhn(F.right(digits, F.lit(19))),
        "phone": F.length(digits).between(10, 15),
    }[kind]

    def number(value: Column) -> Column:
        return value.cast("double")

    return F.struct(
        number(F.lit(KINDS.index(kind))).alias("kind"),
        number(F.length(digits)).alias("digits"),
        number(F.least(F.length(F.regexp_replace(match, r"[^A-Za-z]", "")), F.lit(20))).alias("letters"),
        number(F.least(F.length(F.regexp_replace(match, r"[A-Za-z0-9]", "")), F.lit(10))).alias("marks"),
        number(match.startswith("+")).alias("plus"),
        number(fits).alias("valid"),
        number(before.rlike(CUES[kind])).alias("cue"),
        number(before.rlike(r"[A-Za-z0-9]$").cast("int") + after.rlike(r"^[A-Za-z0-9]").cast("int")).alias("glued"),
        number(F.least(F.size(F.split(match, r"[^A-Za-z0-9]+")), F.lit(8))).alias("groups"),
        number(digits.rlike(r"([0-9])\1{5}")).alias("repeated"),
    )


def candidates(text: Column) -> Column:
    """``array<struct<start,end,kind,match,features>>`` of all generators."""
    def judged(kind: str) -> Column:
        return F.transform(wide_spans(text, kind), lambda s: F.struct(
            s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), s.match.alias("match"),
            _features(text, s, kind).alias("features")))

    return F.concat(*[judged(k) for k in KINDS])


@dataclass
class PiiModel:
    trees: Boosted | None
    thresholds: dict[str, float]


def _variants(kind: str, match: Column) -> Column:
    """Spellings of a true span (label 1), and look-alikes made from it (label 0)."""
    digits = _digits(match)
    grouped = F.regexp_replace(digits, r"(\d{4})(?=\d)", "$1.")
    own = {
        "email": [(F.regexp_replace(F.regexp_replace(match, "@", " [at] "), r"\.(?=[^.]*$)", " [dot] "), 1),
                  (F.regexp_replace(match, "@", "(at)"), 1)],
        "ip": [(F.regexp_replace(match, r"\.", ","), 0)],
        "card": [(grouped, 1), (F.concat(F.substring(digits, 2, 15), F.lit("7")), 0), (F.repeat(F.substring(digits, 1, 1), 16), 0)],
        "phone": [(F.concat(F.lit("phone: "), F.regexp_replace(match, r"^\+\d", "0")), 1), (F.concat(F.lit("00"), F.substring(match, 2, 40)), 1),
                  (digits, 0), (F.regexp_replace(digits, r"(\d{3})(?=\d)", "$1."), 0)],
    }[kind]
    return F.array(*[F.struct(v.alias("said"), F.lit(y).alias("label")) for v, y in [(match, 1), *own]])


def labelled(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of (fold, features, label) from the bounded sample: every candidate in it, and the variants of its true spans."""
    fold = F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(3)).cast("int")
    whole = rows.select(F.col(key).alias("key"), fold.alias("fold"), F.col(text).alias("whole")).where(F.length("whole") > 0)
    share = min(1.0, SAMPLE_ROWS / max(1, whole.select("key").count()))
    draw = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30))
    free = F.greatest(F.length("whole") - SAMPLE_CHARS, F.lit(0)) + 1
    place = (F.pmod(F.xxhash64("key", F.lit("at")), free) + 1).cast("int")
    sample = land(whole.where(draw < int(share * (1 << 30))).select("fold", F.substring("whole", place, F.lit(SAMPLE_CHARS)).alias("body")))
    true = sample.withColumn("base", F.concat(*[base_spans(F.col("body"), k) for k in KINDS]))
    natural = true.select("fold", F.explode(candidates(F.col("body"))).alias("c"), "base").select(
        "fold", "c.features", F.exists("base", lambda b: (b.start == F.col("c.start")) & (b.end == F.col("c.end"))).cast("int").alias("label"))
    made = true.select("fold", "body", F.explode("base").alias("b"))
    said = F.coalesce(*[F.when(F.col("b.kind") == k, _variants(k, F.col("b.match"))) for k in KINDS])
    written = made.select("fold", "body", "b", F.explode(said).alias("v"))
    start, end = F.col("b.start").cast("int"), F.col("b.end").cast("int")
    left = F.substring("body", F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    snippet = F.concat(left, F.col("v.said"), F.substring("body", end + 1, F.lit(CONTEXT)))
    planted = written.select("fold", F.col("b.kind").alias("kind"), "v.label", F.length(left).alias("at"), F.length("v.said").alias("n"), snippet.alias("snippet"))
    planted = planted.select("fold", "kind", "label", "at", "n", F.explode(candidates(F.col("snippet"))).alias("c"))
    placed = (F.col("c.start") == F.col("at")) & (F.col("c.end") == F.col("at") + F.col("n"))  # another reading of a card is none
    planted = planted.where((F.col("c.kind") == F.col("kind")) & (F.col("c.start") < F.col("at") + F.col("n")) & (F.col("c.end") > F.col("at"))).select(
        "fold", "c.features", F.when((F.col("kind") == "card") & ~placed, 0).otherwise(F.col("label")).alias("label"))
    return natural.unionByName(planted).groupBy("fold", "features").agg(
        F.sum("label").alias("positive"), F.sum(1 - F.col("label")).alias("negative"))


def train(rows: DataFrame, key: str = "doc_id", text: str = "text") -> PiiModel:
    """The sample's distinct vectors are few (features are small whole numbers) and come to the driver as counts."""
    counts = labelled(rows, key, text).orderBy("fold", "features").collect()
    table = np.array([[r.fold, r.positive, r.negative, *[r.features[f] for f in FEATURES]] for r in counts], dtype=float)
    if not len(table) or not table[:, 1].sum():
        return PiiModel(None, {})
    held = table[:, 0] == 0
    fitted, check = (table[~held], table[held]) if held.any() and (~held).any() else (table, table)
    model = fit(FEATURES, fitted[:, 3:], fitted[:, 1], fitted[:, 2])
    calibrate(model, check[:, 3:], check[:, 1], check[:, 2])
    p, kind = model.probabilities(check[:, 3:]), check[:, 3]
    return PiiModel(model, {k: threshold(p[kind == i], check[kind == i, 1], check[kind == i, 2], PRECISION, LEAST_PROBABILITY)
                            for i, k in enumerate(KINDS)})


def _overlap(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def _chosen(proposed: str, base: Column, model: PiiModel) -> Column:
    """Candidates over their kind's threshold that touch no base span and no better candidate; proposed: their column."""
    plain = "array<struct<start:bigint,end:bigint,kind:string>>"
    if model.trees is None:
        return F.array().cast(plain)
    limit = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(model.thresholds[k]))])
    scored = F.expr(f"transform(`{proposed}`, c -> named_struct('start', c.start, 'end', c.`end`, 'kind', c.kind, "
                    f"'p', {model.trees.probability_sql('c.features')}))")
    fine = F.filter(scored, lambda c: c.p >= F.element_at(limit, c.kind))

    def own(x: Column) -> Column:
        return F.transform(x, lambda c: F.struct(c.start.alias("start"), c.end.alias("end")))

    def free(kept: Column) -> Column:
        # first without the candidates that equal a base span, which is nearly all of them
        new = let(own(base), lambda b: F.filter(kept, lambda c: ~F.array_contains(b, F.struct(c.start.alias("start"), c.end.alias("end")))))
        return F.filter(new, lambda c: ~F.exists(base, lambda b: _overlap(b, c)))

    def best(kept: Column) -> Column:
        def beats(d: Column, c: Column) -> Column:
            return (d.p > c.p) | ((d.p == c.p) & ((d.start < c.start) | ((d.start == c.start) & (
                (d.end > c.end) | ((d.end == c.end) & (d.kind < c.kind))))))
        return F.filter(kept, lambda c: ~F.exists(kept, lambda d: _overlap(c, d) & beats(d, c)))

    picked = let(fine, lambda kept: F.when(F.size(kept) == 0, kept).otherwise(let(free(kept), best)))
    return F.transform(picked, lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), c.kind.alias("kind")))


def find(rows: DataFrame, model: PiiModel, text: str = "text", base: str = "base_pii", added: str = "added_pii") -> DataFrame:
    """The input with two more columns, arrays of (start, end, kind): base spans and the spans the model adds."""
    whole = F.coalesce(F.col(text), F.lit(""))
    spans = F.concat(*[base_spans(whole, k) for k in KINDS])
    bare = F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))
    proposed = fresh(rows, "proposed_pii")
    found = rows.withColumns({base: bare, proposed: candidates(whole)})
    return found.withColumn(added, _chosen(proposed, F.col(base), model)).drop(proposed)


def redact(rows: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """The input with each span (overlapping ones merged) replaced by its kind in brackets; a null text stays null."""
    base, added = fresh(rows, "base_pii"), fresh(rows, "added_pii")
    marked = find(rows, model, text, base, added)
    order = F.array_sort(F.concat(base, added))

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
            last.start.alias("start"), F.greatest(last.end, s.end).alias("end"), last.kind.alias("kind"))))
        return F.when(F.size(done) == 0, F.array(s)).when(s.start < last.end, joined).otherwise(F.concat(done, F.array(s)))

    merged = F.aggregate(order, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"), merge)
    whole = F.col(text)

    def pieces(spans: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            since = F.when(i == 0, F.lit(0)).otherwise(F.element_at(spans, F.greatest(i, F.lit(1))).end.cast("int"))
            return F.concat(F.substring(whole, since + 1, s.start.cast("int") - since), F.lit("["), F.upper(s.kind), F.lit("]"))
        rest = F.substring(whole, F.element_at(spans, -1).end.cast("int") + 1, F.length(whole))
        return F.array_join(F.concat(F.transform(spans, piece), F.array(rest)), "")

    clean = let(merged, lambda spans: F.when(F.size(spans) == 0, whole).otherwise(pieces(spans)))
    return marked.withColumn(text, clean).drop(base, added)


def report(rows: DataFrame, model: PiiModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts and digest of the base spans, and all spans by name."""
    found = find(rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), model)
    counts = [count_kind("base_pii", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_names(F.col("base_pii"), KINDS), 256).alias("base_sha256"),
                        span_names(F.concat("base_pii", "added_pii"), KINDS).alias("spans"),
                        F.size("added_pii").cast("long").alias("n_added"))
