"""Declarative rules: loaded on the driver, evaluated as plain Column predicates."""

from __future__ import annotations

import glob
import os
import re
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = [
    "equals", "not_equals", "contains", "not_contains", "in", "not_in", "regex",
    "greater_than", "less_than", "exists", "not_exists",
]
#: Enabled rules from which on a pack is indexed instead of written out as one expression.
INDEX_FROM = 200
RULES_PER_ARRAY = 64  # keeps each generated expression small when there are many rules
PACK = os.path.join(os.path.dirname(os.path.dirname(__file__)), "rules")

RULE_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("tags", T.ArrayType(T.StringType()), False),
    T.StructField("enabled", T.BooleanType(), False),
    T.StructField("conditions", T.IntegerType(), False),
])


class RuleError(ValueError):
    """A rule document that cannot be used; the message names the rule."""


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Any


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    description: str = ""
    severity: str = "medium"
    tags: tuple[str, ...] = ()
    enabled: bool = True
    conditions: tuple[Condition, ...] = field(default=())


def check_pattern(pattern: Any, label: str) -> None:
    """Patterns run in Java's dialect; what that cannot compile is refused when the rule is read, not in a task."""
    context = SparkContext._active_spark_context
    try:
        re.compile(str(pattern)) if context is None else context._jvm.java.util.regex.Pattern.compile(str(pattern))
    except (re.error, IllegalArgumentException) as error:
        raise RuleError(f"{label}: bad pattern {pattern!r}") from error


def parse_rule(document: dict, origin: str = "rule") -> Rule:
    label = f"{origin}: {document.get('id') or document.get('name') or 'unnamed rule'}"
    if "name" not in document:
        raise RuleError(f"{label}: no name")
    conditions = []
    for entry in document.get("conditions") or []:
        for needed in ("field", "value"):
            if needed not in entry:
                raise RuleError(f"{label}: condition without {needed}")
        operator = entry.get("operator", "equals")
        if operator not in OPERATORS:
            raise RuleError(f"{label}: unknown operator {operator!r}")
        if operator == "regex":
            check_pattern(entry["value"], label)
        conditions.append(Condition(entry["field"], operator, entry["value"]))
    return Rule(
        id=document.get("id", document["name"]),
        name=document["name"],
        description=document.get("description", ""),
        severity=document.get("severity", "medium"),
        tags=tuple(document.get("tags") or ()),
        enabled=document.get("enabled", True),
        conditions=tuple(conditions),
    )


def load_rules(folder: str = PACK) -> list[Rule]:
    """Every document of ``*.yaml`` then ``*.yml``; a document may be one rule or a list."""
    rules: list[Rule] = []
    for pattern in ("*.yaml", "*.yml"):
        for path in sorted(glob.glob(os.path.join(folder, pattern))):
            with open(path, encoding="utf-8") as handle:
                for document in yaml.safe_load_all(handle):
                    if document is None:
                        continue
                    for entry in document if isinstance(document, list) else [document]:
                        rules.append(parse_rule(entry, os.path.basename(path)))
    return rules


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [
        (i, r.id, r.name, r.description, r.severity, list(r.tags), r.enabled, len(r.conditions))
        for i, r in enumerate(rules, start=1)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def by_tag(rules: list[Rule], tag: str) -> list[Rule]:
    return [r for r in rules if tag in r.tags]


def by_id(rules: list[Rule], rule_id: str) -> Rule | None:
    return next((r for r in rules if r.id == rule_id), None)


def enabled_rules(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.enabled]


# --- fields -------------------------------------------------------------------------------

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Resolved:
    """A field path bound to a schema: a typed column, a variant, or nothing."""

    column: Column
    kind: str  # string | number | boolean | array | map | variant | other | missing


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, NUMBERS):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.ArrayType):
        return "array"
    if isinstance(data_type, T.MapType):
        return "map"
    if isinstance(data_type, T.VariantType):
        return "variant"
    return "other"


def resolve(schema: T.StructType, path: str) -> Resolved:
    """Dotted path to a column: struct field, then map key or variant path; null on a miss."""
    missing = Resolved(F.lit(None).cast("string"), "missing")
    steps = path.split(".")
    if steps[0] not in schema.fieldNames():
        return missing
    column, data_type = F.col(f"`{steps[0]}`"), schema[steps[0]].dataType
    for position, step in enumerate(steps[1:], start=1):
        if isinstance(data_type, T.StructType):
            if step not in data_type.fieldNames():
                return missing
            column, data_type = column.getField(step), data_type[step].dataType
        elif isinstance(data_type, T.MapType):
            column, data_type = F.try_element_at(column, F.lit(step)), data_type.valueType
        elif isinstance(data_type, T.VariantType):
            rest = "".join(f"['{s}']" for s in steps[position:])
            return Resolved(F.try_variant_get(column, f"${rest}", "variant"), "variant")
        else:
            return missing
    return Resolved(column, _kind(data_type))


def _variant_as(column: Column, kind: str) -> Column:
    """The variant as ``kind`` when it holds that kind of value, else null."""
    shape = F.schema_of_variant(column)
    if kind == "string":
        return F.when(shape == "STRING", F.try_variant_get(column, "$", "string"))
    if kind == "boolean":
        return F.when(shape == "BOOLEAN", F.try_variant_get(column, "$", "boolean"))
    return F.when(shape.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(column, "$", "double"))


def _literal_kind(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "other"


# --- conditions ---------------------------------------------------------------------------


def _present(f: Resolved) -> Column:
    if f.kind == "variant":
        return F.coalesce(F.schema_of_variant(f.column) != "VOID", F.lit(False))
    return f.column.isNotNull()


def _equals(f: Resolved, value: Any) -> Column:
    if value is None:
        return ~_present(f)
    wanted = _literal_kind(value)
    if f.kind == "missing" or wanted == "other":
        return F.lit(False)
    if f.kind == "variant":
        return F.coalesce(_variant_as(f.column, wanted) == F.lit(value), F.lit(False))
    if f.kind == wanted:
        return f.column.eqNullSafe(F.lit(value))
    if {f.kind, wanted} == {"boolean", "number"}:  # true equals 1, false equals 0
        return f.column.cast("double").eqNullSafe(F.lit(float(value)))
    return F.lit(False)


def _text(f: Resolved) -> Column:
    """Text form of a value that counts as present; null for null, '', 0, false and empties."""
    if f.kind == "missing":
        return F.lit(None).cast("string")
    if f.kind == "variant":
        text = F.try_variant_get(f.column, "$", "string")
        return F.when(~F.coalesce(text, F.lit("")).isin("", "0", "0.0", "false", "[]", "{}"), text)
    if f.kind == "boolean":
        return F.when(f.column, F.lit("True"))
    if f.kind == "number":
        return F.when(f.column != 0, f.column.cast("string"))
    if f.kind in ("array", "map"):
        return F.when(F.size(f.column) > 0, F.to_json(f.column))
    return F.nullif(f.column.cast("string"), F.lit(""))


def _compare(f: Resolved, value: Any, greater: bool) -> Column:
    wanted = _literal_kind(value)
    column = f.column
    if f.kind == "variant":
        column = _variant_as(f.column, wanted).cast("int") if wanted == "boolean" else _variant_as(f.column, wanted)
    elif f.kind != wanted and not (f.kind == "boolean" and wanted == "number"):
        return F.lit(False)  # values that cannot be ordered never match
    elif f.kind == "boolean":
        column = f.column.cast("int")
    literal = F.lit(int(value) if wanted == "boolean" else value)
    return F.coalesce(column > literal if greater else column < literal, F.lit(False))


def condition_column(schema: T.StructType, condition: Condition) -> Column:
    """True or false for every row, never null."""
    f, value, operator = resolve(schema, condition.field), condition.value, condition.operator
    if operator == "equals":
        return _equals(f, value)
    if operator == "not_equals":
        return ~_equals(f, value)
    if operator == "contains":
        return F.coalesce(_text(f).contains(str(value)), F.lit(False))
    if operator == "not_contains":
        return ~F.coalesce(_text(f).contains(str(value)), F.lit(False))
    if operator in ("in", "not_in"):
        listed = F.lit(False)
        strings = isinstance(value, list) and all(isinstance(v, str) for v in value)
        if strings and f.kind == "string":
            listed = F.coalesce(f.column.isin(*value), F.lit(False)) if value else listed
        elif isinstance(value, list):
            for v in value:
                listed = listed | _equals(f, v)
        return listed if operator == "in" else ~listed
    if operator == "regex":
        return F.coalesce(_text(f).rlike(str(value)), F.lit(False))
    if operator in ("greater_than", "less_than"):
        return _compare(f, value, operator == "greater_than")
    return _present(f) if operator == "exists" else ~_present(f)


def rule_column(schema: T.StructType, rule: Rule) -> Column:
    """All conditions hold; a disabled rule never matches, one without conditions always does."""
    matched = F.lit(rule.enabled)
    for condition in rule.conditions if rule.enabled else ():
        matched = matched & condition_column(schema, condition)
    return matched


def matched_rules(schema: T.StructType, rules: list[Rule]) -> Column:
    """Array of the matching rules in catalogue order."""
    return matched_numbered(schema, [(i, r) for i, r in enumerate(rules, start=1) if r.enabled])


def matched_numbered(schema: T.StructType, numbered: list[tuple[int, Rule]]) -> Column:
    """The same for enabled rules with their places in the catalogue."""
    entries = []
    for ordinal, rule in numbered:
        tags = F.array(*[F.lit(t) for t in rule.tags]).cast("array<string>")
        record = F.struct(
            F.lit(ordinal).alias("ordinal"),
            F.lit(rule.id).alias("id"),
            F.lit(rule.name).alias("name"),
            F.lit(rule.severity).alias("severity"),
            F.lit(rule.description).alias("description"),
            tags.alias("tags"),
        )
        entries.append(F.when(rule_column(schema, rule), record))
    if not entries:
        return F.array().cast(MATCHED_TYPE)
    parts = [
        F.array_compact(F.array(*entries[i:i + RULES_PER_ARRAY]))
        for i in range(0, len(entries), RULES_PER_ARRAY)
    ]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


MATCHED_TYPE = (
    "array<struct<ordinal:int,id:string,name:string,severity:string,description:string,tags:array<string>>>"
)


def with_matched_rules(events: DataFrame, rules: list[Rule], index_from: int = INDEX_FROM) -> DataFrame:
    """Packs of ``index_from`` enabled rules or more go through the predicate index; the result is the same."""
    if len(enabled_rules(rules)) >= index_from:
        from palisade.operators import ruleindex

        return ruleindex.with_matched_rules(events, rules)
    return events.withColumn("matchedRules", matched_rules(events.schema, rules))
