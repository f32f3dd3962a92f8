"""What the operators of this subpackage share: tables, batches, UTF-8 bytes, spans of a pattern."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.session import prepare, read_table

#: Rows of an Arrow batch: texts can be long, and a batch has to fit a Python worker.
BATCH_ROWS = 256


def ready(spark: SparkSession) -> SparkSession:
    """The session with this package on its workers and batches that bound a worker's memory."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(ready(spark), folder, "documents")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("match", T.StringType())]))
_BLOCK = 128


def found_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start,end,match>>``, in code points, end exclusive.

    The gaps between matches come from ``split``; a match's start is the length of all that stands before
    it. Lengths are summed in blocks, so that a text with very many matches does not cost their square."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, match: F.struct(
            F.length(gap).cast("long").alias("gap"), match.alias("match")))

        def total(part: Column) -> Column:
            return F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + x.gap + F.length(x.match))

        def start(x: Column, i: Column, pairs: Column, sums: Column) -> Column:
            block = F.floor(i / F.lit(_BLOCK)).cast("int")
            before = F.aggregate(F.slice(sums, F.lit(1), block), F.lit(0).cast("long"), lambda acc, y: acc + y)
            within = total(F.slice(pairs, block * _BLOCK + 1, i - block * _BLOCK))
            return before + within + x.gap

        def with_pairs(pairs: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / F.lit(_BLOCK)).cast("int"))
            sums = F.transform(blocks, lambda b: total(F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK))))
            return _let(sums, lambda s: F.transform(pairs, lambda x, i: _let(start(x, i, pairs, s), lambda at: F.struct(
                at.alias("start"), (at + F.length(x.match)).alias("end"), x.match.alias("match")))))

        return _let(both, with_pairs)

    return _let(matches, lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(SPANS)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


let = _let


def span_names(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` joined by commas, by start, then kind as listed, then end."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(
        s.start.alias("start"), F.array_position(order, s.kind).alias("rank"), s.end.alias("end"), s.kind.alias("kind"))))
    return F.concat_ws(",", F.transform(keyed, lambda s: F.concat_ws(
        ":", s.kind, s.start.cast("string"), s.end.cast("string"))))


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")
