"""Merkle manifest of a table: one tree for each group (a source), one tree over the groups' roots.

A tree of fan-out 16 is kept in aligned blocks of 256 nodes. A block holds each level as one string of hex digests of
64 characters, so a run of 16 nodes is a fixed-width substring: its hash is the parent, what stands before and after a
node in it are the node's siblings. Block roots are the nodes of the next round, until a tree has one node; the roots of
all trees then go through the same rounds. Proofs are made top-down: a block gets its own path once, and hands it to its
256 nodes. Leaves are numbered by range partitions and a count per group and range, so a group with a third of all rows is
many ranges and blocks, and no task holds a tree. The texts are read once, for the leaf hash; after that a row is about
three digests wide.

Rules for odd input: a null field is hashed as ``-``; null and empty differ; a null group is a group of its own, before all
others; a null key comes first in its group and is never tampered with; rows of one group and key are ordered by their
leaf hash, and equal rows each keep a leaf; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.session import land

FAN, HEX = 16, 64
#: Nodes of an aligned block: two levels.
BLOCK = FAN * FAN
_RUN = FAN * HEX
_STEPS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
#: The fields of a leaf, in order, and which keys are tampered with in the check.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5


def leaf(*fields: Column) -> Column:
    """The hash of a row's fields, each with its length in front, so that no two rows are written alike."""
    def written(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[written(f) for f in fields]), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


@dataclass
class Tree:
    """``rounds[k]``: blocks of 256 nodes (tree, block, n, low, high, digest; the first round also ``nodes``); the last
    round has one block for each tree, and its digest is that tree's root. ``n`` counts the nodes of the block's tree."""

    rounds: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        return self.rounds[-1].select("tree", F.col("digest").alias("root"))


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, counted from 0 in their tree in that order, and ``n``, the rows of the tree."""
    by = ["tree", *order]
    dealt = land(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("range", F.shiftright("row", 33))
    counts = dealt.groupBy("tree", "range").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("tree").alias("of"), F.col("range").alias("in"), (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(whole).alias("n"))
    joined = dealt.join(starts, (F.col("tree") == F.col("of")) & (F.col("range") == F.col("in")))
    return joined.withColumn("at", F.col("row") + F.col("shift")).drop("of", "in", "shift", "row", "range")


def _hashed(level: Column, nodes: Column) -> Column:
    """The parents of a level's ``nodes`` digests, as one string."""
    runs = F.sequence(F.lit(0), F.floor((nodes - 1) / FAN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * _RUN + 1, F.lit(_RUN)), 256)), "")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """tree, at, n, digest and what is carried -> one row a block."""
    member = F.struct("at", "digest", *carried)
    grouped = nodes.groupBy("tree", F.floor(F.col("at") / BLOCK).alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(member)).alias("nodes"))
    low = grouped.withColumn("low", F.array_join(F.col("nodes.digest"), ""))
    high = low.withColumn("high", F.when(F.col("n") > 1, _hashed(F.col("low"), F.size("nodes"))).otherwise(F.col("low")))
    kept = [F.transform("nodes", lambda x: F.struct(*[x[c].alias(c) for c in carried])).alias("nodes")] if carried else []
    return high.select("tree", "block", "n", *kept, "low", "high",
                       F.when(F.col("n") > FAN, F.sha2("high", 256)).otherwise(F.col("high")).alias("digest"))


def grow(nodes: DataFrame, carried: list[str] | None = None) -> Tree:
    """Rounds over nodes (tree, at, n, digest): each is 256 times smaller than the one before."""
    rounds = [land(_blocks(nodes, carried or []))]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > BLOCK:
        most = -(-most // BLOCK)
        up = rounds[-1].select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), "digest")
        rounds.append(land(_blocks(up, [])))
    return Tree(rounds)


def _handed_down(blocks: DataFrame, above: DataFrame, carried: list[str]) -> DataFrame:
    """Every node of the blocks with its path: its own run's flanks, those of the run above in the block, the block's path.
    ``above``: tree, at (the block), path, subroot, root."""
    of = above.select(F.col("tree").alias("of"), F.col("at").alias("in"), F.col("path").alias("upper"), "subroot", "root")
    joined = blocks.join(of, (F.col("tree") == F.col("of")) & (F.col("block") == F.col("in")))
    places = F.sequence(F.lit(0), F.floor(F.length("low") / HEX).cast("int") - 1)
    nodes = joined.select("tree", "block", "n", "low", "high", "upper", "subroot", "root", *(["nodes"] if carried else []), F.explode(places).alias("k"))
    run, place = F.floor(F.col("k") / FAN).cast("int"), F.col("k") % FAN
    flat = nodes.select(
        "tree", (F.col("block") * BLOCK + F.col("k")).alias("at"), "n", "high", "upper", "subroot", "root", run.alias("run"), place.alias("place"),
        F.substring("low", run * _RUN + 1, F.lit(_RUN)).alias("own"), *[F.col("nodes")[F.col("k")][c].alias(c) for c in carried])

    def flanks(level: str, place: str) -> Column:
        return F.array(F.struct(F.substring(F.col(level), F.lit(1), F.col(place) * HEX).alias("left"),
                                F.substring(F.col(level), F.col(place) * HEX + HEX + 1, F.lit(_RUN)).alias("right")))

    none = F.array().cast(_STEPS)
    path = F.concat(F.when(F.col("n") > 1, flanks("own", "place")).otherwise(none),
                    F.when(F.col("n") > FAN, flanks("high", "run")).otherwise(none), F.col("upper"))
    return flat.select("tree", "at", path.alias("path"), "subroot", "root", F.substring("own", F.col("place") * HEX + 1, F.lit(HEX)).alias("digest"), *carried)


def _paths(tree: Tree, above: DataFrame, carried: list[str]) -> DataFrame:
    """Paths of all leaves; ``above`` has one row a tree."""
    for blocks in tree.rounds[:0:-1]:
        above = _handed_down(blocks, above, [])
    return _handed_down(tree.rounds[0], above, carried)


@dataclass
class Manifest:
    """Written trees of the groups and the written tree of their roots; ``carried`` are columns that ride with a leaf."""

    groups: Tree
    top: Tree
    carried: list[str]

    def proofs(self) -> DataFrame:
        """A row a leaf: ``digest`` (the leaf), ``path`` (left and right siblings of each level up to the root), ``subroot``,
        ``root`` and the carried columns."""
        none = F.array().cast(_STEPS)
        start = self.top.roots.select("tree", F.lit(0).cast("long").alias("at"), none.alias("path"), F.lit(None).cast("string").alias("subroot"), "root")
        groups = land(_paths(self.top, start, ["name"]).select(
            F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot"), "root"))
        return _paths(self.groups, groups, self.carried)


def build(rows: DataFrame, digest: Column, group: str, key: str, carried: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``rows``: a tree for each value of ``group``, leaves in the order of ``key``."""
    carried = {key: F.col(key)} | (carried or {})
    name = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n"))  # null before all others
    leaves = rows.select(name.alias("tree"), digest.alias("digest"), F.struct(*[c.alias(n) for n, c in carried.items()]).alias("with"))
    leaves = land(leaves.withColumn("key", F.col("with")[key]))  # dealing by ranges reads its input twice: texts only once
    groups = grow(_placed(leaves, "key", "digest", "with").select("tree", "at", "n", "digest", *[F.col("with")[n].alias(n) for n in carried]), list(carried))
    subroots = groups.roots.select(F.lit("root").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    return Manifest(groups, grow(_placed(subroots, "name"), ["name"]), list(carried))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, digest, lambda below, step: F.sha2(F.concat(step.left, below, step.right), 256))


def report(rows: DataFrame) -> DataFrame:
    """Per document its leaf, roots, the hash of its proof, and whether the proof holds after tampering: a fifth of the
    keys have A-Z of their text lower-cased first."""
    fields = [F.col(c) for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    tampered = F.when(chosen, leaf(*fields[:-1], ascii_lower(F.col("text"))))
    proofs = build(rows, leaf(*fields), "source", "doc_id", {"tampered": tampered}).proofs()
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s.left, s.right)), "")
    done = proofs.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                         folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 5, top_levels: int = 3) -> str:
    """The same over ``documents`` as DuckDB SQL, for up to 16**levels rows a source and 16**top_levels sources. Levels are
    plain tables here, and siblings come from joining nodes with the others of their run."""
    def written(value: str) -> str:
        return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"

    def hashed(text: str) -> str:
        return "sha256(" + " || ".join(written(v) for v in (*FIELDS[:-1], text)) + ")"

    def climb(name: str, first: str, count: int) -> list[str]:
        """Tables name_0 ... name_count: tree, pos, d, n."""
        out = [f"{name}_0 AS ({first})"]
        for k in range(count):
            out.append(f"""{name}_{k + 1} AS (SELECT tree, pos // 16 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d,
  (any_value(n) + 15) // 16 AS n FROM {name}_{k} GROUP BY tree, pos // 16)""")
        return out

    def sides(name: str, count: int) -> list[str]:
        return [f"""{name}_side_{k} AS (SELECT a.tree, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
  coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r, any_value(a.n) > 1 AS real
  FROM {name}_{k} a JOIN {name}_{k} b ON a.tree = b.tree AND a.pos // 16 = b.pos // 16 GROUP BY a.tree, a.pos)""" for k in range(count)]

    steps, joins, upper = [], [], []
    for k in range(levels):
        joins.append(f"JOIN leaf_side_{k} s{k} ON s{k}.tree = x.tree AND s{k}.pos = x.pos // {16 ** k}")
        upper.append(f"s{k}")
    joins.append("JOIN top_0 t ON t.name = x.tree")
    for k in range(top_levels):
        joins.append(f"JOIN top_side_{k} t{k} ON t{k}.pos = t.pos // {16 ** k}")
        upper.append(f"t{k}")
    inner = "sent"
    for k, s in enumerate(upper):
        steps.append(f"up_{k} AS (SELECT * REPLACE (CASE WHEN real_{k} THEN sha256(l_{k} || now || r_{k}) ELSE now END AS now) FROM {inner})")
        inner = f"up_{k}"
    tables = climb("leaf", "SELECT tree, pos, leaf AS d, n FROM numbered", levels) + sides("leaf", levels)
    tables += climb("top", f"""SELECT 'root' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, d, count(*) OVER () AS n FROM leaf_{levels}""", top_levels)
    tables += sides("top", top_levels)
    return f"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hashed AS (SELECT doc_id, coalesce('s' || source, 'n') AS tree, {hashed('text')} AS leaf, {hashed("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0 AS chosen FROM documents, bits),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
{", ".join(tables)},
sent AS (SELECT x.doc_id, x.leaf, q.d AS subroot, root.d AS root, CASE WHEN x.chosen THEN x.other ELSE x.leaf END AS now,
  {", ".join(f"{s}.l AS l_{k}, {s}.r AS r_{k}, {s}.real AS real_{k}" for k, s in enumerate(upper))}
  FROM numbered x JOIN leaf_{levels} q ON q.tree = x.tree CROSS JOIN top_{top_levels} root {" ".join(joins)}),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"CASE WHEN real_{k} THEN l_{k} || r_{k} ELSE '' END" for k in range(len(upper)))}) AS proof_sha256,
  now AS folded_root, now = root AS verified FROM {inner}
"""
