"""A small isolation forest with fixed nodes: the third engine of the compared queries, walked by Spark and by SQL alike."""

from __future__ import annotations

from pyspark.sql import SparkSession

from palisade.operators.anomaly import FEATURES, NODE_SCHEMA, Model, average_path

# Fixed values. (tree, node, feature or None for a leaf, threshold, left, right, path); features are not scaled.
NODES = [
    (0, 0, "source_port", 1084.0, 1, 2, 0.0), (0, 1, None, 0.0, 1, 1, 7.0), (0, 2, "source_port", 1104.0, 3, 4, 0.0), (0, 4, None, 0.0, 4, 4, 6.0),
    (0, 3, "destination_port", 22.0, 5, 6, 0.0), (0, 5, None, 0.0, 5, 5, 1.0), (0, 6, None, 0.0, 6, 6, 5.0),
    (1, 0, "hour", 9.0, 1, 2, 0.0), (1, 1, None, 0.0, 1, 1, 6.5), (1, 2, "hour", 16.0, 3, 4, 0.0), (1, 4, None, 0.0, 4, 4, 6.0),
    (1, 3, "source_port", 1084.0, 5, 6, 0.0), (1, 5, None, 0.0, 5, 5, 6.0), (1, 6, None, 0.0, 6, 6, 1.5),
    (2, 0, "destination_port", 100.0, 1, 2, 0.0), (2, 2, None, 0.0, 2, 2, 6.0), (2, 1, "bytes_sent", 400_000_000.0, 3, 4, 0.0),
    (2, 3, None, 0.0, 3, 3, 4.5), (2, 4, None, 0.0, 4, 4, 2.0),
]
DEPTH, SAMPLE_SIZE, OFFSET = 3, 256, -0.83


def fixed_model(spark: SparkSession) -> Model:
    rows = [(tree, node, -1 if name is None else FEATURES.index(name), *rest) for tree, node, name, *rest in NODES]
    return Model(spark.createDataFrame(rows, NODE_SCHEMA), SAMPLE_SIZE, OFFSET, {c: (0.0, 1.0) for c in FEATURES}, {})


def walk_sql(features: list[str], source: str) -> str:
    """CTEs ending in ``third(eventId, raw, ascore, anom)`` over ``source``; ``features`` in the order of the forest's."""
    values = ", ".join(f"({tree}, {node}, {-1 if name is None else FEATURES.index(name)}, {cut}::DOUBLE, {left}, {right}, {path}::DOUBLE)"
                       for tree, node, name, cut, left, right, path in NODES)
    steps = "".join(f""",
walk{d + 1} AS (SELECT w.eventId, w.x, w.tree,
  CASE WHEN n.feature < 0 THEN w.node WHEN w.x[n.feature + 1] <= n.cut THEN n.l ELSE n.r END AS node
  FROM walk{d} w JOIN nodes n ON n.tree = w.tree AND n.node = w.node)""" for d in range(DEPTH))
    return f"""nodes(tree, node, feature, cut, l, r, path) AS (VALUES {values}),
walk0 AS (SELECT eventId, [{", ".join(features)}] AS x, tree, 0 AS node FROM {source}, (SELECT DISTINCT tree FROM nodes)){steps},
paths AS (SELECT w.eventId, -pow(2.0::DOUBLE, -avg(n.path) / {average_path(SAMPLE_SIZE)!r}::DOUBLE) AS raw
  FROM walk{DEPTH} w JOIN nodes n ON n.tree = w.tree AND n.node = w.node GROUP BY w.eventId),
third AS (SELECT eventId, raw, 1 / (1 + exp(raw)) AS ascore, raw < {OFFSET} AS anom FROM paths)"""
