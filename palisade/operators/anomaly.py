"""Isolation forest over a fixed feature vector.

Training looks at every row once and draws each tree's 256 rows from the whole table; the trees are
then grown in parallel, one group per tree. The model is a table of nodes with a hard size
bound (trees x 511 rows), so scoring ships it with the tasks and walks all trees over Arrow
batches.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.schema import EVENT_KEY, EVENT_TYPES, severity_rank
from palisade.session import land

# Forest size, seed, contamination, thresholds and the reasons' texts.
TREES, SAMPLE, SEED, CONTAMINATION, MIN_EVENTS = 100, 256, 42, 0.01, 10
SCORE_THRESHOLD, VERY_HIGH = 0.8, 0.9
EULER = 0.57722
QUANTILE_ACCURACY = 100_000
#: Rows a tree is sent for each one it keeps.
OVERSAMPLE = 4
HASH_RANGE = 1 << 30
#: Nodes of a forest up to which it is walked without leaving the JVM.
NATIVE_NODES = 1024

FEATURES = [
    "hour", "weekday",
    *[f"is_{t}" for t in EVENT_TYPES if t != "unknown"],
    "severity", "success", "source_port", "destination_port", "bytes_sent", "bytes_received",
    "risk", "indicators",
]

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("path", T.DoubleType()),
])


def feature_columns() -> list[Column]:
    def number(column: Column) -> Column:
        return F.coalesce(column.cast("double"), F.lit(0.0))

    values = [F.hour("timestamp").cast("double"), F.weekday("timestamp").cast("double")]
    values += [(F.col("eventType") == t).cast("double") for t in EVENT_TYPES if t != "unknown"]
    values += [
        number(severity_rank(F.col("severity"))),
        (F.col("outcome") == "success").cast("double"),
        number(F.col("network.source_port")), number(F.col("network.destinationPort")),
        number(F.col("network.bytesSent")), number(F.col("network.bytesReceived")),
        number(F.col("risk_score")),
        F.coalesce(F.size("threatIndicators"), F.lit(0)).cast("double"),
    ]
    return [v.alias(name) for name, v in zip(FEATURES, values)]


def features(events: DataFrame) -> DataFrame:
    return events.select(*EVENT_KEY, *feature_columns())


@dataclass
class Model:
    nodes: DataFrame
    sample_size: int
    offset: float = -0.5
    scaler: dict = field(default_factory=dict)
    config: dict = field(default_factory=dict)


def fit_scaler(table: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of every feature in one pass; a constant feature scales by 1."""
    row = table.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES],
                    *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in FEATURES}


def scale(table: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return table.select(*EVENT_KEY, *[((F.col(c) - scaler[c][0]) / scaler[c][1]).alias(c) for c in FEATURES])


def average_path(n: int) -> float:
    """Average depth of an unsuccessful search in a binary tree of ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def grow_tree(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, path) of one tree; leaves have feature -1."""
    nodes: list[list] = []
    pending = [(rows, 0, None, 0)]
    while pending:
        part, depth, parent, side = pending.pop()
        number = len(nodes)
        if parent is not None:
            nodes[parent][3 + side] = number
        spread = part.max(axis=0) - part.min(axis=0)
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(part) <= 1 or len(usable) == 0:
            nodes.append([number, -1, 0.0, number, number, depth + average_path(len(part))])
            continue
        chosen = int(rng.choice(usable))
        low, high = part[:, chosen].min(), part[:, chosen].max()
        cut = float(rng.uniform(low, high))
        goes_left = part[:, chosen] <= cut
        nodes.append([number, chosen, cut, -1, -1, 0.0])
        pending.append((part[~goes_left], depth + 1, number, 1))
        pending.append((part[goes_left], depth + 1, number, 0))
    return [tuple(n) for n in nodes]


def _grow(seed: int, limit: int):
    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        ordered = frame.sort_values("h")[FEATURES].to_numpy(dtype="float64")
        grown = grow_tree(ordered, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out
    return grow


def draw_samples(table: DataFrame, rows: int, trees: int, sample: int, seed: int) -> DataFrame:
    """``sample`` rows per tree, from the whole table in one pass.

    A row's hash says to how many trees it goes (on average as many as give each tree ``OVERSAMPLE`` times its sample,
    all of them in a small table) and to which; of what a tree gets, the rows with the smallest hashes stay."""
    share = min(float(trees), OVERSAMPLE * trees * sample / max(1, rows))
    step = next(s for s in range(max(1, round(trees * 0.618)), 2 * trees + 1) if math.gcd(s, trees) == 1)
    drawn = F.pmod(F.xxhash64(F.lit(seed), *EVENT_KEY), F.lit(HASH_RANGE)) / F.lit(float(HASH_RANGE))
    count = (F.lit(math.floor(share)) + (drawn < share - math.floor(share)).cast("int")).cast("int")
    first = F.pmod(F.xxhash64(F.lit(seed), F.lit("first"), *EVENT_KEY), F.lit(trees))
    going = table.withColumn("count", count).where(F.col("count") > 0)
    per_tree = going.withColumn("tree", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.pmod(first + i * F.lit(step), F.lit(trees)).cast("int")))).drop("count")
    order = Window.partitionBy("tree").orderBy("h", *EVENT_KEY)
    return per_tree.withColumn("h", F.xxhash64(F.lit(seed), F.col("tree"), *EVENT_KEY)).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= sample).drop("rank")


def train(events: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED,
          contamination: float = CONTAMINATION) -> Model | None:
    """A trained model, or None when there are fewer than ten events."""
    table = features(events)
    rows = table.count()
    if rows < MIN_EVENTS:
        return None
    size = min(sample, rows)
    limit = math.ceil(math.log2(max(size, 2)))
    scaler = fit_scaler(table)
    drawn = draw_samples(scale(table, scaler), rows, trees, size, seed)
    nodes = land(
        drawn.select("tree", "h", *FEATURES).groupBy("tree").applyInPandas(_grow(seed, limit), NODE_SCHEMA))
    config = {"trees": trees, "sample": sample, "seed": seed, "contamination": contamination}
    model = Model(nodes, size, scaler=scaler, config=config)
    scored = events.select(*EVENT_KEY, isolation_score(model).alias("score"))
    model.offset = scored.agg(F.percentile_approx("score", F.lit(contamination), F.lit(QUANTILE_ACCURACY))).first()[0]
    return model


def _walker(model: Model):
    table = model.nodes.orderBy("tree", "node").toPandas()  # at most trees x 511 rows
    means = np.array([model.scaler[c][0] for c in FEATURES])
    deviations = np.array([model.scaler[c][1] for c in FEATURES])
    forest = [
        tuple(part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path"))
        for _, part in table.groupby("tree", sort=True)
    ]
    depth = math.ceil(math.log2(max(model.sample_size, 2)))
    norm = average_path(model.sample_size) or 1.0

    def walk(batch: pd.DataFrame) -> pd.Series:
        x = (batch.to_numpy(dtype="float64") - means) / deviations
        index = np.arange(len(x))
        total = np.zeros(len(x))
        for feature, threshold, left, right, path in forest:
            at = np.zeros(len(x), dtype="int64")
            for _ in range(depth):
                which = feature[at]
                goes_left = x[index, which] <= threshold[at]
                at = np.where(which < 0, at, np.where(goes_left, left[at], right[at]))
            total += path[at]
        return pd.Series(-np.power(2.0, -(total / len(forest)) / norm))
    return walk


def _native_walk(model: Model) -> Column:
    """The walk as an expression: each tree is a struct of arrays, each level one step in them. The forest comes as one JSON
    literal, which the optimiser turns into a constant."""
    rows = model.nodes.orderBy("tree", "node").collect()  # few, or the other walk is taken
    trees: dict[int, dict[str, list]] = {}
    for r in rows:
        tree = trees.setdefault(r.tree, {"f": [], "t": [], "l": [], "r": [], "p": []})
        for name, value in zip("ftlrp", (r.feature, r.threshold, r.left, r.right, r.path)):
            tree[name].append(value)
    forest = F.from_json(F.lit(json.dumps(list(trees.values()))), "array<struct<f:array<int>,t:array<double>,l:array<int>,r:array<int>,p:array<double>>>")
    x = F.array(*[(c - F.lit(float(model.scaler[n][0]))) / F.lit(float(model.scaler[n][1])) for n, c in zip(FEATURES, feature_columns())])
    levels = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(max(model.sample_size, 2)))))

    def path(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            which = F.get(tree.f, at)
            return F.when(which < 0, at).when(F.get(x, which) <= F.get(tree.t, at), F.get(tree.l, at)).otherwise(F.get(tree.r, at))

        return F.get(tree.p, F.aggregate(levels, F.lit(0), step))

    total = F.aggregate(F.transform(forest, path), F.lit(0.0), lambda acc, p: acc + p)
    norm = average_path(model.sample_size) or 1.0
    return -F.pow(F.lit(2.0), -(total / F.lit(float(len(trees)))) / F.lit(norm))


def isolation_score(model: Model, native: bool | None = None) -> Column:
    """The raw score in [-1, 0): lower is more unusual. Small forests are walked in an expression, large ones over Arrow batches."""
    if model.nodes.count() <= NATIVE_NODES if native is None else native:
        return _native_walk(model)
    walk = _walker(model)

    @F.pandas_udf(T.DoubleType())
    def score(batch: pd.DataFrame) -> pd.Series:
        return walk(batch)

    return score(F.struct(*feature_columns()))


def normalized_score(raw: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(raw))


def anomaly_reasons(score: Column, threshold: float = SCORE_THRESHOLD) -> Column:
    count = F.coalesce(F.size("threatIndicators"), F.lit(0))
    hour = F.hour("timestamp")
    reasons = F.array_compact(F.array(
        F.when(score > VERY_HIGH, "Highly unusual event pattern").when(score > threshold, "Unusual event characteristics"),
        F.when((hour < 6) | (hour > 22), "Activity during unusual hours"),
        F.when(F.col("risk_score") > 0.7, "High risk score"),
        F.when(count > 0, F.concat(F.lit("Threat indicators present: "), count.cast("string"))),
    ))
    return F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("Anomalous feature combination")))


def with_anomaly(events: DataFrame, model: Model | None, enabled: bool = True,
                 threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Add the ``anomaly`` struct; without a model nothing is anomalous."""
    if not enabled or model is None:
        reasons = F.array(F.lit("Model not yet trained")) if enabled else F.array().cast("array<string>")
        return events.withColumn("anomaly", F.struct(
            F.lit(False).alias("isAnomaly"), F.lit(0.0).alias("score"), reasons.alias("reasons")))
    scored = events.withColumn("__raw", isolation_score(model)).withColumn("__score", normalized_score(F.col("__raw")))
    flagged = (F.col("__raw") < model.offset) | (F.col("__score") > threshold)
    return scored.withColumn("anomaly", F.struct(
        flagged.alias("isAnomaly"), F.col("__score").alias("score"),
        anomaly_reasons(F.col("__score"), threshold).alias("reasons"),
    )).drop("__raw", "__score")


def save_model(model: Model, folder: str, version: str) -> None:
    """Nodes and settings as tables under ``folder/version=…``."""
    model.nodes.coalesce(1).write.mode("overwrite").parquet(f"{folder}/nodes/version={version}")
    settings = json.dumps({"sample_size": model.sample_size, "offset": model.offset, "scaler": model.scaler,
                           "config": model.config})
    spark = model.nodes.sparkSession
    spark.createDataFrame([(settings,)], "settings string").withColumn(
        "trained_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/settings/version={version}")


def load_model(spark: SparkSession, folder: str, version: str) -> Model:
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{folder}/nodes/version={version}")
    settings = json.loads(spark.read.parquet(f"{folder}/settings/version={version}").first()["settings"])
    scaler = {c: tuple(v) for c, v in settings["scaler"].items()}
    return Model(nodes, settings["sample_size"], settings["offset"], scaler, settings["config"])


def training_window(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The events a scheduled retraining looks at."""
    return events.where((F.col("timestamp") >= as_of - F.make_dt_interval(F.lit(days))) & (F.col("timestamp") < as_of))


def retrain_due(last_trained: Column, now: Column, hours: int = 24) -> Column:
    return last_trained.isNull() | (now >= last_trained + F.make_dt_interval(hours=F.lit(hours)))
