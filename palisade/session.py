"""Session settings and the one place that decides where lineage is cut."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(cores: int | str = "*", app: str = "palisade", **conf: str) -> SparkSession:
    """Local session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_prepared: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session the caller brought fit: event times in UTC, this package on the workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    application = spark.sparkContext.applicationId
    if application not in _prepared:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="palisade-package-"), "palisade")
        spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), "palisade"))
        _prepared.add(application)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch folder only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get(CHECKPOINT_DIR, None)
        if not configured:
            if not context.master.startswith("local"):
                raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
            configured = tempfile.mkdtemp(prefix="palisade-checkpoint-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def land(df: DataFrame, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage (a lost executor only
    rereads files), prunes columns for the readers, and gives the optimiser a true size. ``options`` go to the writer."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/landed/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _landed.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_landed: dict[str, list[str]] = {}


def landed_count(spark: SparkSession) -> int:
    """A mark for ``release``: tables landed so far."""
    return len(_landed.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the tables this session landed after the mark, but for the newest ``keep``; call it once results have been
    written. Returns how many went."""
    paths = _landed.get(spark.sparkContext.applicationId, [])
    gone = paths[since:max(since, len(paths) - keep)]
    for path in gone:
        delete_folder(spark, path)
    del paths[since:since + len(gone)]
    return len(gone)


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder on whatever file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def number_rows(df: DataFrame, name: str = "rowId") -> DataFrame:
    """Landed rows with a unique ``rowId``, to tell exact copies apart; the ids are fixed once written."""
    return df if name in df.columns else land(df.withColumn(name, F.monotonically_increasing_id()))


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a table that arrived in fewer pieces; larger tables are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
