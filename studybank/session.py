"""Session helpers: one place that knows how a studybank job talks to Spark.

Jobs never create their own session on a cluster; they take the one they are
given.  ``local_session`` exists for tests and the bench.  ``shared_dir`` reads
the cluster's ``spark.checkpoint.dir`` and only falls back to a scratch folder
when that setting is unset (local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``studybank`` importable on the executors' Python workers (UDFs,
    mapInPandas and applyInPandas functions live in this package): zip it once
    per SparkContext and register it with ``addPyFile``."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="studybank-pkg-"), "studybank.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg):
            if "__pycache__" in folder:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(key)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "studybank") -> SparkSession:
    """Build (or reuse) a local session configured like the cluster jobs expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STUDYBANK_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder; a machine-local one would do on a "
                             "local master only")
        conf = tempfile.mkdtemp(prefix="studybank-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work over a scan enough tasks.

    Repartitions only when the scan yields fewer partitions than the cluster has
    cores (e.g. one large Parquet row group); many input files already give a
    parallel scan and are left alone.  So is a plan with a shuffle of its own:
    counting its partitions would run it."""
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    spark = df.sparkSession
    target = max(spark.sparkContext.defaultParallelism,
                 int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


#: Bytes of the texts of a partition whose rows repeat them: well below the 1 MB of different values that a Parquet writer
#: keeps in a column's dictionary by default.
DEAL_BYTES = 640 << 10


def deals(sizes: DataFrame, col: str) -> int:
    """Number of partitions for texts of ``sizes[col]`` bytes whose rows repeat them.

    Where a text stands on many rows of one such partition, a writer keeps it once in the column's dictionary; in larger
    partitions the dictionary overflows and every row has its whole text."""
    total = sizes.agg(F.sum(col)).first()[0] or 0
    return max(sizes.sparkSession.sparkContext.defaultParallelism, -(-int(total) // DEAL_BYTES))


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and read it back.

    This survives executor loss (unlike cached or locally checkpointed blocks)
    and gives the next stage fresh statistics for its join choices.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
