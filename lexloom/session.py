"""Session helpers: shipping the package to executors, durable intermediate tables, partition sizing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build_session(app: str = "lexloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for; ``conf`` overrides (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable in the executors' Python workers, once per application.

    The zip is written on the driver and served to the executors by Spark's own file server, so nothing relies on a
    shared installation path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="lexloom"), "lexloom_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def is_local(spark: SparkSession) -> bool:
    """Whether all executors are this machine."""
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where that is unset a temporary one serves a local master (tests); a cluster fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark, "_lexloom_shared", None)
        if base is None:
            base = tempfile.mkdtemp(prefix="lexloom-shared")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            spark._lexloom_shared = base
    return base


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/lexloom/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; DataFrames that still read them must have been used by then. Call it before the session stops."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return a scan of it.

    Cuts the lineage: a lost executor costs only the tasks that ran on it. Unlike a cached or local checkpoint the
    files survive every executor, and later readers prune columns."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are over, which it does when the driver collects its garbage; else they stay beside those of the next steps."""
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes a core that an input is spread over all cores at most; larger inputs have splits enough.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Use all cores for a small input that may be one file with one row group; what is shuffled is at most ``SPREAD_BYTES`` a core.

    The size is that of the sources, as the planner knows it. Larger inputs pass unshuffled: Spark splits their files by size."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size > cores * SPREAD_BYTES:
        return df
    return df.repartition(cores, *cols) if cols else df.repartition(cores)
