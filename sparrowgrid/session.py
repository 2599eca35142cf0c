"""Session defaults and table loading shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "sparrowgrid") -> SparkSession:
    """A local session with the settings the operators assume; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.unionOutputPartitioning", "false")
        .getOrCreate()
    )


def sound(spark: SparkSession) -> SparkSession:
    """Turns off an optimisation of Spark 4.1 that can pair the wrong partitions of a union's shuffled sides (wrong rows, or "Can't zip
    RDDs with unequal numbers of partitions"); tests/test_evolving.py shows it. Other versions don't know the setting."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (``spark.checkpoint.dir``); a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sparrowgrid.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sparrowgrid-')}"
        spark.conf.set("sparrowgrid.shared.dir", found)
    return f"{found.rstrip('/')}/sparrowgrid/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` under ``sf_dir``; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of few files and no more bytes than this is dealt over all cores.
SMALL_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores is dealt over the cores before costly expressions; others stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if len(df.inputFiles()) < cores and size <= SMALL_BYTES else df
