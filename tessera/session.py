"""Session helpers: table access, and cutting lineage in the shared folder the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; its folder is left to whoever named it
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once, as a table in the checkpoint folder, and go on from there.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a temporary folder is made on a local master, as in tests;
    any other master raises, since executors don't share such a folder. Lost executors don't matter afterwards: the files are in the
    shared folder. As a table its columns are compressed and read one by one, and its size is known, so that the planner
    broadcasts only what is small. Tables are removed when the process ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, before work that costs far more than moving its rows.

    Only a plan without any exchange and with fewer partitions than cores is repartitioned, such as a table in one small file; a
    table of many files is left where it is, so nothing large is ever shuffled for this.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if "Exchange" in plan or df.rdd.getNumPartitions() >= cores else df.repartition(cores)
