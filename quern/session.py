"""Session helpers: lineage cutting that survives lost executors, table access, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's ``spark.checkpoint.dir`` is used as it is; a folder of our own only where none is set and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def durable(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder and cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_round(df: DataFrame) -> DataFrame:
    """durable() for the rounds of an iteration. A checkpoint keeps its plan's size estimate, joins multiply estimates, and after some
    rounds their digits take longer than the work; here the rows go on without an estimate."""
    df, spark = durable(df), df.sparkSession
    plain = spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False)
    return DataFrame(plain, spark)


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed: its folder joins the workers' path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def local_broadcast(spark: SparkSession, value, limit_bytes: int, size_bytes: int):
    """Broadcasts a driver-side value whose size was measured; refuses one beyond its bound."""
    if size_bytes > limit_bytes:
        raise ValueError(f"{size_bytes} bytes exceed the broadcast bound of {limit_bytes}")
    return spark.sparkContext.broadcast(value)


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with fewer splits than the cluster has cores, over all cores; any larger input stays as it is. For steps that
    are heavy a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
