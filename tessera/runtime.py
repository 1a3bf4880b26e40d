"""Session, table loading and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def reach_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver was started from; a cluster has it installed."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return reach_workers(
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own on a single machine; on a
    cluster an error, as every executor would write to a disk of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(sc, "_tessera_shared_dir", None)
    if known is None:
        known = sc._tessera_shared_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, known.removeprefix("file://"), True)
    return known


def spool(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors,
    and is columnar, so that later reads prune columns (unlike checkpoint())."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext.__dict__.setdefault("_tessera_spools", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_spools(spark: SparkSession) -> int:
    """Deletes the intermediates written so far, once the results that were made of them are stored; gives their number."""
    sc = spark.sparkContext
    paths = sc.__dict__.pop("_tessera_spools", [])
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)
