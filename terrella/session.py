"""Sessions, and how workers find this code."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    b = SparkSession.builder.master(f"local[{cores}]").appName("terrella")
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle), "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true",
    }
    spark = b.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    share_code(spark)
    return spark


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the session was started from."""
    env = spark.sparkContext.environment
    parts = [ROOT, *filter(None, env.get("PYTHONPATH", "").split(os.pathsep))]
    env["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(parts))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, set as the context's checkpoint folder; one of our own only on a single machine."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or "/tmp/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
