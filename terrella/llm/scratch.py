"""Shared scratch space: the folder that driver and executors both see.

The folder is the one the session names in ``spark.checkpoint.dir``.  Where that
is unset, a session on one machine gets one of our own; on a cluster that is an error, as each
machine would see another folder.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_DIR = "/tmp/checkpoints"
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, also set as the context's checkpoint folder."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    own = sc._jsc.sc().getCheckpointDir()
    if not conf and own.isDefined():
        conf = own.get()
    if not conf and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = (conf or OWN_DIR).rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    top = f"{base}/terrella-{sc.applicationId}"
    if top not in _cleaned:
        _cleaned.add(top)
        atexit.register(_remove, spark, top)
    return top


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it back.

    Cuts the lineage without tying rows to one executor, fixes rows whose order
    or float sums could differ when recomputed, and lets later reads prune columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave and whose last reader is done; other frames are left alone."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            _remove(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps held.

    Shuffle files and broadcasts go from the executors' disks and memory only once the driver's JVM has collected their handles, which
    with a roomy heap comes late; operators of many jobs ask for it between their phases.
    """
    gc.collect()  # the JVM's objects stay while Python's handles do
    spark.sparkContext._jvm.System.gc()


def fetch(uri: str) -> str:
    """A local path of a file in the shared folder, for workers that map it.

    A ``file:`` URI is used in place; other stores are copied once to a folder of the worker's own.
    """
    import hashlib
    import os
    import tempfile

    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return uri
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    local = os.path.join(tempfile.gettempdir(), "terrella-" + hashlib.md5(uri.encode()).hexdigest())
    if not os.path.exists(local):
        part = f"{local}.{uuid.uuid4().hex}"
        with store.open_input_stream(path) as src, open(part, "wb") as dst:
            while piece := src.read(1 << 22):
                dst.write(piece)
        os.replace(part, local)
    return local


def store_bytes(uri: str, *arrays) -> None:
    """Write arrays one after another as one file in the shared folder, from a worker."""
    import os

    if uri.startswith("file:") or "://" not in uri:
        path = fetch(uri)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            for a in arrays:
                f.write(a.tobytes())
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as f:
        for a in arrays:
            f.write(a.tobytes())
