"""Session helpers: a local session for tests/bench and the shared scratch folder.

On a cluster the session is supplied by the caller; these helpers only *read* its
settings.  The one setting we may write is ``spark.checkpoint.dir`` and only when it
is unset (local runs and tests): lineage cuts and written intermediate tables must go
to the shared folder the cluster names there, never to a machine-local folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "canlens") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
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
        .config("spark.driver.memory", "16g")
        # Generated methods above the JIT limit (8000 bytes) run interpreted; let Spark
        # fall back to per-operator code for them instead (recommended on clusters too).
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(__import__("os").environ.get("CANLENS_LOG", "ERROR"))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a private one only if none is set."""
    current = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share (master {master})")
    # Local runs and tests only: one machine, so its own folder is shared.
    path = tempfile.mkdtemp(prefix="canlens-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    # getCheckpointDir returns the per-application sub folder, which is fine to nest in.
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "canlens-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


_SHIPPED: set[str] = set()


def write_shared_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one small file to any folder that Spark's file systems reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    try:
        out.write(content)
    finally:
        out.close()


def delete_shared(spark: SparkSession, path: str) -> None:
    """Delete a folder of the library's own on any file system that Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Make ``canlens`` importable in Python workers.

    Zips the package in memory, writes it once per application to the shared folder (local
    or remote) and registers it with ``addPyFile``, which every executor fetches from there."""
    import io
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    target = os.path.join(scratch_path(spark, "pyfiles"), "canlens.zip")
    write_shared_bytes(spark, target, packed.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
