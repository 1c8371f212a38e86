"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "heatloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, for clusters where it is not installed."""
    sc = spark.sparkContext
    if getattr(sc, "_heatloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    folder = tempfile.mkdtemp(prefix="heatloom-package-")  # Spark serves it to the workers from the driver
    target = os.path.join(folder, "heatloom.zip")
    Path(target).write_bytes(packed.getvalue())
    sc.addPyFile(target)
    sc._heatloom_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session without that
    setting gets a temporary folder, because there every task runs on the same machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="heatloom-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return configured or sc.getCheckpointDir()


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table written by this job."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
