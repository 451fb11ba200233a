"""Places for files that only a run needs."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a private one if unset.

    The fallback is for local runs and tests only, set once per application and deleted when Python ends;
    on a cluster executors could not see it, so there an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="locusflow-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def app_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; swept when Python ends, if the session still runs."""
    app = spark.sparkContext.applicationId
    if app not in _registered:
        _registered.add(app)
        atexit.register(_sweep_quietly, spark)
    return f"{shared_folder(spark)}/locusflow-scratch/{app}"


_registered: set[str] = set()


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Delete every scratch table of this application; call when all results are written."""
    delete(spark, app_folder(spark))


def _sweep_quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # a stopped session has no file system to ask
        if spark.sparkContext._jsc is not None:
            sweep(spark)


def scratch_file(spark: SparkSession, name: str) -> str:
    """A fresh path that ends in ``name``, in the application's folder."""
    return f"{app_folder(spark)}/{uuid.uuid4().hex}/{name}"
