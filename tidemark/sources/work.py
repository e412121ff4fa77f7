"""What a cluster needs to know: the folder that it shares, and this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

from .fs import Files


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()  # the driver's own: executors get the file from the driver
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(os.path.realpath(folder), "tidemark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for place, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs on one machine (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = "file:///tmp/checkpoints"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder, deleted when the process ends."""
    files = Files(spark, f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex[:12]}")

    def clear() -> None:
        try:
            files.delete("")
        except Exception:  # the session may be gone at exit
            pass

    atexit.register(clear)
    return files.root
