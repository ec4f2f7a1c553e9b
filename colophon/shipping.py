"""What executors need: the package in Python workers, and folders that they share with the driver."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless their path leads to it anyway."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if root not in {Path(p).resolve() for p in paths if p}:
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "colophon"), "zip", root_dir=root, base_dir="colophon")
        context.addPyFile(archive)
    _shipped.add(context.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; without it a temporary one, in local mode alone."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="colophon-")
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"
