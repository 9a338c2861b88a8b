"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reach_workers(spark: SparkSession) -> None:
    """Workers look in the folder this package was imported from; enough where nodes share it."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors of a cluster that does not share the folder."""
    package = os.path.join(ROOT, "leafmill")
    archive = os.path.join(tempfile.mkdtemp(), "leafmill.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for root, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(root, name)
                    out.write(path, os.path.relpath(path, ROOT))
    spark.sparkContext.addPyFile(archive)
