"""Sends this package to the executors, so that Python workers can import it wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import sitemill


def ship_package(spark: SparkSession) -> None:
    """Once a context; Spark's own file server deals the archive out."""
    context = spark.sparkContext
    if getattr(context, "_sitemill_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(sitemill.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "sitemill_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("sitemill", os.path.relpath(path, top)))
    context.addPyFile(archive)
    context._sitemill_shipped = True
