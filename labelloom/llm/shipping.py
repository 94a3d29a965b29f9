"""Sends this package to the executors, which then need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import labelloom

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application's Python files, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(labelloom.__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="labelloom-")), "labelloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("labelloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
