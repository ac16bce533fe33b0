"""Sends this package to the executors' Python, so that functions which refer to its modules find them there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_code(spark: SparkSession | None = None) -> None:
    """Adds the package to the session's files, once a session."""
    sc = (spark or SparkSession.active()).sparkContext
    if getattr(sc, "_lociweave_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lociweave-code-"), "lociweave_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(target)
    sc._lociweave_shipped = True
