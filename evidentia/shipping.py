"""Makes this package importable in Spark's Python workers, wherever the driver found it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_lock = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application's Python files, once for each Spark application."""
    sc = spark.sparkContext
    with _lock:
        if sc.applicationId in _shipped:
            return
        top, folder = os.path.dirname(os.path.abspath(__file__)), tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, True)
        at = os.path.join(folder, "evidentia_sources.zip")
        with zipfile.ZipFile(at, "w") as z:
            for found, _, names in os.walk(top):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(found, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
        sc.addPyFile(at)
        _shipped.add(sc.applicationId)
