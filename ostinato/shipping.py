"""The package as an archive on the executors, for sessions whose workers can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    _SENT.add(app)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="ostinato-"), "ostinato.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, dirs, names in os.walk(os.path.join(root, "ostinato")):
            dirs[:] = [x for x in dirs if x != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), root))
    spark.sparkContext.addPyFile(out)
