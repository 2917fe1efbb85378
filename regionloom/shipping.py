"""Bring this package to the Python workers of a session.

Workers import the modules that a pandas function lives in.  Spark's own file
server carries a zip of the package to each executor, so nobody has to install it
or to share a folder.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package along with this application's tasks, once."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # not already inside a zip
        archive = Path(tempfile.mkdtemp(prefix="regionloom-")) / "regionloom.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)
