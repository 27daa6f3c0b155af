"""Making the package importable on executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a session that was not given it.

    The same as passing it with ``--py-files``; not needed where it is installed.
    """
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="shortlist-")) / package.name
    archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
