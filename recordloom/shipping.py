"""Make the package importable in Python workers wherever the driver found it."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once an application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="recordloom-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def shipped(query: Callable) -> Callable:
    """A query whose first argument is the session, run after its code is shipped."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **options):
        ship(spark)
        return query(spark, *args, **options)

    return run
