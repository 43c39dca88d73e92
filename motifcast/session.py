"""Session helpers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package (as ``spark-submit --py-files`` does), once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_motifcast_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, f"{_PACKAGE.name}/{source.relative_to(_PACKAGE)}")
    with tempfile.NamedTemporaryFile(prefix="motifcast-", suffix=".zip", delete=False) as file:
        file.write(packed.getvalue())
    context.addPyFile(file.name)
    context._motifcast_shipped = True
