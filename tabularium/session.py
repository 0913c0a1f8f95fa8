"""Session defaults, and the package's way to Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def session(master: str | None = None, app: str = "tabularium", **conf: str) -> SparkSession:
    """A session with the settings the library is tested under; cluster settings given to spark-submit stay."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true"}
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application, as --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_tabularium_shipped", None) != context.applicationId:
        archive = os.path.join(tempfile.mkdtemp(prefix="tabularium-"), "tabularium.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(PACKAGE.rglob("*.py")):
                out.write(file, file.relative_to(PACKAGE.parent))
        context.addPyFile(archive)
        context._tabularium_shipped = context.applicationId
    return spark
