"""A session for the registered queries."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> None:
    """UTC, and a folder for stored results where a session on one machine names none."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="icuflow-")
        atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(f"file://{folder}")
