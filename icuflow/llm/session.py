"""What the queries need of a session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

import icuflow

BATCH = 2000
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """UTC, small Arrow batches, the package on all executors, and a folder for stored results.

    Python workers hold a batch of whole texts, so BATCH rows bound their memory.
    The folder is the session's ``spark.checkpoint.dir``; only where that is unset on one machine, as in
    tests, it is a temporary one.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        context.addPyFile(_archive())
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(f"file://{_folder()}")


@contextmanager
def settings(spark: SparkSession, **values: int) -> Iterator[None]:
    """Other values of ``spark.sql.execution.arrow.*`` for the jobs that run inside."""
    names = {f"spark.sql.execution.arrow.{k}": v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def lean_workers(spark: SparkSession) -> None:
    """Python workers that give freed memory back at once, as they live on from one stage to the next.

    Large blocks are then mapped on their own and smaller ones trimmed; the C library reads these when a worker starts.
    """
    lean = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20)}
    spark.sparkContext.environment.update(lean)


def _folder() -> str:
    folder = tempfile.mkdtemp(prefix="icuflow-llm-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def _archive() -> str:
    """The package as a zip file, which Spark hands to the executors."""
    top = Path(icuflow.__file__).parent
    path = Path(_folder(), "icuflow.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    return str(path)
