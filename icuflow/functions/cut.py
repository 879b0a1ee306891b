"""Cut points: results that several later steps read are written once and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder that ``spark.checkpoint.dir`` names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write the rows as Parquet and read them back: a short plan that survives lost executors.

    Later steps then read only the columns they use and know the table's size.
    """
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
