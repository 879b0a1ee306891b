"""Raw tables, landing, and the sinks of the jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, paths and columns of the raw tables, in file order.
PATHS = {
    "patients": "hosp/patients.csv.gz",
    "admissions": "hosp/admissions.csv.gz",
    "icustays": "icu/icustays.csv.gz",
    "chartevents": "icu/chartevents.csv.gz",
    "inputevents": "icu/inputevents.csv.gz",
    "procedureevents": "icu/procedureevents.csv.gz",
}
EVENT_SCHEMAS = {
    "chartevents": """
        subject_id long, hadm_id long, stay_id long, caregiver_id long,
        charttime string, storetime string, itemid int, value string,
        valuenum double, valueuom string, warning string
    """,
    "inputevents": """
        subject_id long, hadm_id long, stay_id long, caregiver_id long,
        starttime string, endtime string, storetime string, itemid int,
        amount double, amountuom string, rate double, rateuom string,
        orderid long, linkorderid long, ordercategoryname string,
        secondaryordercategoryname string, ordercomponenttypedescription string,
        ordercategorydescription string, patientweight double, totalamount double,
        totalamountuom string, isopenbag int, continueinnextdept int,
        statusdescription string, originalamount double, originalrate double
    """,
    "procedureevents": """
        subject_id long, hadm_id long, stay_id long, caregiver_id long,
        starttime string, endtime string, storetime string, itemid int,
        value string, valueuom string, location string, locationcategory string,
        orderid long, linkorderid long, ordercategoryname string,
        ordercategorydescription string, patientweight double, isopenbag int,
        continueinnextdept int, statusdescription string, originalamount double,
        originalrate double
    """,
}
DIMENSION_COLUMNS = {
    "patients": {"subject_id": "long", "gender": "string", "anchor_age": "int"},
    "admissions": {"subject_id": "long", "hadm_id": "long", "deathtime": "timestamp"},
    "icustays": {
        "subject_id": "long",
        "hadm_id": "long",
        "stay_id": "long",
        "intime": "timestamp",
        "outtime": "timestamp",
    },
}
TIMES = ("charttime", "starttime", "endtime", "storetime")


def read_table(spark: SparkSession, root: str, name: str, path: str | None = None) -> DataFrame:
    """An event table with its declared schema.

    A file whose header disagrees with the schema is refused: columns would
    otherwise be taken by position. Times that cannot be parsed become missing.
    """
    raw = (
        spark.read.schema(EVENT_SCHEMAS[name])
        .option("header", True)
        .option("enforceSchema", False)
        .csv(f"{root}/{path or PATHS[name]}")
    )
    return raw.withColumns({c: F.try_to_timestamp(c) for c in TIMES if c in raw.columns})


def read_dim(spark: SparkSession, root: str, name: str, path: str | None = None) -> DataFrame:
    """The used columns of a dimension table; times that cannot be parsed become missing."""
    raw = spark.read.option("header", True).csv(f"{root}/{path or PATHS[name]}")
    columns = []
    for column, kind in DIMENSION_COLUMNS[name].items():
        c = F.col(column)
        typed = F.try_to_timestamp(c) if kind == "timestamp" else c.cast(kind)
        columns.append(typed.alias(column))
    return raw.select(*columns)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(
    df: DataFrame, path: str, files: int | None = None, partition_by: Sequence[str] = ()
) -> str:
    """Overwrite a Parquet table; with ``files`` in so many files, without slowing what makes the rows."""
    out = df.repartition(files) if files else df
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def cluster_events(df: DataFrame, ts: str) -> DataFrame:
    """Lay events out for channel reads: by item, then stay and time, in ranges of equal size.

    However frequent an item is, it fills as many files as its share asks for.
    Sorted files give narrow item ranges per row group, so a filter on the item
    skips the rest.
    """
    order = ["itemid", "stay_id", ts]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def ingest_raw(
    spark: SparkSession, source: str, target: str, paths: dict[str, str] | None = None
) -> DataFrame:
    """Land every raw table found under ``source`` as Parquet under ``target``.

    Returns ``(name, present, n_rows)`` per table. Compressed CSV cannot be
    split, so landing reads it once and every later job reads Parquet.
    """
    report = []
    for name, path in {**PATHS, **(paths or {})}.items():
        try:
            if name in EVENT_SCHEMAS:
                df = read_table(spark, source, name, path)
                ts = "charttime" if "charttime" in df.columns else "starttime"
                df = cluster_events(df, ts)
            else:
                df = read_dim(spark, source, name, path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            report.append((name, False, None))
            continue
        write_table(df, f"{target}/{name}")
        report.append((name, True, spark.read.parquet(f"{target}/{name}").count()))
    return spark.createDataFrame(report, "name string, present boolean, n_rows long")


def write_dataset(dataset: DataFrame, names: DataFrame, path: str, files: int | None = None) -> str:
    """The final dataset and its feature names: ``path/windows`` and ``path/features``."""
    write_table(dataset, f"{path}/windows", files)
    write_table(names, f"{path}/features", 1)
    return path


def write_documents(
    documents: DataFrame, path: str, key: str = "subject_id", per_key: bool = False
) -> str:
    """Write the column ``document`` as JSON, one document per line, spread by subject.

    ``per_key`` makes a directory per subject instead, for a reader that opens
    one subject's file; with very many subjects that is very many files.
    """
    if per_key:
        lines = documents.select(F.to_json("document").alias("value"), F.col(key))
        lines.repartition(key).write.mode("overwrite").partitionBy(key).text(path)
    else:
        spread = documents.repartition(key)
        spread.select(F.to_json("document").alias("value")).write.mode("overwrite").text(path)
    return path


def head_sample(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)
