"""Tables written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="matchlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialized(rows: DataFrame, name: str) -> DataFrame:
    """Write once, read many: ends the lineage and outlives executors."""
    spark = rows.sparkSession
    folder = new_folder(spark, name)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)
