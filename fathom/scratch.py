"""Tables on the way: written once into the folder that all executors share, and read back, so that plans stay short and lost executors cost no more than their tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, read from the session. Only where it is unset and Spark runs in one local JVM (tests) is a temporary folder made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="fathom-"))
    return path


_LOCAL: dict[str, str] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fathom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
