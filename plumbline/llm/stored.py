"""Intermediate tables as Parquet under the shared checkpoint folder, read back by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that nothing else uses."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, *partitions: str) -> DataFrame:
    """Writes ``df`` once and continues from there, which also cuts its lineage."""
    df.write.option("compression", "zstd").parquet(folder, partitionBy=list(partitions) or None)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
