"""Writing runs and reading stored results back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import strip
from plumbline.names import RESULT_COLUMNS, col


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """Delimited export with a header. ``single_file`` puts everything through one task: for small tables only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A stored result table; every column is text but ``count``, where bad values become 0."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    number = F.coalesce(F.coalesce(strip(F.col("count")).try_cast("bigint"), strip(F.col("count")).try_cast("double").try_cast("bigint")), F.lit(0)) \
        if "count" in raw.columns else None
    text = [c for c in raw.columns if c != "count"]
    out = raw.select(*[F.coalesce(col(c), F.lit("")).alias(c) for c in text], *([number.alias("count")] if number is not None else []))
    base = [c for c in RESULT_COLUMNS if c in out.columns]
    return out.select(*base, *[col(c) for c in out.columns if c not in base])


def run_path(path: str, run_id: str, kind: str) -> str:
    """The folder of one artifact of a run."""
    return f"{path}/{kind}/run_id={run_id}"


def write_run(path: str, run_id: str, original: DataFrame | None = None, results: DataFrame | None = None,
              amended: DataFrame | None = None) -> dict[str, str]:
    """Store the artifacts of a run as parquet below ``{path}/{kind}/run_id={run_id}``. Writing the same run again
    replaces it, so a repeated run leaves one copy. Returns the folder per artifact."""
    written = {}
    for kind, df in (("original", original), ("results", results), ("amended", amended)):
        if df is not None:
            written[kind] = run_path(path, run_id, kind)
            df.write.mode("overwrite").parquet(written[kind])
    return written
