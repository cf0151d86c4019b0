"""Running counts over streams of records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.names import col
from plumbline.operators.combos import unique_combos
from plumbline.rules.registry import columns_source


def with_watermark(stream: DataFrame, at: str, delay: str) -> DataFrame:
    """Records later than ``delay`` behind the newest one are dropped by stateful operators downstream."""
    return stream.withWatermark(at, delay)


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped as late so far, from the query's own progress reports."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def stream_combos(stream: DataFrame, cols: Sequence[str], at: str | None = None, window: str | None = None) -> DataFrame:
    """Distinct combinations with running counts, for ``update`` (or ``complete``) output.

    With ``at`` and ``window`` the counts are per time window and, given a watermark, their state is dropped
    when a window closes; without them state grows with the number of distinct combinations.
    """
    if at is None:
        return unique_combos(stream, cols)
    read = columns_source(stream)
    keyed = stream.select(col(at), *[read(c).alias(c) for c in cols])
    return keyed.groupBy(F.window(col(at), window or "1 hour").alias("window"), *[col(c) for c in cols]).agg(
        F.count(F.lit(1)).alias("count"))


def store_counts(stream: DataFrame, cols: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Keep running counts up to date below ``out``: each micro-batch writes the combinations it changed to its
    own folder, so a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream_combos(stream, cols).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(stored: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The newest count of every combination in what :func:`store_counts` wrote."""
    return stored.groupBy(*[col(c) for c in cols]).agg(F.max_by("count", "batch").alias("count"))


# --- counts in a base and deltas -----------------------------------------------------------------------------------------

MERGE_EVERY = 20  # deltas beside the base at most
_COMMIT = "newest timestamp, taken bigint, late bigint"
_MANIFEST = "version bigint, upto bigint"


def _there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _manifest(spark: SparkSession, out: str) -> tuple[int, int]:
    """(version of the base, last batch in it); -1 for none. One row is added with each merge."""
    rows = _there(spark, f"{out}/manifest", _MANIFEST)
    best = None if rows is None else rows.agg(F.max(F.struct("version", "upto"))).first()[0]
    return (-1, -1) if best is None else (best["version"], best["upto"])


def count_batch(out: str, cols: Sequence[str], at: str | None = None, delay: str | None = None, merge_every: int = MERGE_EVERY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds the counts of a batch to those below ``out`` without any state in the stream.

    Each batch writes its own counts to ``deltas``; after ``merge_every`` of them base and deltas are folded into the next version of the base,
    which the manifest names once it is whole. With ``at`` and ``delay``, rows that lie further than that behind the newest row of earlier batches are
    late: they are not counted but kept in ``late``. A repeated batch replaces its own folders; one that is in the base already is left out.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= _manifest(spark, out)[1]:
            return
        rows, late, newest = batch, None, None
        if at is not None:
            before = _there(spark, f"{out}/commits/batch={batch_id - 1}", _COMMIT)
            newest = None if before is None else before.agg(F.max("newest")).first()[0]
            if newest is not None and delay is not None:
                old = F.coalesce(col(at) < F.lit(newest) - F.expr(f"INTERVAL {delay}"), F.lit(False))
                rows, late = batch.where(~old), batch.where(old)
        unique_combos(rows, cols).write.mode("overwrite").parquet(f"{out}/deltas/batch={batch_id}")
        if late is not None:
            late.write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        seen = F.max(col(at)).cast("timestamp") if at is not None else F.lit(None).cast("timestamp")
        lost = 0 if late is None else spark.read.parquet(f"{out}/late/batch={batch_id}").count()
        commit = rows.agg(F.greatest(seen, F.lit(newest).cast("timestamp")).alias("newest"), F.count("*").alias("taken")).withColumn("late", F.lit(lost).cast("bigint"))
        commit.write.mode("overwrite").parquet(f"{out}/commits/batch={batch_id}")
        if batch_id - _manifest(spark, out)[1] >= merge_every:
            merge_counts(spark, out, cols, batch_id)

    return run


def _parts(spark: SparkSession, out: str, cols: Sequence[str], upto: int) -> DataFrame | None:
    version, merged = _manifest(spark, out)
    paths = ([f"{out}/base/version={version}"] if version >= 0 else []) + [f"{out}/deltas/batch={b}" for b in range(merged + 1, upto + 1)]
    schema = ", ".join(f"`{c}` string" for c in cols) + ", count bigint"
    return spark.read.schema(schema).parquet(*paths) if paths else None


def _folded(parts: DataFrame, cols: Sequence[str]) -> DataFrame:
    return parts.groupBy(*[col(c) for c in cols]).agg(F.sum("count").alias("count"))


def merge_counts(spark: SparkSession, out: str, cols: Sequence[str], upto: int) -> None:
    """Fold the base and the deltas up to batch ``upto`` into a new base."""
    parts = _parts(spark, out, cols, upto)
    if parts is None:
        return
    version = _manifest(spark, out)[0] + 1
    _folded(parts, cols).write.mode("overwrite").parquet(f"{out}/base/version={version}")
    spark.createDataFrame([(version, upto)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{out}/manifest")


def current_counts(spark: SparkSession, out: str, cols: Sequence[str], upto: int) -> DataFrame:
    """The counts after batch ``upto``: one base and ``MERGE_EVERY`` deltas at most are read, however long the stream has run."""
    return _folded(_parts(spark, out, cols, upto), cols)


def last_batch(spark: SparkSession, out: str) -> int:
    """The last batch that was counted: from the manifest on, one folder after the other."""
    last = _manifest(spark, out)[1]
    while _there(spark, f"{out}/commits/batch={last + 1}", _COMMIT) is not None:
        last += 1
    return last


def start_counts(stream: DataFrame, cols: Sequence[str], out: str, checkpoint: str, **how) -> StreamingQuery:
    """Count what is there, batch by batch, and stop."""
    return stream.writeStream.foreachBatch(count_batch(out, cols, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
