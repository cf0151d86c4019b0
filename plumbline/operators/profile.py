"""Column profiles and table snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.names import col


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, count) over all columns as text; the null value counts the nulls."""
    names = list(columns or df.columns)
    cells = F.array(*[F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("value")) for n in names])
    return df.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def profile(df: DataFrame, columns: Sequence[str] | None = None, all_up_to: int = 10, top: int = 5, bottom: int = 2,
            width: int = 50) -> DataFrame:
    """Shown values per column: every value where at most ``all_up_to`` are distinct, else the ``top`` most
    frequent and the ``bottom`` least frequent.

    Rows: column, distinct, nulls, total, part (``all`` / ``top`` / ``bottom``), rank, value, count. A column of
    nulls gives one row without a value. Values longer than ``width`` are cut and marked with ``...``. Ranks
    are cut per task before the shuffle, so a column with very many values does not meet in one task.
    """
    counts = value_counts(df, columns)
    present = F.col("value").isNotNull()
    stats = counts.groupBy("column").agg(
        F.count_if(present).alias("distinct"), F.sum(F.when(~present, F.col("count")).otherwise(0)).alias("nulls"),
        F.sum("count").alias("total"))
    values = counts.filter(present)

    def ranked(order: list[Column], n: int) -> DataFrame:
        w = Window.partitionBy("column").orderBy(*order)
        return values.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

    first = ranked([F.col("count").desc(), F.col("value").asc()], max(all_up_to, top))
    last = ranked([F.col("count").asc(), F.col("value").desc()], bottom)
    few = F.col("distinct") <= all_up_to
    head = stats.join(first, "column", "left").filter(few | (F.col("rank") <= top)).withColumn(
        "part", F.when(few, F.lit("all")).otherwise(F.lit("top")))
    tail = stats.filter(~few & (F.col("distinct") > top + 2)).join(last, "column").withColumn("part", F.lit("bottom"))
    shown = F.when(F.length("value") > width, F.concat(F.substring("value", 1, width), F.lit("..."))).otherwise(F.col("value"))
    return head.unionByName(tail).select("column", "distinct", "nulls", "total", "part", "rank", shown.alias("value"), "count")


def profile_order() -> list[Column]:
    return [F.col("distinct"), F.col("column"), F.col("part"), F.col("rank")]


def snapshot(df: DataFrame, order: Sequence[str], rows: int = 10, columns: int = 10, width: int = 70) -> DataFrame:
    """First and last rows in a given order, first and last columns, long cells cut.

    ``position`` counts from 1 at the start and from -1 at the end; ``...`` stands for left-out columns. Both
    ends are top-k plans. A table that fits is returned whole.
    """
    names = df.columns
    half = columns // 2

    def cell(n: str) -> Column:
        text = F.coalesce(col(n).cast("string"), F.lit(""))
        return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text).alias(n)

    shown = [cell(n) for n in names] if len(names) <= columns else [
        *[cell(n) for n in names[:half]], F.lit("...").alias("..."), *[cell(n) for n in names[-half:]]]
    base = df.select(F.struct(*[col(o) for o in order]).alias("__order"), *shown)
    out = [c for c in base.columns if c != "__order"]

    def end(direction: Column) -> DataFrame:
        # one row more than shown tells whether the table fits; the windows run over these rows only
        kept = base.orderBy(direction).limit(rows + 1)
        return kept.withColumn("position", F.row_number().over(Window.orderBy(direction))).withColumn(
            "__n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))

    near = F.col("position") <= rows // 2
    first = end(F.col("__order").asc()).filter((F.col("__n") <= rows) | near)
    last = end(F.col("__order").desc()).filter((F.col("__n") > rows) & near).withColumn("position", -F.col("position"))
    picked = [col(c) for c in ["position", *out]]
    return first.select(*picked).unionByName(last.select(*picked))
