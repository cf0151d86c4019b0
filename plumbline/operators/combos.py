"""Distinct combinations with counts: the aggregation every test runs on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.names import col
from plumbline.rules.registry import Source, columns_source

# grouping_id is a 64-bit mask over the grouping columns.
MAX_GROUPING_COLUMNS = 60


def _projected(df: DataFrame, cols: Sequence[str], carry: Sequence[str], source: Source | None) -> DataFrame:
    read = source or columns_source(df)
    return df.select(*[col(c) for c in carry], *[read(c).alias(c) for c in cols])


def unique_combos(df: DataFrame, cols: Sequence[str], carry: Sequence[str] = (),
                  source: Source | None = None) -> DataFrame:
    """One row per distinct combination of ``cols`` with ``count``; blanks are kept as ``''``.

    Only the named columns are read. Counting is partial before the shuffle, so a value that holds most
    of the rows arrives as one row per task. ``carry`` names leading group columns that stay as they are
    (a run id), ``source`` reads the values from elsewhere than columns (a map).
    """
    keys = [*carry, *cols]
    return _projected(df, cols, carry, source).groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))


def distinct_key_sets(key_sets: Sequence[Sequence[str]]) -> list[tuple[str, ...]]:
    """Key sets without repetition; sets with the same columns in another order are one."""
    seen: dict[frozenset[str], tuple[str, ...]] = {}
    for s in key_sets:
        seen.setdefault(frozenset(s), tuple(dict.fromkeys(s)))
    return list(seen.values())


def unique_combos_all(df: DataFrame, key_sets: Sequence[Sequence[str]], carry: Sequence[str] = (),
                      single_pass: bool = True, source: Source | None = None) -> DataFrame:
    """:func:`unique_combos` for many key sets, tagged with ``set_id`` (the position of the key set).

    ``single_pass`` reads the input once through grouping sets; choose it when the input is expensive (a
    join, text files). Otherwise every key set is a separate aggregation that reads only its own columns,
    which is cheaper on columnar files because no row is multiplied. Columns outside a set are null.
    """
    sets = distinct_key_sets(key_sets)
    names = list(dict.fromkeys(c for s in sets for c in s))
    if not single_pass:
        parts = [unique_combos(df, s, carry, source).withColumn("set_id", F.lit(i)) for i, s in enumerate(sets)]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return out.select("set_id", *[col(k) for k in [*carry, *names]], "count")

    parts = []
    for batch in _column_batches(list(enumerate(sets)), MAX_GROUPING_COLUMNS - len(carry)):
        used = list(dict.fromkeys(c for _, s in batch for c in s))
        every = [*carry, *used]
        base = _projected(df, used, carry, source)
        grouped = base.groupingSets(
            [[col(k) for k in [*carry, *s]] for _, s in batch], *[col(k) for k in every]
        ).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("gid"))
        parts.append(grouped.select(_set_id(batch, every, carry).alias("set_id"), *[col(k) for k in every], "count"))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select("set_id", *[col(k) for k in [*carry, *names]], "count")


def _column_batches(sets: list[tuple[int, tuple[str, ...]]], width: int):
    batch, used = [], set()
    for item in sets:
        if batch and len(used | set(item[1])) > width:
            yield batch
            batch, used = [], set()
        batch.append(item)
        used |= set(item[1])
    if batch:
        yield batch


def _set_id(batch, every: Sequence[str], carry: Sequence[str]) -> Column:
    """Map the grouping id (a bit per column, 1 where the column is not in the set) back to the set."""
    out = F.lit(None).cast("int")
    for i, s in batch:
        inside = {*carry, *s}
        mask = sum(1 << (len(every) - 1 - p) for p, name in enumerate(every) if name not in inside)
        out = F.when(F.col("gid") == F.lit(mask), F.lit(i)).otherwise(out)
    return out


def rollup_row_results(df: DataFrame, record_id: str) -> DataFrame:
    """Row-level results to unique results: group by every column but the record id."""
    rest = [c for c in df.columns if c not in (record_id, "count")]
    return df.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in rest]).groupBy(
        *[col(c) for c in rest]).agg(F.count(F.lit(1)).alias("count"))
