"""Left joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.names import col

# A key with more rows than this is hot. Only the MOST_HOT largest of them are set apart and broadcast, however many rows
# there are; the others stay in the plain join.
HOT_ROWS = 1_000_000
MOST_HOT = 10_000
SALTS = 64


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The largest keys that hold more than HOT_ROWS rows (counted with partial aggregation), MOST_HOT at most.

    Keys with a null are left out: they match nothing, so :func:`left_join_hot` spreads them whatever their number.
    """
    counted = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    for k in keys:
        counted = counted.filter(col(k).isNotNull())
    return counted.filter(F.col("__n") > HOT_ROWS).orderBy(F.desc("__n"), *[col(k) for k in keys]).limit(MOST_HOT).drop("__n")


def left_join_hot(df: DataFrame, side: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """``df`` left join ``side`` (one row per key), given the hot keys of ``df``.

    The few hot keys are broadcast together with their row of ``side``. Their rows then carry a salt made
    from the hash of the whole row, the same on every retry, so in the join of the other keys they are
    spread over the tasks and match nothing there. Rows with a null in the key are salted in the same way.
    """
    keys = list(keys)
    values = [c for c in side.columns if c not in keys]
    hashed = [col(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType) and not f.name.startswith("__")]
    hot_side = hot.join(side, keys, "left").select(*[col(k) for k in keys], F.struct(*[col(v) for v in values]).alias("__hot"))
    cold = side.join(F.broadcast(hot), keys, "left_anti").withColumn("__salt", F.lit(0))
    void = reduce(lambda a, b: a | b, [col(k).isNull() for k in keys])
    salt = F.lit(1) + F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")
    salted = df.join(F.broadcast(hot_side), keys, "left").withColumn("__salt", F.when(F.col("__hot").isNotNull() | void, salt).otherwise(0))
    joined = salted.join(cold, [*keys, "__salt"], "left")
    return joined.withColumns({v: F.coalesce(F.col("__hot")[v], col(v)) for v in values}).drop("__salt", "__hot")
