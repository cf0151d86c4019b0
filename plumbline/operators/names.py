"""A stored index over names for containment search with a bound on what is looked at.

The index has the entries in order with a number that keeps that order, the different names with the runs of numbers that their entries have, the
postings (letter runs of one to three characters with the names that hold them) and the length of every posting list. A query takes its rarest runs,
intersects their lists, and compares only the names that are left. A name that many entries share is on a list once, and of its entries only the
numbers of the first ``k`` are moved, so the cost of a search does not grow with the entries of a name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import checkpoint_dir, cut

RUN = 3  # letters of a run; shorter queries are runs of their own
LISTS = 3  # posting lists that are intersected, the shortest


@dataclass(frozen=True)
class NameIndex:
    """``names(nid, key, entry)`` in order of (key, position), ``keys(kid, key, runs)`` with the (first, last) number of a name's entries in each part and
    the first of all as ``kid``, ``lists(gram, names)``, ``postings(gram, kid)``."""

    names: DataFrame
    keys: DataFrame
    lists: DataFrame
    postings: DataFrame


def grams(c: Column, length: int) -> Column:
    """The different runs of ``length`` letters."""
    return F.when(F.length(c) >= length, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - length + 1), lambda i: F.substr(c, i, F.lit(length)))))


def load_index(spark: SparkSession, path: str) -> NameIndex:
    return NameIndex(*[spark.read.parquet(f"{path}/{t}") for t in ("names", "keys", "lists", "postings")])


def build_index(entries: DataFrame, key: Column, position: Column, path: str | None = None) -> NameIndex:
    """Store the index of ``entries`` by ``key`` (rows with a blank key are left out) below ``path``, by default in the checkpoint folder.

    Names are sorted by ranges, so numbers keep their order without a global sort in one task; postings are sorted by run, so a search
    reads the row groups of its runs only.
    """
    spark = entries.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/names-{uuid.uuid4().hex}"
    rows = entries.select(key.alias("key"), position.alias("at"), F.struct(*entries.columns).alias("entry")).where("key <> ''")
    ordered = rows.repartitionByRange("key", "at").sortWithinPartitions("key", "at")
    ordered.select(F.monotonically_increasing_id().alias("nid"), "key", "entry").write.mode("overwrite").parquet(f"{path}/names")
    # within a part the numbers of a name's entries follow each other, so a name takes as much room as it has parts
    part = F.shiftright("nid", 33)
    runs = spark.read.parquet(f"{path}/names").groupBy("key", part).agg(F.struct(F.min("nid").alias("first"), F.max("nid").alias("last")).alias("run"))
    keys = runs.groupBy("key").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    keys.select(F.col("runs")[0]["first"].alias("kid"), "key", "runs").write.mode("overwrite").parquet(f"{path}/keys")
    keys = spark.read.parquet(f"{path}/keys")
    letters = F.concat(*[F.coalesce(grams(F.col("key"), n), F.array().cast("array<string>")) for n in range(1, RUN + 1)])
    pairs = keys.select("kid", F.explode(letters).alias("gram"))
    pairs.select("gram", "kid").repartitionByRange("gram", "kid").sortWithinPartitions("gram", "kid").write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("names")).write.mode("overwrite").parquet(f"{path}/lists")
    return load_index(spark, path)


def first_names(rows: DataFrame, limit: int, order: str = "nid") -> DataFrame:
    """The first ``limit`` rows of each query by name, with ``rank``. The bound is a literal, so Spark applies it before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(order))
    return rows.withColumn("rank", place).where(F.col("rank") <= limit)


def search_index(queries: DataFrame, index: NameIndex, limit: int, contains: Callable[[Column, Column], Column] = lambda k, q: k.contains(q)) -> DataFrame:
    """``query, rank, exact, entry``: for each distinct ``queries(query)`` the entries whose name equals it, else the first ``limit`` that contain it."""
    asked = cut(queries.where("query <> ''").distinct())
    equal = cut(asked.join(index.keys, F.col("query") == F.col("key")).select("query", "kid", "runs", F.lit(True).alias("exact")))
    rest = asked.join(equal.select("query"), "query", "left_anti")

    own = F.when(F.length("query") <= RUN, F.array("query")).otherwise(grams(F.col("query"), RUN))
    runs = rest.select("query", F.explode(own).alias("gram")).join(index.lists, "gram", "left")
    rarest = runs.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram"))).alias("runs"))
    rarest = rarest.where("runs[0].names > 0").select("query", F.slice("runs", 1, LISTS).alias("runs"))
    chosen = rarest.select("query", F.size("runs").alias("wanted"), F.explode("runs.gram").alias("gram"))
    met = chosen.join(index.postings, "gram")
    # one list: it holds the answer of a short query, in order
    alone = first_names(met.where(F.length("query") <= RUN).select("query", "kid"), limit, "kid").select("query", "kid")
    several = met.where(F.length("query") > RUN).groupBy("query", "kid", "wanted").agg(F.count("*").alias("n")).where("n = wanted").select("query", "kid")
    held = alone.unionByName(several).join(index.keys, "kid").where(contains(F.col("key"), F.col("query")))
    found = first_names(held.select("query", "kid", "runs", F.lit(False).alias("exact")), limit, "kid").drop("rank")  # a name has an entry at least

    each = equal.unionByName(found).select("query", "exact", F.explode("runs").alias("run"))
    numbers = F.sequence("run.first", F.least("run.last", F.col("run.first") + F.lit(limit - 1)))
    path = f"{checkpoint_dir(asked.sparkSession).rstrip('/')}/found-{uuid.uuid4().hex}"
    each.select("query", "exact", F.explode(numbers).alias("nid")).write.parquet(path)  # read back with its size known, so entries are not moved for a few
    return first_names(asked.sparkSession.read.parquet(path), limit).join(index.names, "nid").select("query", "rank", "exact", "entry")
