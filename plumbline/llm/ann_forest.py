"""Approximate nearest neighbours by inner product: a forest of sorted hash strings.

Each tree of the forest gives a vector a long string of bits (signs of random projections) and keeps the strings sorted. A
query descends every tree to the longest prefix that its own string shares with one there, then all trees ascend
together, one bit at a time, until the rows under the shared prefixes are enough candidates. Candidates are scored by the exact
inner product in double precision.

Largest inner product is turned into smallest angle first: each vector gets one more component that brings all to the length of
the longest of its shard; a query gets a zero there. Vectors are scaled by their largest component before that, so that squares of very small or very
large numbers neither vanish nor overflow.

Rows are dealt into shards of about ``SHARD`` rows by a hash of their id, so near or equal vectors spread evenly, and queries into
blocks of ``QUERY_BLOCK``. One task holds one shard and one block, builds the shard's trees and answers the block; every block of the stated
query set meets every shard, and the best of all shards are merged for each query. Every row is indexed.

``SHARE`` is the part of a shard that an ascent must gather. Vectors without structure need a large part for a recall
of 0.9; the driver tables are nearly such (see README for measured recall).

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do null ids. Vectors meet
only vectors of their own number of components. Rows repeated with one id count as one candidate, with the best score. Fewer
candidates than wanted are all returned. Ties go to the smaller id. A product that overflows is infinite, one whose sum is undefined
(infinities of both signs) comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut, ship_package

if TYPE_CHECKING:  # workers of other operators need not load it
    import pandas as pd

TREES = 32
BITS = 16
SHARE = 0.5
SHARD = 8192
QUERY_BLOCK = 1024
MOST_PARTITIONS = 100_000
SLACK = 1e-9  # rounding of the fast product; what lies within is ranked by the exact one


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` (array of doubles), ``dim`` of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    out = rows.select(F.col(id_col).alias("id"), v.alias("v")).where("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.where(~bad & F.exists("v", lambda x: x != 0)).select("id", "v", F.size("v").alias("dim"))


class Forest:
    """The trees over one shard."""

    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int) -> None:
        n, dim = vectors.shape
        self.n, self.trees, self.bits = n, trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((dim + 1, trees * bits))
        vectors = vectors / np.abs(vectors).max()
        norms2 = np.einsum("ij,ij->i", vectors, vectors)
        rest = np.sqrt(np.maximum(0.0, norms2.max() - norms2))
        strings = self._strings(np.column_stack([vectors, rest]))
        self.order = np.argsort(strings, axis=0, kind="stable").T
        self.sorted = np.sort(strings, axis=0).T.copy()

    def _strings(self, extended: np.ndarray) -> np.ndarray:
        bits = (extended @ self.planes > 0).reshape(len(extended), self.trees, self.bits)
        return bits @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def ascend(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query, the places of its candidates: the deepest level at which all trees together give enough."""
        queries = queries / np.abs(queries).max(axis=1, keepdims=True)
        strings = self._strings(np.column_stack([queries, np.zeros(len(queries))]))
        at = np.full(len(queries), -1)
        low, high = np.zeros((self.trees, len(queries)), dtype=np.int64), np.full((self.trees, len(queries)), self.n)
        for level in range(self.bits, -1, -1):
            todo = np.flatnonzero(at < 0)
            if not len(todo):
                break
            shift = self.bits - level
            first = strings[todo] >> shift << shift
            for t in range(self.trees):
                low[t, todo] = np.searchsorted(self.sorted[t], first[:, t], "left")
                high[t, todo] = np.searchsorted(self.sorted[t], first[:, t] + (1 << shift), "left")
            # rows found in several trees count once; the mean overlap of random trees is taken off before looking
            share = (high[:, todo] - low[:, todo]) / self.n
            distinct = self.n * (1 - np.prod(1 - share, axis=0))
            at[todo[(distinct >= enough) | (level == 0)]] = level
        for q in range(len(queries)):
            found = np.zeros(self.n, dtype=bool)
            for t in range(self.trees):
                found[self.order[t, low[t, q]:high[t, q]]] = True
            yield np.flatnonzero(found)


def _answer(group: pd.DataFrame, k: int, share: float, trees: int, bits: int, seed: int) -> pd.DataFrame:
    import pandas as pd

    rows, asked = group[~group["is_query"]], group[group["is_query"]]
    empty = pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
    if rows.empty or asked.empty:
        return empty
    rows = rows.sort_values("id")
    ids, vectors = rows["id"].to_numpy(dtype=np.int64), np.stack(rows["v"].to_numpy()).astype(np.float64)
    queries = np.stack(asked["v"].to_numpy()).astype(np.float64)
    forest = Forest(vectors, trees, bits, seed)
    out = []
    # rows repeated with one id are one candidate, so they do not help to fill up
    repeats = len(ids) - len(np.unique(ids))
    enough = max(4 * (k + 1) + repeats, int(np.ceil(share * len(ids))))
    for q, (own, places) in enumerate(zip(asked["id"].to_numpy(dtype=np.int64), forest.ascend(queries, enough), strict=True)):
        places = places[ids[places] != own]
        if not len(places):
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            fast = vectors[places] @ queries[q]
            first = np.flatnonzero(np.concatenate(([True], np.diff(ids[places]) != 0)))  # rows stand in order of id
            if len(first) > k:
                by_id = np.maximum.reduceat(fast, first)
                edge = np.partition(by_id, len(by_id) - k)[len(by_id) - k]
                if np.isfinite(by_id).all():  # else all are ranked exactly
                    places = places[fast >= edge - SLACK * (1 + abs(edge))]
            exact = (vectors[places] * queries[q]).sum(axis=1)
        undefined = np.isnan(exact)
        best = np.lexsort((ids[places], -np.where(undefined, -np.inf, exact), undefined))
        out.append(pd.DataFrame({"query_id": own, "id": ids[places][best], "score": exact[best]}).drop_duplicates("id").head(k))
    return pd.concat(out, ignore_index=True) if out else empty


def nearest(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, share: float = SHARE,
            trees: int = TREES, bits: int = BITS, shard: int = SHARD, query_block: int = QUERY_BLOCK, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of ``rows`` for each of ``queries``, its own id left out."""
    ship_package(rows.sparkSession)
    stored, asked = cut(usable(rows, id_col, vector_col)), cut(usable(queries, id_col, vector_col).dropDuplicates(["id"]))
    sizes = stored.groupBy("dim").agg(F.count("*").alias("n"))
    asked_sizes = asked.groupBy("dim").agg(F.count("*").alias("m"))
    plan = cut(sizes.join(asked_sizes, "dim").select(
        "dim", F.ceil(F.col("n") / shard).cast("int").alias("shards"), F.ceil(F.col("m") / query_block).cast("int").alias("blocks")))

    def part(column: str, of: str, salt: int):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(of)).cast("int").alias(column)

    def every(column: str, of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias(column)

    shape = ["dim", "shard", "block", "id", "v", "is_query"]
    a = stored.join(plan, "dim").select("*", part("shard", "shards", 1), every("block", "blocks"), F.lit(False).alias("is_query")).select(*shape)
    b = asked.join(plan, "dim").select("*", part("block", "blocks", 2), every("shard", "shards"), F.lit(True).alias("is_query")).select(*shape)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        return _answer(group, k, share, trees, bits, seed)

    # small rows, dear groups: as many partitions as groups, which adaptive execution leaves as they are
    groups = plan.agg(F.sum(F.col("shards").cast("long") * F.col("blocks"))).first()[0] or 1
    dealt = a.union(b).repartition(min(groups, MOST_PARTITIONS), "dim", "shard", "block")
    found = dealt.groupBy("dim", "shard", "block").applyInPandas(answer, "query_id long, id long, score double")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))  # an undefined score has become a null on its way
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), F.coalesce("score", F.lit(float("nan"))).alias("score"))
