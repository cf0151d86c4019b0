"""Ranked lexical search, term at a time with a limited number of accumulators.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z is lower-cased.

1. **Query terms**: the distinct terms of every item, in blocks of about ``BLOCK_TERMS`` terms (items are dealt to blocks by a hash of their
   id). The terms of one block are what a task holds of the queries; each block reads the texts once.
2. **Postings**: one pass over the texts keeps, for every document, its length and the frequencies of query terms, stored as Parquet.
   Document counts, total length and document frequencies are aggregates of that table.
3. **Ranking**: every Arrow batch of documents is a shard. Its inverted index is made in numpy; for each item the terms are taken
   rarest first and every posting creates or raises an accumulator. Once the largest contributions of the remaining terms together stay
   below the k-th partial score (of the shard, or the k-th final score that the task has from earlier shards), no accumulator is created
   any more: a document without one cannot reach the first ``k``. The survivors are still raised by all remaining terms, so their scores are
   exact. A task returns at most ``k`` documents an item, which Spark ranks together.

Nothing is shuffled by term or by document: a term or passage that a third of all documents hold lies where its documents lie.

Edge cases: a null or empty text has no term, is not counted and is never found. Rows repeated with one doc id are documents of their
own. Item rows with equal ids are one item that asks for the terms of all of them; a null item id is an item. A null doc id comes last
among equal scores. Items without a term, or whose terms nothing holds, have no row. Empty tables give an empty result. Very long texts are
held one at a time as words. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.batches import slices
from plumbline.llm.stored import new_folder, stored
from plumbline.session import ship_package

TOP = 10
BLOCK_TERMS = 1 << 18  # distinct terms of the items in a block, about
SHARD_ROWS = 4096  # documents of an inverted index at most
# Constants of the score, fixed by its definition
SCALE, SATURATION, LENGTH_SHARE = 1000, 8, 90

# ASCII that is neither a digit nor a letter separates terms; A-Z becomes a-z
_TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in order."""
    return (text or "").encode("utf-8", "replace").translate(_TO_TERMS).split()


def weight(n_docs: int, doc_freq: int) -> int:
    """The weight of a term that ``doc_freq`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * doc_freq + 1)))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, term`` (term as binary), each pair once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [sorted(set(terms_of(t))) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([t for x in own for t in x], pa.binary())], ["item", "term"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"item {dict(rows.dtypes)['item']}, term binary").distinct()


def postings(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``id, n, terms, tfs``: length of every document with a term and the frequencies of those in ``terms`` (by place in that list)."""
    places = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lengths, keys, counts = [], [], []
            for text in b.column(1).to_pylist():
                found = terms_of(text)
                own = np.array([p for p in map(places.get, found) if p is not None], dtype=np.int32)
                key, count = np.unique(own, return_counts=True)
                lengths.append(len(found))
                keys.append(key)
                counts.append(count.astype(np.int64))
            sizes = pa.array(np.cumsum([0] + [len(k) for k in keys]), pa.int32())
            flat = [np.concatenate([np.empty(0, t), *x]).astype(t) for x, t in ((keys, np.int32), (counts, np.int64))]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), *[pa.ListArray.from_arrays(sizes, pa.array(x)) for x in flat]],
                                             ["id", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column(1), 0))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n long, terms array<int>, tfs array<long>")


class Shard:
    """The inverted index over some documents."""

    def __init__(self, lengths: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, total: int) -> None:
        self.size = len(lengths)
        norm = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * n_docs) // total
        doc = np.repeat(np.arange(self.size), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        self.docs, terms, tfs = doc[order], terms[order], tfs[order]
        self.gains = weights[terms] * ((1_000_000_000 * tfs) // (SCALE * tfs + SATURATION * norm[self.docs]))
        held = np.arange(len(weights) + 1)
        self.starts = np.searchsorted(terms, held)
        self.bounds = np.zeros(len(weights), dtype=np.int64)
        some = np.flatnonzero(np.diff(self.starts))
        if len(some):
            self.bounds[some] = np.maximum.reduceat(self.gains, self.starts[some])

    def search(self, terms: np.ndarray, k: int, floor: int) -> np.ndarray:
        """Scores of all documents for an item whose ``terms`` stand rarest first; those that cannot reach the first k may be zero.

        ``floor`` is a score that the k-th place is known to have at least.
        """
        left = np.concatenate([np.cumsum(self.bounds[terms][::-1])[::-1], [0]])
        scores, survives = np.zeros(self.size, dtype=np.int64), None
        for i, t in enumerate(terms):
            own = slice(self.starts[t], self.starts[t + 1])
            docs, gains = self.docs[own], self.gains[own]
            if survives is not None:
                stays = survives[docs]
                docs, gains = docs[stays], gains[stays]
            elif left[i] < floor:
                survives = scores > 0
                stays = survives[docs]
                docs, gains = docs[stays], gains[stays]
            scores[docs] += gains
            if survives is None and left[i + 1] <= left[0] - left[i + 1] and self.size >= k:
                if left[i + 1] < np.partition(scores, self.size - k)[self.size - k]:
                    survives = scores > 0
        return scores


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above zero, equal ones by ``order``."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        own = scores[found]
        found = found[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return found[np.lexsort((order[found], -scores[found]))][:k]


def _key(hit: tuple) -> tuple:
    score, id_ = hit
    return (-score, id_ is None, id_ if id_ is not None else 0)


def rank(postings_: DataFrame, asked: list[tuple], weights: list[int], n_docs: int, total: int, item_type: str, k: int = TOP) -> DataFrame:
    """``item, id, score``: at most ``k`` documents of each task for each of ``asked`` (item, places of its terms, rarest first)."""
    id_type = dict(postings_.dtypes)["id"]
    items = [(item, np.array(terms, dtype=np.int64)) for item, terms in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = np.array(weights, dtype=np.int64), [[] for _ in items]
        schema = None
        for b in slices(batches, SHARD_ROWS):
            schema = schema or b.schema
            if not b.num_rows:
                continue
            ids, lists, tfs = b.column(0), b.column(2), b.column(3)
            shard = Shard(b.column(1).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]),
                          lists.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False), own, n_docs, total)
            order = np.empty(b.num_rows, dtype=np.int64)
            order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(b.num_rows)
            for i, (_, terms) in enumerate(items):
                scores = shard.search(terms, k, best[i][-1][0] if len(best[i]) == k else 0)
                hits = [(int(scores[p]), ids[int(p)].as_py()) for p in _best(scores, order, k)]
                if hits:
                    best[i] = sorted(best[i] + hits, key=_key)[:k]
        if schema is not None:
            rows = [(item, id_, score) for (item, _), hits in zip(items, best, strict=True) for score, id_ in hits]
            types = [_ITEM_TYPES[item_type], schema.field(0).type, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["item", "id", "score"])

    return postings_.mapInArrow(run, f"item {item_type}, id {id_type}, score long")


_ITEM_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_col, rank, id_col, score``: the ``k`` highest-scoring documents of every item. Item ids are integers or strings."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = new_folder(spark, "ranked-search")
    wanted = stored(item_terms(items, item_col, item_text_col), f"{folder}/items")
    item_type = dict(wanted.dtypes)["item"]
    if item_type not in _ITEM_TYPES:
        raise ValueError(f"item ids of type {item_type} are not supported; cast them to string")
    blocks = max(1, math.ceil(wanted.count() / block_terms))
    parts = []
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        asked: dict = {}
        for item, term in rows:
            asked.setdefault(item, []).append(bytes(term))
        terms = sorted({bytes(t) for _, t in rows})
        found = stored(postings(docs, terms, id_col, text_col), f"{folder}/postings-{block}")
        n_docs, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        freq = [0] * len(terms)
        for place, count in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            freq[place] = count
        weights = [weight(n_docs, f) for f in freq]
        place_of = {t: i for i, t in enumerate(terms)}
        order = [(item, sorted((place_of[t] for t in own if freq[place_of[t]]), key=lambda p: (freq[p], p))) for item, own in asked.items()]
        parts.append(stored(rank(found, order, weights, n_docs, total, item_type, k), f"{folder}/found-{block}"))
    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.unionByName(part)
    return _ranked(all_, k).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place: Column = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)
