"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Two fingerprints that differ in at most ``MAX_BITS`` = 4 bits differ in at most 4 bytes, so they
share at least 4 positional bytes. Postings of single positional bytes would each hold 1/256 of the corpus; so an
index entry is a set of three positions with their bytes. The sets are chosen so that any four positions contain
one of them (20 sets; positions in three rings, a set lies in one ring or has two positions in a ring and one
in the next), so every pair with 4 shared positional bytes meets. For each pair that meets, the shared positional
bytes are tallied; pairs with 4 or more are verified by their bit distance. A pair is looked at only in the first set in
which it meets.

Rows with equal fingerprints (copies, empty texts) are one entry before the index is made. Postings of one entry are
dropped. Short postings are joined with themselves. Long ones (many near copies of one text) are cut into
blocks of ``BLOCK`` fingerprints; each pair of blocks is compared in one numpy task, which returns only the links of a
spanning forest, so no group emits all its pairs, and no task holds more than two blocks. Every pair is still compared.

Components are found on Spark (see ``components``). Nothing but counts reaches the driver.

Edge cases: a null text counts as empty; texts without a word have fingerprint zero and are linked like others; fewer
words than a shingle give one shingle of all words. A null id is reported with its component but names it only if
the component has no other. Repeated rows are one group. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import slices
from plumbline.llm.components import components
from plumbline.llm.keeping import keep_rows
from plumbline.session import cut, ship_package

if TYPE_CHECKING:  # workers that make fingerprints need not load it
    import pandas as pd

WORDS = 4
MAX_BITS = 4
SHARED_BYTES = 8 - MAX_BITS
SHORT = 32  # postings up to this length are joined in place
BLOCK = 2048
SEED = 42


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts]).tolist()
    starts = [0] + ends[:-1]
    last = max(0, len(parts) - words)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for a in range(0, last + 1, 1 << 14):
        own = range(a, min(a + (1 << 14), last + 1))
        some = np.array([digest(joined[starts[i]:ends[min(i + words, len(parts)) - 1] - 1], SEED) for i in own], dtype="<u8")
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > last + 1).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``id, tag, fp`` (fp as a signed long, tag a hash of the text) of every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            prints = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.int64())], ["id", "tag", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), _tag(text_col).alias("tag"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, tag long, fp long")


def _tag(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def position_sets() -> list[tuple[int, ...]]:
    """Sets of three byte positions such that any four positions contain one of them."""
    rings = [(0, 1, 2), (3, 4, 5), (6, 7)]
    own = [c for r in rings for c in combinations(r, 3)]
    return own + [(*two, one) for i, r in enumerate(rings) for two in combinations(r, 2) for one in rings[(i + 1) % 3]]


def _mask(positions: tuple[int, ...]) -> int:
    """The bytes at these positions, as a signed long."""
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


MASKS = [_mask(s) for s in position_sets()]


def _shared_bytes(x: Column) -> Column:
    """How many positional bytes are equal, from the exclusive or of two fingerprints."""
    return sum(((x.bitwiseAND(F.lit(_mask((p,)))) == 0).cast("int") for p in range(8)), F.lit(0))


def _first_set(x: Column) -> Column:
    """The first set in which the pair meets."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(MASKS))):
        out = F.when(x.bitwiseAND(F.lit(MASKS[i])) == 0, F.lit(i)).otherwise(out)
    return out


def _forest(left: np.ndarray, right: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links of a spanning forest among fingerprints of two blocks that are close enough."""
    nodes = left if same else np.concatenate([left, right])
    label, links = np.arange(len(nodes)), []
    offset = 0 if same else len(left)
    values = nodes.view(np.uint64)
    for i in range(len(left)):
        x = values[offset:] ^ values[i]
        near = np.bitwise_count(x) <= MAX_BITS
        if same:
            near[:i + 1] = False
        others = np.flatnonzero(near) + offset
        others = others[label[others] != label[i]]
        if len(others):
            # one link for each class that is not yet joined to this one
            classes, at = np.unique(label[others], return_index=True)
            links += [(int(nodes[i]), int(nodes[j])) for j in others[at]]
            label[np.isin(label, classes)] = label[i]
    return links


def _compare_blocks(group: pd.DataFrame) -> pd.DataFrame:
    import pandas as pd

    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    left = np.sort(group.loc[group["block"] == i, "fp"].to_numpy(dtype=np.int64))
    right = left if i == j else np.sort(group.loc[group["block"] == j, "fp"].to_numpy(dtype=np.int64))
    return pd.DataFrame(_forest(left, right, i == j), columns=["a", "b"], dtype="int64")


def links(prints: DataFrame, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``prints(fp)`` that connect all that differ in few bits."""
    entries = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in MASKS])).alias("s", "bytes"))
    postings = entries.groupBy("s", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(entries.join(postings, ["s", "bytes"]))
    few = shared.where(F.col("n") <= short)
    a, b = few.select("s", "bytes", F.col("fp").alias("a")), few.select("s", "bytes", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    close = (a.join(b, ["s", "bytes"])
             .where((F.col("a") < F.col("b")) & (_shared_bytes(x) >= SHARED_BYTES) & (F.bit_count(x) <= MAX_BITS) & (_first_set(x) == F.col("s")))
             .select("a", "b"))

    many = shared.where(F.col("n") > short).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    many = many.select("s", "bytes", "fp", "block", other).select(
        "s", "bytes", "fp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    forest = many.groupBy("s", "bytes", "i", "j").applyInPandas(_compare_blocks, "a long, b long")
    return close.union(forest)


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id, tag, fp, keeper`` of every row; tag is a hash of the text, keeper the first (id, tag) of the component."""
    rows = cut(fingerprints(docs, id_col, text_col, words))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tag"))
    distinct = cut(rows.groupBy("fp").agg(first.alias("first")))
    roots = components(links(distinct.select("fp")))
    classed = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    named = classed.groupBy("root").agg(F.min("first").alias("keeper"))
    return rows.join(cut(classed.join(named, "root").select("fp", "keeper")), "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``id_col, fingerprint`` (16 hex digits) ``, component_id`` (smallest id reachable) of every row."""
    return _grouped(docs, id_col, text_col, words).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("keeper.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each component, all columns: that with the smallest id (null ids last), of equal ids one."""
    own = F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("tag") == F.col("keeper.tag"))
    verdict = _grouped(docs, id_col, text_col, words).groupBy("id", "tag").agg(F.bool_or(own).alias("keep"), F.count("*").alias("times"))
    return keep_rows(docs, cut(verdict), id_col, _tag(text_col))
