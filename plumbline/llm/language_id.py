"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything but letters becomes a separator, runs of separators become one, and the n-grams of
one to three characters are hashed into ``BUCKETS``. Training counts them for each language on a bounded sample of
labelled rows (about ``ROWS_PER_LANG`` whole texts of each language, drawn by a hash of the id); the counts are summed on
Spark. The matrix of log-probabilities (BUCKETS x languages) is broadcast in blocks of ``BLOCK_LANGS`` columns, and numpy scores whole
texts: one gather of matrix rows and one sum per text. With more languages than a block holds, the texts are scored block by block and the best
language and the sum of all scores are carried along, so any number of languages is learned and a task holds one block.

Edge cases: a null text, a text without a letter, and every text when no labelled row exists, is ``und`` with score 0.
Ties go to the language that sorts first. A null id is predicted but never learned from. Score is the posterior
probability of the predicted language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import slices
from plumbline.llm.stored import new_folder, stored
from plumbline.session import cut, ship_package

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ROWS_PER_LANG = 2000
BLOCK_LANGS = 128  # languages of which a task holds the columns at once
COUNTED_LANGS = 64  # languages counted side by side in a task
MANY_LANGS = 100_000  # languages up to this number are broadcast with their sizes
SMOOTHING = 0.5
GRAMS = 1 << 21  # n-grams times languages scored at once
UNKNOWN = "und"


@dataclass
class Block:
    """The columns of some languages, which is what a task holds of the model at once."""

    langs: list[str]
    log_prob: np.ndarray  # BUCKETS x languages, float32
    log_prior: np.ndarray


@dataclass
class Model:
    """Broadcast blocks of languages; none if nothing was learned."""

    langs: list[str]
    blocks: list[Broadcast]


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def buckets(text: str) -> np.ndarray:
    """The hashed n-grams of a text, with repeats; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, dtype=np.uint32)
    chars = np.where(letter, points, np.uint32(32))
    keep = np.ones(len(chars), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]
    chars = np.concatenate(([32], chars[keep], [32])).astype(np.uint32)
    out = []
    for n in ORDERS:
        code = np.zeros(len(chars) - n + 1, dtype=np.uint32)
        for i in range(n):
            code = (code ^ chars[i:len(chars) - n + 1 + i]) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
        out.append((code * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(16))
    return np.concatenate(out) % BUCKETS


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows_per_lang: int = ROWS_PER_LANG, block_langs: int = BLOCK_LANGS) -> Model:
    """Counts of a bounded sample of every language, summed on Spark; the driver holds the counts of ``block_langs`` languages at once."""
    ship_package(labelled.sparkSession)
    session = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], [])
    known = session.createDataFrame(list(sizes.items()), "lang string, n long")
    drawn = F.pmod(F.xxhash64(F.col("id"), F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(known) if len(sizes) <= MANY_LANGS else known, "lang").where(drawn < F.lit(float(rows_per_lang)) / F.col("n")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in totals.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())],
                                                 ["lang", "bucket", "n"])
            totals.clear()

        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in totals and len(totals) >= COUNTED_LANGS:
                    yield from flush()
                totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                totals[lang] += np.bincount(buckets(text), minlength=BUCKETS)
        yield from flush()

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row for each language, of at most BUCKETS counts
    columns = cut(counted.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")))
    langs = sorted(r["lang"] for r in columns.select("lang").collect())
    total = sum(sizes[lang] for lang in langs)
    blocks = []
    for at in range(0, len(langs), block_langs):
        own = langs[at:at + block_langs]
        counts = np.full((BUCKETS, len(own)), SMOOTHING)
        found = columns.where(F.col("lang").between(own[0], own[-1])).toArrow()
        for lang, places, n in zip(found.column(0).to_pylist(), found.column(1), found.column(2), strict=True):
            counts[places.values.to_numpy(), own.index(lang)] += n.values.to_numpy()
        log_prior = np.log(np.array([sizes[lang] for lang in own], dtype=float) / total)
        blocks.append(session.sparkContext.broadcast(Block(own, np.log(counts / counts.sum(axis=0)).astype(np.float32), log_prior)))
    return Model(langs, blocks)


def score(block: Block, texts: list[str | None]) -> list[tuple[str, float, float] | None]:
    """Of each text with a letter: the best language of the block, its log score, and the log of the sum of all scores."""
    out: list[tuple[str, float, float] | None] = [None] * len(texts)
    waiting: list[tuple[int, np.ndarray]] = []

    def settle() -> None:
        if not waiting:
            return
        grams = np.concatenate([g for _, g in waiting])
        starts = np.cumsum([0] + [len(g) for _, g in waiting[:-1]])
        logs = np.add.reduceat(block.log_prob[grams].astype(np.float64), starts, axis=0) + block.log_prior
        best = logs.argmax(axis=1)
        top = logs.max(axis=1)
        total = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
        for (i, _), k, t, s in zip(waiting, best, top, total, strict=True):
            out[i] = (block.langs[k], float(t), float(s))
        waiting.clear()

    pending, most = 0, max(1, GRAMS // len(block.langs))
    for i, text in enumerate(texts):
        grams = buckets(text) if text else ()
        if not len(grams):
            continue
        if len(grams) > most:  # a long text is summed in slices
            logs = sum(block.log_prob[grams[a:a + most]].astype(np.float64).sum(axis=0) for a in range(0, len(grams), most)) + block.log_prior
            top = float(logs.max())
            out[i] = (block.langs[int(logs.argmax())], top, top + float(np.log(np.exp(logs - top).sum())))
            continue
        waiting.append((i, grams))
        pending += len(grams)
        if pending > most:
            settle()
            pending = 0
    settle()
    return out


def _scored(rows: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``rows`` with ``__lang, __best, __total``: the best language so far, its log score and the log of the sum of all; null without a letter.

    One pass for each block of languages. With several blocks the rows are stored between the passes, so a task never holds two of them.
    """
    session, columns = rows.sparkSession, list(rows.columns)
    at, n = columns.index(text_col), len(columns)
    ship_package(session)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", __lang string, __best double, __total double"
    out, folder = rows, new_folder(session, "languages") if len(model.blocks) > 1 else ""
    for i, shared in enumerate(model.blocks):
        def run(batches: Iterator[pa.RecordBatch], i: int = i, shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                found = score(shared.value, b.column(at).to_pylist())
                if i:
                    earlier = zip(*(b.column(n + c).to_pylist() for c in range(3)), strict=True)
                    found = [x if x is None else (*max((e[:2], x[:2]), key=lambda s: s[1]), float(np.logaddexp(x[2], e[2]))) for x, e in zip(found, earlier, strict=True)]
                state = [pa.array([x and x[c] for x in found], t) for c, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *state], [*columns, "__lang", "__best", "__total"])

        out = out.mapInArrow(run, kinds)
        if len(model.blocks) > 1:
            out = stored(out, f"{folder}/{i}")
    if not model.blocks:
        out = rows.withColumns({"__lang": F.lit(None).cast("string"), "__best": F.lit(None).cast("double"), "__total": F.lit(None).cast("double")})
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` (posterior) of every row."""
    rows = _scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), model, "text")
    return rows.select(F.col("id").alias(id_col), F.coalesce("__lang", F.lit(UNKNOWN)).alias("lang_pred"),
                       F.when(F.col("__lang").isNotNull(), F.least(F.exp(F.col("__best") - F.col("__total")), F.lit(1.0))).otherwise(0.0).alias("score"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language; the rest is rejected."""
    return _scored(docs, model, text_col).where("__lang is not null").select(*docs.columns)


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
