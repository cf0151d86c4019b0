from __future__ import annotations

import math
import random

import numpy as np
import pytest
from llm_fixtures import empty, odd
from pyspark.sql import functions as F

from plumbline.llm import language_id as L

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = L.held_out(F.col("doc_id"))
    found = L.predict(docs, L.train(docs.where(~held))).join(docs.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_scores_equal_plain_bayes(spark):
    train = [(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (3, "the house", "en"), (4, None, "en"), (5, "x", None)]
    model = L.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]
    counts = {lang: np.zeros(L.BUCKETS) for lang in model.langs}
    for _, text, lang in train[:3]:
        for b in L.buckets(text):
            counts[lang][b] += 1
    for text in ["the und", "katze", "q", "Der HUND!"]:
        logs = []
        for lang, n in (("de", 1), ("en", 2)):
            total = counts[lang].sum() + L.SMOOTHING * L.BUCKETS
            logs.append(math.log(n / 3) + sum(math.log((counts[lang][b] + L.SMOOTHING) / total) for b in L.buckets(text)))
        (lang, best, total), = L.score(model.blocks[0].value, [text])
        assert lang == model.langs[int(np.argmax(logs))]
        assert math.exp(best - total) == pytest.approx(1 / sum(math.exp(x - max(logs)) for x in logs), abs=1e-4)


def test_long_texts_and_blocks_agree(spark, monkeypatch):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(["der", "die", "und"] if i % 2 else ["the", "and", "of"], k=30)), "de" if i % 2 else "en")
                                  for i in range(20)], "doc_id long, text string, lang string")
    model = L.train(docs)
    texts = ["the and of " * 50, "und die der", "of", None, "der " * 400, "12 34"]
    whole = L.score(model.blocks[0].value, texts)
    monkeypatch.setattr(L, "GRAMS", 64)
    for a, b in zip(whole, L.score(model.blocks[0].value, texts), strict=True):
        assert a == b or a[0] == b[0] and a[1:] == pytest.approx(b[1:])
    assert [w and w[0] for w in whole] == ["en", "de", "en", None, "de", None]


def test_odd_rows(spark):
    docs = odd(spark)
    model = L.train(docs)
    found = L.predict(docs, model).collect()
    assert len(found) == docs.count()
    by_text = {(r.doc_id, r.text): r for r in docs.collect()}
    for r in found:
        if r.doc_id is not None and (r.doc_id, None) in by_text:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    kept = L.accepted(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == sorted(r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
    assert L.accepted(empty(spark), model).count() == 0
    nothing = L.train(empty(spark))
    assert {r.lang_pred for r in L.predict(docs, nothing).collect()} == {"und"}


def test_any_number_of_languages_in_blocks(spark, monkeypatch):
    """Every label is learned; scoring block by block gives what one block gives."""
    monkeypatch.setattr(L, "COUNTED_LANGS", 2)
    rnd = random.Random(3)
    words = {f"l{k}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)] for k in range(7)}
    rows = [(i, " ".join(rnd.choices(words[f"l{i % 7}"], k=20)), f"l{i % 7}") for i in range(70)] + [(100, None, "l1"), (101, "12", "l2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    one, many = L.train(docs), L.train(docs, block_langs=3)
    assert one.langs == many.langs == sorted(words) and (len(one.blocks), len(many.blocks)) == (1, 3)
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, m).collect()} for m in (one, many))
    assert {i: lang for i, (lang, _) in a.items()} == {i: lang for i, (lang, _) in b.items()}
    assert all(a[i][1] == pytest.approx(b[i][1], abs=1e-6) for i in a) and sum(a[i][0] == lang for i, _, lang in rows) >= 70
    kept = L.accepted(docs, many)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(70))
