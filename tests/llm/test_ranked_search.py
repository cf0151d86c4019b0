"""Ranked search against scoring every document, and the limit on accumulators."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import empty, odd, odd_rows, plain

from plumbline.llm import ranked_search


def terms_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def slow(docs, items, k):
    """``docs`` and ``items`` of (id, text)."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    nn, ll = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        hits = []
        for i, c in counted:
            m = 100 - 90 + 90 * sum(c.values()) * nn // ll
            score = sum(math.floor(1000 * math.log((2 * nn + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                hits.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(hits, key=lambda h: (h[0], h[1], h[2] or 0))[:k])]
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


def corpus(n, seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    return [(i, " ".join(rnd.choices(vocabulary, weights=[1 / (j + 1) for j in range(300)], k=rnd.randrange(0, 80)))) for i in range(n)]


@pytest.mark.parametrize("shard, block", [(4096, 1 << 18), (16, 10)])
def test_equals_scoring_everything(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ranked_search, "SHARD_ROWS", shard)
    docs = corpus(300) + [(1000 + i, "same W1 w2-W7 words in many copies") for i in range(40)]
    items = [(i, docs[i * 3][1][: 20 + 10 * i]) for i in range(20)] + [(50, "same words W1"), (51, None), (52, "unheard of"), (50, "w250 w7"), (None, "w1 w2 w3")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert plain(ranked_search.search(rows, asked, block_terms=block)) == slow(docs, items, 10)
    assert plain(ranked_search.search(rows, asked, k=1, block_terms=block)) == slow(docs, items, 1)


def test_odd_rows(spark):
    items = [(1, "lorem alpha beta"), (2, "текст"), (3, "")]
    asked = spark.createDataFrame(items, "item_id int, text string")
    docs = odd(spark)
    assert plain(ranked_search.search(docs, asked)) == slow([r[:2] for r in odd_rows()], items, 10)
    assert ranked_search.search(empty(spark), asked).count() == 0
    assert ranked_search.search(docs, asked.where("false")).count() == 0
    texts = spark.createDataFrame([("a", "alpha")], "item_id string, text string")
    assert ranked_search.search(docs.withColumn("doc_id", docs["doc_id"].cast("string")), texts).count() > 0


def test_accumulators_are_limited():
    """A document that holds only a frequent term gets no accumulator once rare terms have settled the first places."""
    lengths = np.full(100, 10)
    rare, common = 0, 1
    offsets, terms, tfs = [0], [], []
    for i in range(100):
        own = [rare, common] if i < 5 else [common]
        terms += own
        tfs += [1] * len(own)
        offsets.append(len(terms))
    shard = ranked_search.Shard(lengths, np.array(offsets), np.array(terms), np.array(tfs), np.array([3000, 10]), 100, 1000)
    scores = shard.search(np.array([rare, common]), 3, 0)
    assert (scores > 0).sum() == 5 and len(set(scores[:5].tolist())) == 1
    assert scores[0] == shard.bounds.sum()
    assert (shard.search(np.array([rare, common]), 10, 0) > 0).sum() == 100
    assert (shard.search(np.array([rare, common]), 10, int(scores[0]) + 1) > 0).sum() == 0
