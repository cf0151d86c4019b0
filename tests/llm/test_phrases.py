"""Phrase mining against counting everything."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from llm_fixtures import empty, odd, odd_rows, plain

from plumbline.llm import phrases


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def slow(rows, threshold, top):
    """``rows`` of (lang, text)."""
    f, n, found = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    often = {p: a for p, a in f.items() if a >= threshold and len(p[1]) > 1}
    inside = {(lang, p[i:j]) for (lang, p), a in often.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1)
              if j - i < len(p) and 100 * a >= 100 * f[lang, p[i:j]]}
    for (lang, p), a in often.items():
        if (lang, p) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang in n:
        best = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        out += [(lang, i + 1, p, a, left, right, n[lang], score) for i, (_, score, a, p, left, right) in enumerate(best)]
    return sorted(out)


def prose(seed, n):
    """Short texts with fixed phrases, so that phrases reach the threshold early, late and never."""
    rnd = random.Random(seed)
    fixed = ["new york city hall park", "a b c d e f g", "on the other hand", "ünder wäter", "New York"]
    out = []
    for i in range(n):
        words = [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice("a b c the of on New x, y. z; é!\n".split(" ")) for _ in range(rnd.randrange(30))]
        out.append((rnd.choice(["en", "de", None, "und"]), rnd.choice([" ", "\t", "  "]).join(words) if i % 17 else None))
    return out + [("fr", "late words come last here " * 7)]


@pytest.mark.parametrize("shards, threshold, top, bits, chunk", [(1, 2, 1000, 24, 1 << 20), (3, 5, 20, 24, 7), (2, 4, 1000, 5, 64)])
def test_equals_counting_everything(spark, shards, threshold, top, bits, chunk):
    rows = prose(shards, 120)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    found = phrases.collocations(docs, threshold=threshold, top=top, shards=shards, bits=bits, chunk_words=chunk)
    assert plain(found) == slow(rows, threshold, top)


def test_odd_rows(spark):
    rows = [(r[2], r[1]) for r in odd_rows()]
    assert plain(phrases.collocations(odd(spark), threshold=3)) == slow(rows, 3, 2000)
    assert phrases.collocations(empty(spark)).count() == 0


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(phrases, "_LONG_TEXT", 5)
    for text in ["a bb ccc dddddddddd e", "x" * 30, " ,, a", "a,b;c. dd\nee", "aaaa bbbb,cccc", "é " * 9, ""]:
        assert [w for part in phrases._words(text) for w in part] == re.sub(r"[.,;:!?\n]", " \udcff ", text).encode("utf-8", "surrogateescape").split()


def test_wide_products(spark):
    """Scores whose products pass 64 bits."""
    rows = [("en", "p q")] * 3 + [("en", "p")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = spark.createDataFrame([("en", "p", 1, 5 * 10**11), ("en", "q", 1, 3 * 10**11), ("en", "p q", 2, 3 * 10**11)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 8 * 10**14)], "lang string, n long")
    keep = phrases.frequencies
    try:
        phrases.frequencies = lambda *a: (found, totals)
        (row,) = phrases.collocations(docs).collect()
    finally:
        phrases.frequencies = keep
    assert row["score"] == 1000 * 3 * 10**11 * 8 * 10**14 // (5 * 10**11 * 3 * 10**11)


def test_phrases_of_a_chunk_are_counted_without_sorting(monkeypatch):
    rnd = random.Random(4)
    words = [b"a", b"b", b"c", b"d"]
    numbers = [rnd.randint(0, 4) for _ in range(500)]
    chunk = phrases.Chunk(["en"], phrases.pa.array([w.decode() for w in words]), phrases.np.zeros(4, dtype="int64"), phrases.np.array(numbers, dtype="int64"), 500)
    hashes = sorted(phrases.phrase_hash("en", [w]) for w in words)
    reached = {1: (phrases.np.array(hashes, dtype="int32"), phrases.np.zeros(4, dtype="uint8"))}

    def refused(*_, **__):
        raise AssertionError("sorted")

    monkeypatch.setattr(phrases.np, "unique", refused)
    got = {length: {tuple(p): c for p, c in zip(found.tolist(), counts.tolist(), strict=True)} for length, found, counts in phrases._counted(chunk, 1, 3, reached, phrases.HASH_BITS)}
    want = Counter(p for p in zip(numbers, numbers[1:]) if all(p))
    assert got == {1: {(n,): c for n, c in Counter(numbers).items() if n}, 2: dict(want)}


def test_phrases_are_numbered_by_their_words():
    """Also where the words' numbers take more bits than an integer has."""
    rnd = random.Random(5)
    for most in (3, 40, (1 << 21) - 1, (1 << 31) - 1):
        few = [rnd.randint(max(1, most - 3), most) for _ in range(4)]
        ids = phrases.np.array([rnd.choice(few) for _ in range(400)] + [0], dtype="int64")
        at = phrases.np.arange(300)
        for length in range(1, 6):
            own = [tuple(ids[p:p + length].tolist()) for p in at.tolist()]
            numbers = phrases._alike(ids, at, length).tolist()
            assert len(set(zip(numbers, own, strict=True))) == len(set(own)) == len(set(numbers)) == max(numbers) + 1


def test_phrases_that_are_not_counted_are_not_numbered(monkeypatch):
    """Long after a phrase's cycle a step only passes over it."""
    numbers = [1, 2, 3, 1, 2, 0] * 50
    words = [b"a", b"b", b"c"]
    chunk = phrases.Chunk(["en"], phrases.pa.array([w.decode() for w in words]), phrases.np.zeros(3, dtype="int64"), phrases.np.array(numbers, dtype="int64"), len(numbers))

    def table(*some):
        return phrases.np.array(sorted({phrases.phrase_hash("en", list(s)) for s in some}), dtype="int32")
    reached = {1: (table(*[(w,) for w in words]), phrases.np.zeros(3, dtype="uint8")), 2: (table((b"a", b"b")), phrases.np.ones(1, dtype="uint8"))}
    seen, number = [], phrases._alike
    monkeypatch.setattr(phrases, "_alike", lambda ids, at, length: seen.append((length, len(at))) or number(ids, at, length))
    assert [(n, found.tolist(), count.tolist()) for n, found, count in phrases._counted(chunk, 9, 3, reached, phrases.HASH_BITS)] == []
    assert seen == []
    ((length, found, count),) = phrases._counted(chunk, 3, 3, reached, phrases.HASH_BITS)
    assert length == 2 and dict(zip(map(tuple, found.tolist()), count.tolist(), strict=True)) == {(1, 2): 100, (2, 3): 50, (3, 1): 50}
    assert seen == [(2, 200)]
