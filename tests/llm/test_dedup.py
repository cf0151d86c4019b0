from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from llm_fixtures import empty, odd, odd_rows, plain

from plumbline.llm import exact_dedup, simhash
from plumbline.llm.components import components


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def key(row):
    return [(v is not None, v) for v in row]


def exact_expected():
    rows, out = odd_rows(), []
    for t in {norm(r[1]) for r in rows}:
        ids = [r[0] for r in rows if norm(r[1]) == t]
        keep = min((i for i in ids if i is not None), default=None)
        seen = False
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), i == keep and not seen))
            seen |= i == keep
    return sorted(out, key=key)


@pytest.mark.parametrize("most", [0, 1 << 22])
def test_exact_groups(spark, most):
    assert plain(exact_dedup.exact_groups(odd(spark), most=most)) == exact_expected()


def test_exact_prefix_is_not_the_whole(spark):
    docs = spark.createDataFrame([(1, "same start a"), (2, "same start b"), (3, "same start a")], "doc_id long, text string")
    assert plain(exact_dedup.drop_copies(docs), "doc_id") == [(1,), (2,)]
    assert plain(exact_dedup.exact_groups(docs, prefix=5)) == [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False)]


def test_exact_empty_and_drop(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert exact_dedup.drop_copies(empty(spark)).count() == 0
    left = exact_dedup.drop_copies(odd(spark))
    assert left.columns == odd(spark).columns
    assert plain(left, "doc_id") == sorted([(r[0],) for r in exact_expected() if r[3]], key=key)
    assert len({norm(r["text"]) for r in left.collect()}) == left.count()


def slow_fingerprint(text, words=4):
    parts = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not parts:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i:i + words]).encode(), 42) for i in range(max(1, len(parts) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Smallest index reachable over links of at most 4 bits."""
    label = list(range(len(prints)))
    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def test_position_sets_meet_every_four():
    assert all(any(set(s) <= set(c) for s in simhash.position_sets()) for c in combinations(range(8), 4))


def test_fingerprint(spark):
    for text in [None, "", "One", "a b c", "a b c d", "a b c d e f a b c d", "ÀB c\x0bD e f", "x y " * 500]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_near_groups(spark):
    rows = odd_rows()
    prints = [slow_fingerprint(r[1]) for r in rows]
    label = classes(prints)
    ids = {a: min((r[0] for r, b in zip(rows, label) if b == a and r[0] is not None), default=None) for a in set(label)}
    want = sorted([(r[0], f"{p:016x}", ids[a]) for r, p, a in zip(rows, prints, label)], key=key)
    assert plain(simhash.near_groups(odd(spark))) == want
    assert simhash.near_groups(empty(spark)).count() == 0
    left = simhash.keep_one(odd(spark))
    assert left.columns == odd(spark).columns and left.count() == len(set(label))
    assert {r.doc_id for r in left.collect()} == set(ids.values())
    assert simhash.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize(("short", "block"), [(32, 2048), (1, 7)])
def test_links_connect_what_brute_force_does(spark, short, block):
    rnd = random.Random(1)
    prints = {rnd.getrandbits(64) for _ in range(60)}
    center = rnd.getrandbits(64)
    for _ in range(60):  # a group that is close together, and chains away from it
        prints.add(center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))))
        prints.add(rnd.choice(sorted(prints)) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))))
    prints = sorted(int(np.uint64(p).view(np.int64)) for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df, short, block)).collect()}
    label = classes([p & (1 << 64) - 1 for p in prints])
    assert [found.get(p, p) for p in prints] == [prints[a] for a in label]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 22])
def test_keep_rows(spark, most):
    from pyspark.sql import functions as F

    from plumbline.llm.keeping import keep_rows
    rows = [(1, "a", 0), (1, "b", 1), (2, "a", 2), (3, "c", 3), (3, "c", 4), (None, "d", 5), (None, "d", 6), (None, "e", 7), (4, "f", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    verdict = spark.createDataFrame([(1, "a", True, 1), (1, "b", False, 1), (2, "a", False, 1), (3, "c", True, 2), (None, "d", True, 2), (None, "e", False, 1),
                                     (4, "f", True, 1)], "id long, tag string, keep boolean, times long")
    for said in (verdict, verdict.where("NOT keep OR times > 1")):  # rows that are not mentioned stay
        left = keep_rows(docs, said, "doc_id", F.col("text"), most)
        assert left.columns == docs.columns
        assert plain(left, "doc_id", "text") == [(None, "d"), (1, "a"), (3, "c"), (4, "f")]
    assert keep_rows(docs, verdict.where("keep AND times = 1"), "doc_id", F.col("text"), most).count() == 9


def test_rows_not_in_question_are_not_moved(spark):
    """However many verdicts there are, only rows in question and a few by chance take the join."""
    from pyspark.sql import functions as F

    from plumbline.llm.keeping import SPREAD, Marks
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"))
    for share in (2, 9):  # nine of ten ids carry a verdict
        verdict = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(10)) < share).select(F.col("doc_id").alias("id"))
        clear, asked = Marks(verdict, "id").split(docs, docs["doc_id"])
        n = verdict.count()
        assert clear.count() + asked.count() == 20_000 and asked.join(verdict, asked["doc_id"] == verdict["id"]).count() == n
        assert asked.count() - n <= 2 * (20_000 - n) / SPREAD
