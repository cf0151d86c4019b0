from __future__ import annotations

import random
import time

import numpy as np
import pytest
from llm_fixtures import empty, odd

from plumbline import session
from plumbline.llm import substring_dedup as S


def test_word_hashes():
    a, b = S.word_hashes("The cat\tsat  on\x0bthe CAT"), S.word_hashes("xx the  cat ")
    assert len(a) == 6 and a[0] == a[4] == b[1] and a[1] == a[5] == b[2] and len(set(a.tolist())) == 4
    assert len(S.word_hashes(None)) == len(S.word_hashes(" \n")) == 0
    long = "wörd " * 50_000
    assert len(set(S.word_hashes(long).tolist())) == 1


def test_every_equal_run_shares_a_seed():
    rnd = random.Random(4)
    for _ in range(30):
        run = [rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(S.WINDOW + S.WORDS - 1)]
        texts = [" ".join([rnd.choice("xyz") * rnd.randint(1, 4) for _ in range(rnd.randint(0, 40))] + run + [rnd.choice("uvw") for _ in range(rnd.randint(0, 40))])
                 for _ in range(2)]
        a, b = (set(S.seeds_of(S.word_hashes(t))[1].tolist()) for t in texts)
        assert a & b


def test_fenwick_chain_is_the_best_chain():
    rnd = random.Random(6)
    for _ in range(40):
        n = rnd.randint(1, 25)
        pts = sorted({(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(n)})
        x, y = [p[0] for p in pts], [p[1] for p in pts]
        score = []
        for i in range(len(pts)):  # pts are sorted by x
            gains = [(score[j] - S.GAP * (x[i] - x[j] + y[i] - y[j] - 2 * S.WORDS), -j, j) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            best = max(gains, default=(0, 0, 0))
            score.append(best[0] + min(S.WORDS, x[i] - x[best[2]], y[i] - y[best[2]]) if best[0] > 0 else S.WORDS)
        found = S.chains(x, y)
        assert sorted(i for c in found for i in c) == list(range(len(pts)))
        assert all(x[a] < x[b] and y[a] < y[b] for c in found for a, b in zip(c, c[1:], strict=False))

        def value(chain):
            out = S.WORDS
            for a, b in zip(chain, chain[1:], strict=False):
                out += min(S.WORDS, x[b] - x[a], y[b] - y[a]) - S.GAP * (x[b] - x[a] + y[b] - y[a] - 2 * S.WORDS)
            return out
        assert value(found[0]) == pytest.approx(max(score))


def corpus():
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    shared, fuzzy = text(60), text(120)
    docs = {i: text(rnd.randint(0, 300)) for i in range(40)}
    for i in (3, 9, 27):
        docs[i] = docs[i][:50] + shared + docs[i][50:]
    for i in (5, 31):
        own = list(fuzzy)
        for at in rnd.sample(range(120), 4):  # a word in thirty differs
            own[at] = rnd.choice(vocab)
        docs[i] = docs[i][:20] + own + docs[i][20:]
    for i in (6, 7):
        docs[i] = docs[i] + shared[:30]  # too short to report
    docs[33] = list(docs[12])
    return docs


def test_finds_passages_and_nothing_else(spark):
    docs = corpus()
    rows = [(i, " ".join(w).upper() if i % 2 else " ".join(w), i) for i, w in docs.items()]
    df = spark.createDataFrame(rows + [(3, " ".join(docs[3]), 0), (None, " ".join(docs[3]), 0), (77, None, 0), (78, "", 0)], "doc_id long, text string, seed int")
    found = S.repeated_passages(df).collect()
    want = {(9, 3), (27, 3), (31, 5)} | ({(33, 12)} if len(docs[12]) >= S.LEAST else set())
    assert {(r.doc_id, r.other_id) for r in found} == want
    for r in found:
        a, b = docs[r.doc_id][r.start:r.end], docs[r.other_id][r.other_start:r.other_end]
        if (r.doc_id, r.other_id) != (31, 5):
            assert a == b and r.similarity == 1
        assert len(a) >= (110 if r.doc_id == 31 else 60) and r.similarity >= S.SIMILAR


def test_alignment_counts_equal_words():
    a = np.arange(100, dtype=np.uint16)
    b = a.copy()
    b[[20, 50]] = 999
    assert S.passages(a, b, [0, 60], [0, 60]) == [(0, 100, 0, 100, 0.98, [])]
    assert S.passages(a, a, [30], [30]) == [(0, 100, 0, 100, 1.0, [(0, 100)])]
    b[20] = a[20]
    assert S.passages(a, b, [60], [60]) == [(0, 100, 0, 100, 0.99, [(0, 50)])]
    b = np.concatenate([a[:40], np.full(30, 888, np.uint16), a[40:]])  # a long insertion parts the passage
    assert S.passages(a, b, [0, 30, 60, 80], [0, 30, 90, 110], least=30) == [(0, 40, 0, 40, 1.0, [(0, 40)]), (40, 100, 70, 130, 1.0, [(40, 100)])]


def test_odd_rows(spark):
    found = S.repeated_passages(odd(spark)).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(6, 5), (7, 5), (9, 8)}
    assert S.repeated_passages(empty(spark)).count() == 0


def test_run_hashes():
    words = np.random.default_rng(1).integers(0, 4, 300).astype("<u2")
    found, seen = S.run_hashes(words, 7), {}
    for i, h in enumerate(found.tolist()):
        assert seen.setdefault(tuple(words[i:i + 7].tolist()), h) == h
    assert len(found) == 294 and len(set(found.tolist())) == len(seen) and not len(S.run_hashes(words[:6], 7))


def linked(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in pairs:
        root[find(a)] = find(b)
    return find


def test_parts_of_a_passage_hide_no_link(spark):
    """Two documents share 100 words of which earlier ones hold overlapping parts, too short to be reported."""
    rnd = random.Random(11)
    fresh = lambda n: [f"x{rnd.randrange(10**9)}" for _ in range(n)]
    whole = fresh(100)
    docs = {i: fresh(5) + whole[20 * (i - 1):20 * (i - 1) + 40] + fresh(5) for i in range(1, 5)}
    docs[8], docs[9] = fresh(9) + whole + fresh(3), fresh(2) + whole + fresh(40)
    docs[7] = fresh(30) + whole[5:95] + fresh(3)
    found = S.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()
    got = {(r.doc_id, r.other_id): (r.start, r.end, r.other_start, r.other_end) for r in found}
    # 7 holds 90 of the words, which 8 and 9 share with it; the runs that begin or end outside those are joined on their own
    assert got == {(8, 7): (14, 104, 30, 120), (9, 7): (7, 97, 30, 120), (9, 8): (2, 102, 9, 109)}


def test_every_equal_run_is_linked(spark):
    """Nested and overlapping passages in 60 documents against comparing all runs of 50 words."""
    rnd = random.Random(12)
    sources = [[f"s{k}w{i}" for i in range(160)] for k in range(3)]
    docs = {}
    for i in range(60):
        words = []
        for _ in range(rnd.randint(1, 3)):
            source, a = rnd.choice(sources), rnd.randrange(120)
            part = list(source[a:a + rnd.randint(20, 110)])
            if rnd.random() < 0.3:
                part[rnd.randrange(len(part))] = f"odd{i}"
            words += [f"own{rnd.randrange(10**9)}" for _ in range(rnd.randint(0, 30))] + part
        docs[i] = words
    holders = {}
    for i, words in docs.items():
        for at in range(len(words) - 49):
            holders.setdefault(tuple(words[at:at + 50]), set()).add(i)
    found = S.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(4)).collect()
    by_run = {}
    for r in found:
        a, b = docs[r.doc_id][r.start:r.end], docs[r.other_id][r.other_start:r.other_end]
        assert r.other_id < r.doc_id and min(len(a), len(b)) >= 50 and r.similarity >= S.SIMILAR
        if r.similarity == 1:  # ends are exact: neither side goes on alike
            assert a == b
            assert r.start == 0 or r.other_start == 0 or docs[r.doc_id][r.start - 1] != docs[r.other_id][r.other_start - 1]
            assert r.end == len(docs[r.doc_id]) or r.other_end == len(docs[r.other_id]) or docs[r.doc_id][r.end] != docs[r.other_id][r.other_end]
        for run in {tuple(a[i:i + 50]) for i in range(len(a) - 49)} & {tuple(b[i:i + 50]) for i in range(len(b) - 49)}:
            by_run.setdefault(run, []).append((r.doc_id, r.other_id))
    for run, own in holders.items():  # all holders of a run are linked through passages that hold that run
        find = linked(by_run.get(run, []))
        assert len({find(x) for x in own}) == 1, (run[0], own)


def test_long_gaps_and_rows_with_one_id(spark):
    rnd = random.Random(13)
    fresh = lambda n: [f"x{rnd.randrange(10**9)}" for _ in range(n)]
    core = fresh(900)
    other = list(core)
    for at in range(7, 900, 12):  # no seed in common anywhere but at the ends
        other[at] = f"z{at}"
    other[:60], other[-60:] = core[:60], core[-60:]
    docs = [(1, " ".join(core)), (2, " ".join(other)), (3, "a b"), (3, " ".join(core)), (3, " ".join(core))]
    found = S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert (2, 1, 0, 900) in {(r.doc_id, r.other_id, r.start, r.end) for r in found}


def test_chains_of_a_pair_stay_in_one_row(spark):
    """A word that repeats meets the same place of the other document again and again: many chains, whose words are fetched once."""
    matches = spark.createDataFrame([(2, 0, 1, 5, list(range(40)), [5] * 40)], "id long, first int, other long, other_first int, xs array<int>, ys array<int>")
    (row,) = S._chained(matches, 1).collect()
    assert sorted(row.xs) == [[x] for x in range(40)] and row.ys == [[5]] * 40
    assert S._chained(matches, 2).count() == 0


def test_repeated_words_keep_their_passages(spark):
    fresh = lambda k, n: [f"x{k}y{i}" for i in range(n)]
    docs = {1: fresh(1, 20) + ["a"] * 60 + fresh(2, 20), 2: fresh(3, 20) + ["a"] * 200 + fresh(4, 20)}
    found = S.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()
    assert {r.start for r in found} >= {20, 100, 170} and all(r.doc_id == 2 and r.other_id == 1 and r.similarity == 1 for r in found)
    for r in found:
        assert docs[2][r.start:r.end] == docs[1][r.other_start:r.other_end] == ["a"] * (r.end - r.start) and r.end - r.start >= 50


def test_seeds_of_several_texts(monkeypatch):
    rnd = random.Random(14)
    texts = [None, "", "  ", "a b c", " a b c d e ", "é " * 16, "q " * 300]
    texts += [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.choice([4, 5, 15, 16, 17, 60, 400]))) for _ in range(60)]
    for together in (1, 300, 1 << 18):
        monkeypatch.setattr(S, "TOGETHER", together)
        at = 0
        for first, words, sizes in S.hashed_together(texts):
            assert first == at
            places, hashes, counts = S.seeds_together(words, sizes)
            for n, own in zip(np.split(np.arange(len(places)), np.cumsum(counts)[:-1]), np.split(words, np.cumsum(sizes)[:-1]), strict=True):
                assert own.tolist() == S.word_hashes(texts[at]).tolist()
                shingles = [tuple(own[i:i + S.WORDS].tolist()) for i in range(len(own) - S.WORDS + 1)]
                value = {s: int(S.seeds_of(np.array(s, dtype=np.uint64))[1][0]) for s in shingles}
                spans = [range(i, i + S.WINDOW) for i in range(len(shingles) - S.WINDOW + 1)] or ([range(len(shingles))] if shingles else [])
                want = sorted({min(span, key=lambda i: (value[shingles[i]], i)) for span in spans})
                assert places[n].tolist() == want == S.seeds_of(own)[0].tolist()
                assert hashes[n].tolist() == [value[shingles[i]] for i in want] == S.seeds_of(own)[1].tolist()
                at += 1
        assert at == len(texts)


def test_bridge_skips_the_fewest_words():
    rnd = random.Random(15)
    for _ in range(400):
        a, b = ([rnd.randrange(rnd.choice([2, 4])) for _ in range(rnd.randint(0, 28))] for _ in range(2))
        a, b = [7, *a], [8, *a[rnd.randrange(10):]] if rnd.random() < 0.5 else [8, *b]
        want = None
        for need, most in ((5, S.BREAK), (S.SHORT_RUN, S.SHORT_RUN)):
            steps = [(max(x, y), -min(x, y), x < y, x, y) for x in range(most + 1) for y in range(most + 1)
                     if x + need <= len(a) and y + need <= len(b) and a[x:x + need] == b[y:y + need]]
            want = want or (min(steps)[3:] if steps else None)
        assert S._bridge(np.array(a, dtype="<u2"), np.array(b, dtype="<u2"), 5) == want


def test_open_places_of_several_pieces():
    """Against one place at a time."""
    rnd, least = random.Random(16), 20
    for _ in range(20):
        sizes = [rnd.choice([0, 5, 19, 20, 21, 60, 90]) for _ in range(6)]
        starts = np.cumsum([0, *sizes])[:-1].tolist()
        words = np.array([rnd.randrange(9) for _ in range(sum(sizes))], dtype="<u2")
        spots = [s + i for s, n in zip(starts, sizes, strict=True) for i in range(n) if rnd.random() < 0.25]
        foreign = [p for p in spots if rnd.random() < 0.1]
        covered = [(s + p, s + rnd.randint(p, n - least + 1)) for s, n in zip(starts, sizes, strict=True) if n >= least and rnd.random() < 0.5
                   for p in [rnd.randint(0, n - least + 1)]]
        for own in (False, True):
            want = []
            for s, n in zip(starts, sizes, strict=True):
                for i in range(s, s + n - least + 1):
                    windows = range(i, i + least - S.WORDS + 1 - S.WINDOW + 1)
                    shared = all(any(p in spots for p in range(w, w + S.WINDOW)) for w in windows)
                    mine = not any(p in foreign for p in range(i, i + least - S.WORDS + 1))
                    if shared and mine == own and not any(p <= i < q for p, q in covered):
                        want.append(i)
            edges = tuple(np.array([c[k] for c in covered], dtype=np.int64) for k in (0, 1))
            found, hashes = S.open_places(words, np.array(sizes), np.array(spots, dtype=np.int64), np.array(foreign, dtype=np.int64), edges, least, own)
            assert found.tolist() == want
            assert hashes.tolist() == [int(S.run_hashes(words[i:i + least], least)[0]) for i in want]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_") and name.endswith(".data")}


def test_a_freed_step_leaves_no_shuffle_files(spark):
    numbers = spark.range(1000).selectExpr("id % 7 n", "id").groupBy("n").sum("id")
    kept = shuffle_files(spark)
    out = session.cut_and_free(numbers)
    until = time.time() + 20
    while shuffle_files(spark) - kept and time.time() < until:  # they are removed in the background
        time.sleep(0.2)
    assert not shuffle_files(spark) - kept
    assert spark.conf.get(session.FREE_SHUFFLES, None) in (None, "false")
    assert sorted(r.n for r in out.collect()) == list(range(7)) and numbers.count() == 7  # what was freed is made again when asked for


def test_words_are_stored_once_and_steps_freed(spark, monkeypatch):
    steps, files = [], []

    def watched(df):
        before = shuffle_files(spark)
        out = session.cut_and_free(df)
        steps.append(df.columns)
        files.append(before)
        return out
    monkeypatch.setattr(S, "cut_and_free", watched)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in corpus().items()], "doc_id long, text string")
    found = S.repeated_passages(docs)
    until = time.time() + 20
    while len(shuffle_files(spark) - files[0]) > 20 and time.time() < until:
        time.sleep(0.2)
    assert sum("piece" in s for s in steps) == 1
    assert len(shuffle_files(spark) - files[0]) <= 20  # of two counts between the steps
    assert found.count() >= 3
