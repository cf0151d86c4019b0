"""Fuzzy repeated passages by collinear chaining of shared seeds.

Words are what stands between ASCII white space, A-Z lower-cased.

1. **Seeds**: shingles of ``WORDS`` = 5 words are hashed; of each ``WINDOW`` neighbouring shingles the one with the smallest hash is
   a seed. Any run of WINDOW + WORDS - 1 = 16 equal words shares a seed, whatever surrounds it.
2. **Stretches**: the seeds of a document that other documents hold too are cut into stretches where more than ``APART`` words have none; so many
   words without a common seed hold more unequal words than any passage bridges. Only the words of stretches are fetched, once.
3. **Join**: a seed's representative is its first place in the document with the smallest id. Every other document with
   the seed is matched with the representative only, so a passage in a third of all documents gives one match for each
   document and seed, never all pairs. Seeds of one document only are dropped by their aggregate.
4. **Chaining**: the matches of a pair of stretches, ordered by place, are chained where both places
   increase. A chain scores its words less ``GAP`` for each word skipped on either side; the best predecessor comes from a
   Fenwick tree of prefix maxima over the other document's places.
5. **Alignment**: along a chain, words are compared forwards and backwards from its seeds until the texts run apart: up to ``BREAK`` words of either
   side may be skipped where ``WORDS`` equal ones follow, up to ``SHORT_RUN`` where as many do. Passages of at least ``LEAST`` words with similarity (equal words over the
   longer side) of at least ``SIMILAR`` = 0.8 remain.
6. **What representatives miss**: the representatives of a passage's seeds may be documents that hold too little of it. So the runs of ``LEAST`` words
   of a stretch that no passage so far covers with equal words are hashed and joined as a whole, again with the first document that has
   them, and chained and aligned in the same way. A run that is covered is held by a document with a smaller id as well, so all documents with a run
   of ``LEAST`` equal words are linked, directly or through others that hold the same run. Only runs without a window that lacks a shared seed can
   be shared; those of documents that are themselves the representative of all their seeds are kept only where another document's run asks for them.

A document's seeds bound what one task holds; hot seeds and runs are rows of plain equi-joins of stored tables. A step's shuffle files go once its rows are stored.

Edge cases: null ids take no part, null and empty texts have no words. Of rows with one id the text with the smallest hash counts. Repeats
within one document are not reported. An empty table gives an empty result. Long texts are read whole, a few rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import slices
from plumbline.session import cut_and_free, ship_package

WORDS = 5
WINDOW = 12
LEAST = 50
SIMILAR = 0.8
SEEDS = 2  # a chain has this many at least
GAP = 0.05
BREAK = 15  # words of either side that may be skipped between equal ones
SHORT_RUN = 3  # equal words that are enough after so few skipped ones
REACH = WORDS + WINDOW + 3  # a passage of equal words ends within so many words of its outermost seed
MARGIN = 4 * REACH  # words fetched around a stretch
APART = (BREAK + 1) * (WORDS + WINDOW - 1)  # words without a shared seed that part stretches
SLICE = 64  # rows worked on at once
TOGETHER = 1 << 18  # bytes of texts whose words are hashed at once (a longer text by itself)
MANY_RUNS = 1 << 21  # hashes (one long each) that are broadcast at most

_P = 0x9E3779B97F4A7C15  # odd
_P_INVERSE = pow(_P, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _powers(base: int, n: int, memory: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if len(memory.get(base, ())) < n:
        factors = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        factors[0] = 1
        memory[base] = np.cumprod(factors)
    return memory[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashed(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where it starts: the difference of two prefix hashes, moved to the start."""
    raw = np.frombuffer(plain.lower(), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    prefix = np.concatenate(([np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(raw)))))
    return _mixed((prefix[ends] - prefix[starts]) * _powers(_P_INVERSE, len(raw))[starts]), starts


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of a text."""
    return _hashed((text or "").encode("utf-8", "replace"))[0]


def _by_size(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """The first and the last of groups of consecutive rows that hold ``TOGETHER`` bytes at most, or one row."""
    first = 0
    while first < len(sizes):
        last, size = first + 1, sizes[first]
        while last < len(sizes) and size + sizes[last] <= TOGETHER:
            size += sizes[last]
            last += 1
        yield first, last
        first = last


def hashed_together(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts in groups of consecutive ones: the place of the first, the hashes of all words, and how many words each text has.

    A word's hash does not depend on where it stands, so texts are joined by a space.
    """
    plain = [(t or "").encode("utf-8", "replace") for t in texts]
    for first, last in _by_size([len(t) + 1 for t in plain]):
        words, starts = _hashed(b" ".join(plain[first:last]))
        ends = np.cumsum([len(t) + 1 for t in plain[first:last]])
        yield first, words, np.diff(np.searchsorted(starts, ends), prepend=0)


def seeds_of(words: np.ndarray, k: int = WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the seeds of a text."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    shingles = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        shingles = shingles * np.uint64(0xC2B2AE3D27D4EB4F) + words[j:n + j]
    shingles = _mixed(shingles)
    at = _smallest(shingles, min(n, window))
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return at, shingles[at]


def _smallest(values: np.ndarray, window: int) -> np.ndarray:
    """The place of the first smallest value of each ``window`` neighbouring ones: those of shorter windows are paired."""
    least, at, span = values, np.arange(len(values)), 1
    while span < window:
        step = min(span, window - span)
        left, right = least[:-step], least[step:]
        at = np.where(right < left, at[step:], at[:-step])
        least = np.minimum(left, right)
        span += step
    return at


def seeds_together(words: np.ndarray, sizes: np.ndarray, k: int = WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and numbers of the seeds of texts with so many words each, as :func:`seeds_of` finds them one by one."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    reach = window + k - 1
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.zeros(len(sizes), dtype=np.int64)
    shingles = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        shingles = shingles * np.uint64(0xC2B2AE3D27D4EB4F) + words[j:n + j]
    shingles = _mixed(shingles)
    some = [np.empty(0, dtype=np.int64)]
    if n >= window:
        at = _smallest(shingles, window)
        at = at[(np.repeat(ends, sizes) - np.arange(len(words)))[:len(at)] >= reach]  # windows within one text
        some.append(at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at)
    short = np.flatnonzero((sizes >= k) & (sizes < reach))  # these have no whole window
    some.append(np.array([s + shingles[s:e - k + 1].argmin() for s, e in zip(starts[short].tolist(), ends[short].tolist(), strict=True)], dtype=np.int64))
    at = np.concatenate(some)
    if len(short):
        at = np.sort(at)
    counts = np.diff(np.searchsorted(at, ends), prepend=0)
    return at - np.repeat(starts, counts), shingles[at], counts


def chains(x: list[int], y: list[int], k: int = WORDS, gap: float = GAP) -> list[list[int]]:
    """Chains of matches (x, y), each a list of indices in order; every match is in one chain at most.

    score(i) = k + max(0, max over j with x_j < x_i, y_j < y_i of score(j) - gap * words skipped on both sides). The part that depends on j is
    score(j) + gap * (x_j + y_j), whose maximum over smaller y is a prefix maximum.
    """
    order = sorted(range(len(x)), key=lambda i: (x[i], -y[i]))  # of equal x none precedes another
    rank = {v: r for r, v in enumerate(sorted(set(y)), 1)}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(rank) + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    for i in order:
        best, j, r = float("-inf"), -1, rank[y[i]] - 1
        while r > 0:
            if tree[r][1] >= 0 and tree[r][0] > best:
                best, j = tree[r]
            r -= r & -r
        gain = best - gap * (x[i] + y[i]) + 2 * gap * k if j >= 0 else 0.0
        if gain > 0:
            before[i] = j
            # overlapping seeds add only their new words
            score[i] = gain + min(k, x[i] - x[j], y[i] - y[j])
        else:
            score[i] = float(k)
        value, r = (score[i] + gap * (x[i] + y[i]), i), rank[y[i]]
        while r < len(tree):
            if tree[r][1] < 0 or value[0] > tree[r][0]:
                tree[r] = value
            r += r & -r
    out, used = [], [False] * len(x)
    for i in sorted(range(len(x)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences have in common from their starts on."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(n, at + step)
        other = np.flatnonzero(a[at:end] != b[at:end])
        if len(other):
            return at + int(other[0])
        at, step = end, step * 4
    return n


def _bridge(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int] | None:
    """The fewest words to skip on both sides so that ``k`` equal ones follow, or ``SHORT_RUN`` after as many words at most.

    Fewest by the longer side, then most on the shorter one, then more on the side of a.
    """
    wide = a.itemsize  # of b as well
    p, q = a[:BREAK + k].tobytes(), b[:BREAK + k].tobytes()
    for need, most in ((k * wide, BREAK * wide), (SHORT_RUN * wide, SHORT_RUN * wide)):
        left = [p[x:x + need] for x in range(0, min(most, len(p) - need) + 1, wide)]
        right = [q[y:y + need] for y in range(0, min(most, len(q) - need) + 1, wide)]
        if not set(left).isdisjoint(right):
            steps = [(x, y) for x, here in enumerate(left) for y, there in enumerate(right) if here == there and (x or y)]
            if steps:
                return min(steps, key=lambda s: (max(s), -min(s), s[0] < s[1]))
    return None


def extended(a: np.ndarray, b: np.ndarray, k: int = WORDS, similar: float = SIMILAR) -> tuple[int, int, int, list[tuple[int, int]]]:
    """How far two sequences run alike from their starts: words of each, equal words, and the runs (start and end in a) of equal ones.

    The end is the last equal word up to which the share of equal words is high enough.
    """
    i = j = equal = 0
    best, runs, kept = (0, 0, 0), [], 0
    while True:
        n = _alike(a[i:], b[j:])
        if n:
            runs.append((i, i + n))
            i, j, equal = i + n, j + n, equal + n
            if equal >= similar * max(i, j):
                best, kept = (i, j, equal), len(runs)
        step = _bridge(a[i:], b[j:], k)
        if step is None:
            return *best, runs[:kept]
        i, j = i + step[0], j + step[1]


def passages(a: np.ndarray, b: np.ndarray, xs: list[int], ys: list[int], k: int = WORDS, least: int = LEAST,
             similar: float = SIMILAR) -> list[tuple[int, int, int, int, float, list[tuple[int, int]]]]:
    """Passages along a chain of seeds at xs in a and ys in b: start and end in a, start and end in b, similarity, runs of ``least`` equal
    words or more (start and end in a)."""
    out = []
    end_a = end_b = 0  # of the passage before
    for x, y in zip(xs, ys, strict=True):
        if x < end_a or y < end_b or not np.array_equal(a[x:x + k], b[y:y + k]):
            continue
        da, db, before, left = extended(a[:x][::-1], b[:y][::-1], k, similar)
        fa, fb, after, right = extended(a[x:], b[y:], k, similar)
        sa, sb, ea, eb, equal = x - da, y - db, x + fa, y + fb, before + after
        end_a, end_b = ea, eb
        share = equal / max(ea - sa, eb - sb)
        if min(ea - sa, eb - sb) >= least and share >= similar:
            runs = [(x - q, x - p) for p, q in left[::-1]] + [(x + p, x + q) for p, q in right]
            joined: list[tuple[int, int]] = []
            for p, q in runs:
                if joined and joined[-1][1] == p == x:  # one run through the seed
                    joined[-1] = (joined[-1][0], q)
                else:
                    joined.append((p, q))
            out.append((sa, ea, sb, eb, share, [r for r in joined if r[1] - r[0] >= least]))
    return out


def _seeds(docs: DataFrame) -> DataFrame:
    """``seed, id, at`` of the documents ``docs(id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for first, words, sizes in hashed_together(b.column(1).to_pylist()):
                at, seeds, counts = seeds_together(words, sizes)
                ids = b.column(0).take(pa.array(np.repeat(np.arange(first, first + len(sizes)), counts)))
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), ids, pa.array(at.astype(np.int32))], ["seed", "id", "at"])

    return docs.mapInArrow(run, f"seed long, id {dict(docs.dtypes)['id']}, at int")


def _packed_words(docs: DataFrame) -> DataFrame:
    """``id, words``: 16 bits of each word's hash, two bytes a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for first, words, sizes in hashed_together(b.column(1).to_pylist()):
                packed = (words >> np.uint64(48)).astype("<u2").tobytes()
                ends = np.concatenate(([0], np.cumsum(2 * sizes))).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sizes)), column], ["id", "words"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, words binary")


def stretches_of(places: np.ndarray) -> np.ndarray:
    """For each of the sorted places, the first of its stretch."""
    first = np.concatenate(([True], np.diff(places) > APART))
    return places[np.flatnonzero(first)][np.cumsum(first) - 1]


def _in_stretches(shared: DataFrame) -> DataFrame:
    """``seed, id, at, first, home``: shared seeds with the first seed of their stretch, and whether the document is their representative."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if not b.num_rows:
                continue
            seeds, firsts, places, homes, counts = [], [], [], [], []
            for own in zip(b.column(1), b.column(2), b.column(3), strict=True):
                place, seed, home = (x.values.to_numpy(zero_copy_only=False) for x in own)
                order = np.argsort(place, kind="stable")
                places.append(place[order])
                seeds.append(seed[order])
                homes.append(home[order])
                firsts.append(stretches_of(place[order]))
                counts.append(len(order))
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds)), ids, pa.array(np.concatenate(places)), pa.array(np.concatenate(firsts)),
                                              pa.array(np.concatenate(homes))], ["seed", "id", "at", "first", "home"])

    per_document = shared.groupBy("id").agg(F.collect_list("at").alias("at"), F.collect_list("seed").alias("seed"), F.collect_list("home").alias("home"))
    return per_document.mapInArrow(run, f"seed long, id {dict(shared.dtypes)['id']}, at int, first int, home boolean")


def _chained(matches: DataFrame, seeds: int) -> DataFrame:
    """Chains of the pairs ``matches(id, first, other, other_first, xs, ys)``, all of a pair in one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            place, xs, ys = [], [], []
            for i, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                pairs = sorted({(p, q) for p, q in zip(x, y, strict=True)})
                x, y = [p for p, _ in pairs], [q for _, q in pairs]
                found = [chain for chain in chains(x, y) if len(chain) >= seeds]
                if found:
                    place.append(i)
                    xs.append([[x[c] for c in chain] for chain in found])
                    ys.append([[y[c] for c in chain] for chain in found])
            at, kind = pa.array(place, pa.int64()), pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in range(4)], pa.array(xs, kind), pa.array(ys, kind)],
                                             ["id", "first", "other", "other_first", "xs", "ys"])

    kind = dict(matches.dtypes)["id"]
    return matches.select("id", "first", "other", "other_first", "xs", "ys").mapInArrow(
        run, f"id {kind}, first int, other {kind}, other_first int, xs array<array<int>>, ys array<array<int>>")


_FOUND = "start long, end long, other_start long, other_end long, similarity double, runs array<int>"


def _aligned(fetched: DataFrame, least: int, similar: float) -> DataFrame:
    """Passages of ``fetched(id, first, other, xs, ys, a, b, a_from, b_from)``, whose words come once for all chains of a pair; ``runs`` has starts and ends of equal runs in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            place, rows = [], []
            cols = [batch.column(i).to_pylist() for i in range(3, 9)]
            for i, (xs, ys, a, b, a_from, b_from) in enumerate(zip(*cols, strict=True)):
                left, right = np.frombuffer(a, dtype="<u2"), np.frombuffer(b, dtype="<u2")
                for x, y in zip(xs, ys, strict=True):
                    for sa, ea, sb, eb, share, runs in passages(left, right, [p - a_from for p in x], [q - b_from for q in y], least=least, similar=similar):
                        place.append(i)
                        rows.append((sa + a_from, ea + a_from, sb + b_from, eb + b_from, share, [p + a_from for r in runs for p in r]))
            at = pa.array(place, pa.int64())
            parts = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(3)], *[pa.array(p, pa.int64()) for p in parts[:4]],
                                              pa.array(parts[4], pa.float64()), pa.array(parts[5], pa.list_(pa.int32()))],
                                             ["id", "first", "other", "start", "end", "other_start", "other_end", "similarity", "runs"])

    kind = dict(fetched.dtypes)["id"]
    return fetched.select("id", "first", "other", "xs", "ys", "a", "b", "a_from", "b_from").mapInArrow(run, f"id {kind}, first int, other {kind}, {_FOUND}")


def run_hashes(words: np.ndarray, least: int) -> np.ndarray:
    """A hash of every run of ``least`` words, which does not depend on where it stands."""
    n = len(words) - least + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    mixed = _mixed(words.astype(np.uint64) + np.uint64(1))
    prefix = np.concatenate(([np.uint64(0)], np.cumsum(mixed * _powers(_P, len(words)))))
    return _mixed((prefix[least:] - prefix[:-least]) * _powers(_P_INVERSE, len(words))[:n])


def open_places(words: np.ndarray, sizes: np.ndarray, spots: np.ndarray, foreign: np.ndarray, covered: tuple[np.ndarray, np.ndarray], least: int, own: bool
                ) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the open runs of some pieces, one piece after the other: ``words`` of so many words (``sizes``) each, the places of shared seeds and
    of those that have their representative elsewhere, starts and ends of covered runs (all as places in ``words``)."""
    hashes = run_hashes(words, least)
    n, shingles = len(hashes), least - WORDS + 1
    if not n:
        return np.empty(0, dtype=np.int64), hashes
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = np.flatnonzero((np.repeat(ends, sizes) - np.arange(len(words)))[:n] >= least)  # runs within one piece
    own_start = np.repeat(starts, sizes)
    elsewhere = np.zeros(len(words), dtype=np.int64)
    elsewhere[foreign] = 1
    # windows of shingles without a shared seed, by their first place
    seen = np.bincount(np.maximum(own_start[spots], spots - WINDOW + 1), minlength=len(words) + 1) - np.bincount(spots + 1, minlength=len(words) + 1)
    voids, others = (np.concatenate(([0], np.cumsum(x))) for x in (np.cumsum(seen)[:-1] == 0, elsewhere))
    begun, ended = (np.bincount(x, minlength=len(words) + 1) for x in covered)
    bare = np.cumsum(begun - ended) == 0
    mine = others[first + shingles] == others[first]
    found = first[bare[first] & (voids[first + shingles - WINDOW + 1] == voids[first]) & (mine if own else ~mine)]
    return found, hashes[found]


def _open_runs(pieces: DataFrame, least: int, own: bool) -> DataFrame:
    """``seed, id, at, first`` of the runs of ``pieces(id, first, from, piece, ats, homes, runs)`` that may be shared and that no run of equal words
    covers: those whose seeds all have their representative here if ``own``, else the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches):
            for one, last in _by_size(pc.binary_length(whole.column(3)).to_pylist()):
                b = whole.slice(one, last - one)
                texts = b.column(3).to_pylist()
                sizes = np.array([len(t) // 2 for t in texts], dtype=np.int64)
                starts = np.cumsum(sizes) - sizes
                shift = starts - b.column(2).to_numpy(zero_copy_only=False)  # from places in the document to places in the group
                spots = b.column(4).flatten().to_numpy(zero_copy_only=False) + np.repeat(shift, pc.list_value_length(b.column(4)).to_numpy(zero_copy_only=False))
                home = b.column(5).flatten().to_numpy(zero_copy_only=False).astype(bool)
                runs, row = b.column(6).flatten(), pc.list_parent_indices(b.column(6)).to_numpy(zero_copy_only=False)
                edges = runs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)  # starts and ends in turn
                row = np.repeat(row, pc.list_value_length(runs).to_numpy(zero_copy_only=False) // 2)
                low, high = starts[row], starts[row] + np.maximum(0, sizes[row] - least + 1)
                covered = np.clip(edges[::2] + shift[row], low, high), np.clip(edges[1::2] + shift[row] - least + 1, low, high)
                found, hashes = open_places(np.frombuffer(b"".join(texts), dtype="<u2"), sizes, spots, spots[~home], covered, least, own)
                place = np.searchsorted(starts + sizes, found, side="right")
                rows = pa.array(place)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), b.column(0).take(rows), pa.array((found - shift[place]).astype(np.int32)),
                                                  b.column(1).take(rows)], ["seed", "id", "at", "first"])

    rows = pieces.select("id", "first", "from", "piece", "ats", "homes", "runs")
    return rows.mapInArrow(run, f"seed long, id {dict(pieces.dtypes)['id']}, at int, first int")


def _pairs(found: DataFrame, homes: DataFrame, seeds: int) -> DataFrame:
    """Matches of ``found(seed, id, at, first, ...)`` with the first place of each seed in ``homes(seed, other)``, by pair of stretches."""
    found = found.select("seed", "id", "at", "first")
    home = found.join(homes.withColumnRenamed("other", "id"), ["seed", "id"]).groupBy("seed", "id").agg(F.min(F.struct("at", "first")).alias("home"))
    home = cut_and_free(home.select("seed", F.col("id").alias("other"), "home"))
    matches = found.join(home, "seed").where("id <> other").select("id", "first", "other", F.col("home.first").alias("other_first"), "at", F.col("home.at").alias("other_at"))
    pairs = matches.groupBy("id", "first", "other", "other_first").agg(F.collect_list("at").alias("xs"), F.collect_list("other_at").alias("ys"))
    return pairs.where(F.size("xs") >= seeds)


def _homes(found: DataFrame) -> DataFrame:
    """``seed, other``: the smallest document of each seed that several hold."""
    return found.groupBy("seed").agg(F.min("id").alias("other"), F.max("id").alias("last")).where("other <> last").select("seed", "other")


def _passages(chained: DataFrame, pieces: DataFrame, least: int, similar: float) -> DataFrame:
    a = pieces.select("id", "first", F.col("from").alias("a_from"), F.col("piece").alias("a"))
    b = pieces.select(F.col("id").alias("other"), F.col("first").alias("other_first"), F.col("from").alias("b_from"), F.col("piece").alias("b"))
    return _aligned(chained.join(a, ["id", "first"]).join(b, ["other", "other_first"]), least, similar)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, similar: float = SIMILAR,
                      seeds: int = SEEDS) -> DataFrame:
    """``id_col, start, end, other_id, other_start, other_end, similarity``: passages of a document (words start to end - 1) that an
    earlier document (smaller id) holds too. A passage of many documents is reported for all but the first."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    if _repeats(texts):
        one = texts.groupBy("id").agg(F.min(F.xxhash64("text")).alias("one"))
        texts = texts.join(one, "id").where(F.xxhash64("text") == F.col("one")).drop("one").dropDuplicates(["id"])
    found = _seeds(texts)
    first = cut_and_free(_homes(found))
    shared = cut_and_free(_in_stretches(found.join(first, "seed").select("seed", "id", "at", (F.col("id") == F.col("other")).alias("home"))))
    wanted = shared.groupBy("id", "first").agg((F.max("at") + WORDS + MARGIN).alias("to"), F.collect_list("at").alias("ats"), F.collect_list("home").alias("homes"))
    wanted = wanted.withColumn("from", F.greatest(F.lit(0), F.col("first") - MARGIN))
    wanted = wanted.where(F.col("to") - F.col("first") >= least - REACH + MARGIN - REACH)  # shorter ones hold no passage
    pieces = cut_and_free(_packed_words(texts).join(cut_and_free(wanted), "id").select(
        "id", "first", "from", "ats", "homes", F.expr("substring(words, `from` * 2 + 1, (`to` - `from`) * 2)").alias("piece")))

    near = cut_and_free(_passages(_chained(_pairs(shared, first, seeds), seeds), pieces, least, similar))
    covered = near.groupBy("id", "first").agg(F.collect_list("runs").alias("runs"))
    covered = pieces.join(covered, ["id", "first"], "left")
    asking = cut_and_free(_open_runs(covered, least, False))
    asked = asking.select("seed").distinct()
    held = _open_runs(covered, least, True).join(F.broadcast(asked) if asked.count() <= MANY_RUNS else asked, "seed", "left_semi")
    open_ = asking.unionByName(cut_and_free(held.select(*asking.columns)))
    rest = _passages(_chained(_pairs(open_, _homes(open_), 1), 1), pieces, least, similar)
    columns = ["id", "start", "end", "other", "other_start", "other_end", "similarity"]
    # chains of one pair may meet in a passage
    out = near.select(*columns).union(rest.select(*columns)).distinct()
    return out.select(F.col("id").alias(id_col), "start", "end", F.col("other").alias("other_id"), "other_start", "other_end", "similarity")


def _repeats(texts: DataFrame) -> bool:
    """Whether an id stands in more than one row."""
    return bool(texts.groupBy("id").count().where("count > 1").take(1))
