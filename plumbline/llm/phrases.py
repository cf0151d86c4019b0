"""Phrase collocations by dynamic itemset counting.

A phrase is a run of words inside a piece of a text; pieces end at punctuation or a line break. Counts are per language.

The texts are dealt once, chunk by chunk, to ``SHARDS`` shards, which are scanned in a cycle. Words are counted from the first step on. A phrase of
two words or more becomes active in the step after both its subphrases (all but the last word, all but the first) have reached the threshold
with what has been counted so far, and is then counted for exactly one cycle, whichever shard that begins with. So lengths overlap:
while late words still wait for their cycle to end, pairs and triples of early ones are counted already. Scanning ends when a whole cycle
has brought no phrase to the threshold that a longer one could follow.

* **Texts are split once** and stored as chunks: the different words of a chunk, and its words as numbers. After the words' own cycle a shard's chunks
  are stored again without the words that stayed below the threshold.
* **A step** is one Spark job over one shard. Tasks look up in which step each subphrase reached the
  threshold, and count active phrases exactly (by words, not by hashes); Spark sums the chunks' counts by phrase. The sums of a
  step are stored and never merged or moved again.
* **Reaching the threshold**: a phrase that has it after a cycle of s shards has at least its s-th part in one of them. Only such phrases are summed
  over the stored steps; the many rare ones are not shuffled a second time.
* **What tasks look up** is a sorted array of (hash, step), broadcast: 5 bytes for each phrase that has reached the threshold. The hash
  is cut to ``HASH_BITS`` bits, so the array is bounded by 2^HASH_BITS entries a length whatever the input. A collision makes a phrase active
  without need or sooner; it is still counted by its words for one whole cycle, so no count changes.

A score compares a phrase with the two parts of its cheapest cut; 128-bit products are made with decimals of 38 digits.

Edge cases: a null or empty text has no word; a null language is ``und`` (and is counted with rows that say so). Repeated rows count as often as they
occur; ids are not read. Very long texts are cut into chunks that overlap by four words, a phrase belonging to the chunk in which it starts. An
empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.sizing import small
from plumbline.llm.batches import slices
from plumbline.llm.stored import new_folder, stored
from plumbline.session import ship_package

LONGEST = 5  # words of a phrase
THRESHOLD = 100
SHARDS = 3
TOP = 2000
HASH_BITS = 24
CHUNK_WORDS = 1 << 20  # words that a task holds as numbers at once
MANY_PHRASES = 1 << 20  # rows of a broadcast join side (one long each) at most
NEVER = 255  # step of a phrase that has not reached the threshold
_FIRST_BITS = 20  # of a hash, looked up in a table of bytes
NULL_LANG = "und"

# A-Z becomes a-z; . , ; : ! ? and line breaks become 0xFF, which no UTF-8 text holds; what splits words besides is space and tab
_BREAK = b"\xff"
_PLAIN = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, so that places of words count in a phrase's hash
_LONG_TEXT = 1 << 22  # bytes of a text that are split into words at once


def _words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in lists, 0xFF where a piece ends."""
    plain = (text or "").encode("utf-8", "replace").translate(_PLAIN)
    start = 0
    while start < len(plain):
        end = start + _LONG_TEXT
        if end < len(plain):  # between words, if there is a place
            end = max(plain.rfind(b" ", start, end), plain.rfind(b"\t", start, end), plain.rfind(_BREAK, start, end)) + 1 or end
            if end <= start or plain[end - 1] not in b" \t\xff":
                found = [p for p in (plain.find(c, start) for c in (b" ", b"\t", _BREAK)) if p >= 0]
                end = min(found, default=len(plain) - 1) + 1
        yield plain[start:end].replace(_BREAK, b" \xff ").split()
        start = end


class _Numbers(dict):
    """Numbers of the words of one language, given out on demand."""

    def __init__(self, words: list[bytes], of: list[int], lang: int) -> None:
        self.words, self.of, self.lang = words, of, lang
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self.of.append(self.lang)
        self[word] = number = len(self.words)
        return number


class _Builder:
    """Consecutive words of some texts as numbers from 1; 0 ends a piece."""

    def __init__(self) -> None:
        self.langs: dict[str, _Numbers] = {}
        self.words: list[bytes] = []
        self.of: list[int] = []  # the language of each word, by number
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        if lang not in self.langs:
            self.langs[lang] = _Numbers(self.words, self.of, len(self.langs))
        self.parts.append(np.fromiter(map(self.langs[lang].__getitem__, words), dtype=np.int32, count=len(words)))
        self.size += len(words)

    def end_text(self) -> None:
        self.parts.append(np.zeros(1, dtype=np.int32))
        self.size += 1

    def tail(self, n: int) -> list[tuple[str, bytes]]:
        """The last words with their language, 0xFF where a piece ends."""
        names = list(self.langs) or [NULL_LANG]
        return [(names[self.of[i - 1]], self.words[i - 1]) if i else (names[0], _BREAK) for i in np.concatenate(self.parts)[-n:].tolist()]


@dataclass
class Chunk:
    """Consecutive words as numbers; the words of number i stand at place i - 1 of ``words``, 0 ends a piece."""

    langs: list[str]
    words: pa.Array  # strings
    of: np.ndarray  # the language of each word, by place
    ids: np.ndarray
    starts: int  # phrases start at so many places; the words after them only go on with phrases


def _hashes(chunk: Chunk) -> np.ndarray:
    """A hash of each word with its language, by number; place 0 is the break."""
    seeds = [xxhash.xxh64_intdigest(lang) for lang in chunk.langs]
    digest = xxhash.xxh64_intdigest
    return np.array([0] + [digest(w, seeds[k]) for w, k in zip(chunk.words.cast(pa.binary()).to_pylist(), chunk.of.tolist(), strict=True)], dtype=np.uint64)


def phrase_hash(lang: str, words: list[bytes], bits: int = HASH_BITS) -> int:
    """The hash of a phrase, as :func:`_counted` finds it."""
    out = 0
    for w in words:
        out = (out * int(_FACTOR) + xxhash.xxh64_intdigest(w, xxhash.xxh64_intdigest(lang))) & 0xFFFFFFFFFFFFFFFF
    return out >> (64 - bits)


def _steps_of(reached: dict[int, tuple[np.ndarray, np.ndarray]], length: int, hashes: np.ndarray, bits: int) -> np.ndarray:
    """The step in which each phrase of ``length`` words reached the threshold."""
    out = np.full(len(hashes), NEVER, dtype=np.uint8)
    keys, steps = reached.get(length, (np.empty(0, np.int32), np.empty(0, np.uint8)))
    if not len(keys):
        return out
    short = (hashes >> np.uint64(64 - bits)).astype(np.int32)
    # most phrases have not, which their first bits tell without a search
    less = max(0, bits - _FIRST_BITS)
    seen = np.zeros(1 << (bits - less), dtype=bool)
    seen[keys >> less] = True
    some = np.flatnonzero(seen[short >> less])
    short = short[some]
    at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
    out[some] = np.where(keys[at] == short, steps[at], np.uint8(NEVER))
    return out


def _alike(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A number for each different phrase of ``length`` words that starts at the places ``at``."""
    wide = int(ids.max()).bit_length()
    code, used = ids[at], wide
    for j in range(1, length):
        if used + wide > 62:  # numbers of so many phrases take fewer bits than their words
            code = pa.array(code).dictionary_encode().indices.to_numpy().astype(np.int64)
            used = len(code).bit_length()
        code, used = code << wide | ids[at + j], used + wide
    return pa.array(code).dictionary_encode().indices.to_numpy()


def _counted(chunk: Chunk, step: int, shards: int, reached: dict[int, tuple[np.ndarray, np.ndarray]], bits: int
             ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``length, words, counts`` of the phrases that are active in ``step`` and start in the chunk."""
    ids, starts = chunk.ids, chunk.starts
    if step < shards:
        count = np.bincount(ids[:starts], minlength=len(chunk.words) + 1)
        count[0] = 0
        some = np.flatnonzero(count)
        yield 1, some[:, None], count[some]
    if 1 not in reached:
        return
    own = _hashes(chunk)

    # a phrase is never held to have reached the threshold before it was active, which a collision could make believe
    by_word = _steps_of(reached, 1, own, bits)
    by_word[0] = NEVER
    since = by_word[ids]  # step in which the phrase that starts here reached the threshold
    places = np.flatnonzero(since < NEVER)  # starts of phrases of the present length that have
    hashes = own[ids[places]]
    since = since[places]
    for length in range(2, LONGEST + 1):
        if not len(places):
            return
        # the phrase without its first word must be there too
        first = np.flatnonzero(places[1:] == places[:-1] + 1)
        active = np.maximum(since[first], since[first + 1]) + np.uint8(1)
        if active.size and int(active.max()) > step:
            first = first[active <= step]
            active = active[active <= step]
        places = places[first]
        hashes = hashes[first] * _FACTOR + own[ids[places + (length - 1)]]
        now = places[(active > step - shards) & (places < starts)]
        if len(now):
            mine = _alike(ids, now, length)
            count = np.bincount(mine)
            at = np.zeros(len(count), dtype=np.int64)
            at[mine] = now  # any place of a phrase tells its words
            yield length, ids[at[:, None] + np.arange(length)], count
        since = np.maximum(_steps_of(reached, length, hashes, bits), active)
        known = np.flatnonzero(since < NEVER)
        places, hashes, since = places[known], hashes[known], since[known]


_ENCODED = "shard int, langs array<string>, words array<string>, sizes array<int>, places long, starts long, ids binary"
_ROW = pa.schema([("shard", pa.int32()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())),
                  ("places", pa.int64()), ("starts", pa.int64()), ("ids", pa.binary())])


def _row(shard: int, chunk: Chunk) -> pa.RecordBatch:
    """A chunk as one row: words by language, numbers compressed."""
    order = np.argsort(chunk.of, kind="stable")
    number = np.zeros(len(order) + 1, dtype=np.int32)
    number[order + 1] = np.arange(1, len(order) + 1)
    words = chunk.words.take(pa.array(order))
    sizes = np.bincount(chunk.of, minlength=len(chunk.langs)).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array([shard], pa.int32()), pa.array([chunk.langs], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
        pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([len(chunk.ids)], pa.int64()), pa.array([chunk.starts], pa.int64()),
        pa.array([pa.compress(number[chunk.ids].astype("<i4").tobytes(), codec="zstd", asbytes=True)], pa.binary())], schema=_ROW)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    """The chunks that :func:`_row` made, with their shard."""
    for b in slices(batches, 1):
        if b.num_rows:
            shard, langs, sizes, places, starts, ids = (b.column(i)[0].as_py() for i in (0, 1, 3, 4, 5, 6))
            numbers = np.frombuffer(pa.decompress(ids, places * 4, codec="zstd"), dtype="<i4").astype(np.int64)
            yield shard, Chunk(langs, b.column(2)[0].values, np.repeat(np.arange(len(langs)), sizes), numbers, starts)


def encode(rows: DataFrame, shards: int, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The texts of ``rows(lang, text)`` as chunks, dealt to the shards in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder, turn = _Builder(), TaskContext.get().partitionId()

        def row(starts: int) -> pa.RecordBatch:
            words = pa.array(builder.words, pa.binary()).cast(pa.string())
            return _row(turn % shards, Chunk(list(builder.langs), words, np.array(builder.of, dtype=np.int64), np.concatenate(builder.parts), starts))

        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for words in _words(text):
                    for at in range(0, len(words), chunk_words):
                        builder.add(lang, words[at:at + chunk_words])
                        if builder.size >= max(chunk_words, LONGEST):
                            # the last words may start phrases that go on: they open the next chunk
                            yield row(builder.size - (LONGEST - 1))
                            tail = builder.tail(LONGEST - 1)
                            builder, turn = _Builder(), turn + 1
                            for own, word in tail:
                                builder.add(own, [word])
                builder.end_text()
        if builder.size:
            yield row(builder.size)

    return rows.select("lang", "text").mapInArrow(run, _ENCODED)


def without_rare_words(shard: DataFrame, reached: dict[int, tuple[np.ndarray, np.ndarray]], bits: int = HASH_BITS) -> DataFrame:
    """The chunks of a shard once the words' cycle is complete: words below the threshold end a piece, words without a neighbour go."""
    shared = shard.sparkSession.sparkContext.broadcast(reached)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, c in _chunks(batches):
            often = _steps_of(shared.value, 1, _hashes(c), bits) < NEVER
            often[0] = False
            here = often[c.ids]
            here &= np.concatenate((here[1:], [False])) | np.concatenate(([False], here[:-1]))
            keep = here | np.concatenate(([False], here[:-1]))  # of several breaks in a row one stays
            ids = np.where(here, c.ids, 0)[keep]
            if not len(ids):
                continue
            used = np.flatnonzero(np.bincount(ids, minlength=len(often))[1:]) + 1
            number = np.zeros(len(often), dtype=np.int64)
            number[used] = np.arange(1, len(used) + 1)
            yield _row(own, Chunk(c.langs, c.words.take(pa.array(used - 1)), c.of[used - 1], number[ids], int(keep[:c.starts].sum())))

    return shard.mapInArrow(run, _ENCODED)


def count_shard(shard: DataFrame, step: int, shards: int, reached: dict[int, tuple[np.ndarray, np.ndarray]], bits: int = HASH_BITS) -> DataFrame:
    """``lang, phrase, words, f``: the counts of the active phrases in the chunks of a shard."""
    shared = shard.sparkSession.sparkContext.broadcast(reached)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in _chunks(batches):
            langs = pa.array(chunk.langs, pa.string())
            for length, numbers, counts in _counted(chunk, step, shards, shared.value, bits):
                columns = [chunk.words.take(pa.array(numbers[:, i] - 1)) for i in range(length)]
                text = columns[0] if length == 1 else pc.binary_join_element_wise(*columns, " ")
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(chunk.of[numbers[:, 0] - 1])), text, pa.array(np.full(len(counts), length, dtype=np.int32)),
                                                  pa.array(counts.astype(np.int64))], ["lang", "phrase", "words", "f"])

    found = shard.mapInArrow(run, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def _key() -> Column:
    return F.xxhash64("lang", "phrase")


def _holding(counts: DataFrame, phrases: DataFrame) -> DataFrame:
    """The rows of ``counts`` whose phrase is in ``phrases``, and a few that share a hash with one."""
    keys = phrases.select(_key().alias("key")).distinct()
    if phrases.count() <= MANY_PHRASES:
        keys = F.broadcast(keys)
    return counts.withColumn("key", _key()).join(keys, "key", "left_semi").drop("key")


def _hash_steps(new: DataFrame, step: int, reached: dict[int, tuple[np.ndarray, np.ndarray]], bits: int) -> bool:
    """Adds the hashes of the phrases that got to the threshold in ``step``; a hash keeps its first step. Whether there were any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes = [phrase_hash(lang, phrase.encode().split(b" "), bits) for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(hashes, pa.int32())], ["words", "hash"])

    found = new.where(F.col("words") < LONGEST).select("lang", "phrase", "words").mapInArrow(run, "words int, hash int").distinct().toArrow()
    lengths, hashes = found.column(0).to_numpy(), found.column(1).to_numpy()
    for length in np.unique(lengths).tolist():
        keys, steps = reached.get(length, (np.empty(0, np.int32), np.empty(0, np.uint8)))
        fresh = np.setdiff1d(hashes[lengths == length].astype(np.int32), keys)
        both, own = np.concatenate([keys, fresh]), np.concatenate([steps, np.full(len(fresh), step, dtype=np.uint8)])
        order = np.argsort(both)
        reached[length] = (both[order], own[order])
    return len(hashes) > 0


def frequencies(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = THRESHOLD, shards: int = SHARDS,
                bits: int = HASH_BITS, chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of every phrase of 1 to 5 words with ``f >= threshold``, and ``lang, n``, the words of each language."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = new_folder(spark, "phrases")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NULL_LANG)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    encode(rows, shards, chunk_words).write.parquet(f"{folder}/chunks", partitionBy="shard", compression="zstd")
    stored_chunks = spark.read.schema(_ENCODED).parquet(f"{folder}/chunks")
    reached: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    deltas, newly, large = [], [], []
    step, last = 0, -1
    columns = ["shard", "langs", "words", "sizes", "places", "starts", "ids"]
    shard = {s: stored_chunks.where(F.col("shard") == s).select(*columns) for s in range(shards)}
    while step < shards or last >= step - shards:
        now = step % shards
        if step >= shards and step < 2 * shards:
            shard[now] = stored(without_rare_words(shard[now], reached, bits), f"{folder}/frequent-{now}")
        counted = count_shard(shard[now], step, shards, reached, bits)
        deltas.append(stored(counted, f"{folder}/counts-{step}"))
        large.append(stored(deltas[-1].where(F.col("f") * shards >= threshold).select("lang", "phrase"), f"{folder}/large-{step}"))
        # phrases counted in this step have all their counts in the last steps
        recent = _union([d.withColumn("step", F.lit(s)) for s, d in list(enumerate(deltas))[-shards:]])
        often = _union(large[-shards:])
        sums = _holding(recent, often).groupBy("lang", "phrase", "words").agg(
            F.sum("f").alias("f"), F.sum(F.when(F.col("step") == step, F.col("f")).otherwise(0)).alias("now"))
        new = stored(sums.where((F.col("f") >= threshold) & (F.col("f") - F.col("now") < threshold)).select("lang", "phrase", "words"), f"{folder}/reached-{step}")
        newly.append(new)
        if _hash_steps(new, step, reached, bits):
            last = step
        step += 1
    everything = _union(deltas)
    found = _holding(everything, _union(newly).select("lang", "phrase")).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    totals = _union(deltas[:shards]).where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))  # words are counted in the first cycle
    return stored(found.where(F.col("f") >= threshold), f"{folder}/frequencies"), stored(totals, f"{folder}/totals")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = THRESHOLD, top: int = TOP, shards: int = SHARDS,
                 bits: int = HASH_BITS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by the score of their cheapest cut.

    A phrase of which every occurrence lies inside a longer candidate is left out.
    """
    found, totals = frequencies(docs, text_col, lang_col, threshold, shards, bits, chunk_words)
    parts = F.split("phrase", " ")
    longer = found.where("words > 1").withColumn("parts", parts)

    def piece(start: Column | int, length: Column | int) -> Column:
        return F.array_join(F.slice("parts", start, length), " ")

    # what all words of a phrase lie in, one word longer: a still longer one with as many places makes this one as frequent
    around = longer.where("words > 2").select("lang", F.explode(F.array(piece(1, F.col("words") - 1), piece(2, F.col("words") - 1))).alias("phrase"),
                                              F.col("f").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = longer.join(around, ["lang", "phrase"], "left").where("around is null or around < f").drop("around")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", piece(1, F.col("cut")).alias("first"), piece(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("rest"))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(small(totals), "lang")
    cuts = cuts.withColumn("over", (_wide("a") * _wide("n") * 1000).cast("decimal(38,0)")).withColumn("under", _wide("l") * _wide("r"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", place).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
