"""Quality rules as a short-circuit cascade.

A rule rejects a text by a few measures (word count, symbols, repeated lines, ...). A text goes when any rule rejects it, so the order of the
rules decides only what the verdict costs.

1. **Sample**: the first ``SAMPLE_ROWS`` texts of every input partition are judged by all rules inside the tasks, which time every measure. Only a
   row for each set of rejecting rules and the sum of times reach the driver.
2. **Order**: greedily, the rule with the most rejections among the sample texts left over, per second of the measures that it needs
   and that no earlier rule has taken. So rules that reject the same texts do not stand behind each other, and measures are shared.
3. **Cascade**: one pass over all texts; each is judged in that order until a rule rejects it. Measures that the caller wants reported are taken
   for every text and are free for the rules.

The sample decides about the order alone: the verdict of a text is the same for every order. ``failed_rule`` names the rule that stopped a
text, which depends on the measured order.

Edge cases: a null or empty text has no words, and fails the rule on word counts. Repeated rows and rows with equal ids are judged one by
one. Very long texts are read whole; tasks hold few texts at a time. An empty table gives an empty result. Columns other than id and text
are not read, so their names cannot clash.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import slices
from plumbline.session import ship_package

SAMPLE_ROWS = 64  # of each input partition
WINDOW = 5  # words that make a repeated window

_WHITE = b" \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(0x41, 0x5B))
_LETTERS = _CAPITALS + bytes(range(0x61, 0x7B))
_CONTINUES = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
_SYMBOLS = b"#*$%&|<>"
# a letter or a byte beyond ASCII becomes 1, white space a space, all else 0
_HAS_LETTER = bytes(1 if b in _LETTERS or b >= 0x80 else 0x20 if b in _WHITE else 0 for b in range(256))


class Measures:
    """Measures of one text, each taken at most once."""

    def __init__(self, text: str | None) -> None:
        self.text = (text or "").encode("utf-8", "replace")
        self._known: dict = {}

    def __getitem__(self, name: str):
        if name not in self._known:
            self._known[name] = MEASURES[name](self)
        return self._known[name]


def _repeated_words(m: Measures) -> int:
    """Words that lie in a window of five words found twice or more in the text."""
    words = m["words"]
    if len(words) <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers for the pairs, alike where the pairs are."""
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    two = joined(own[:-1], own[1:])
    four = joined(two[:-2], two[2:])
    five = joined(four[:-1], own[4:])
    twice = np.flatnonzero(np.bincount(five)[five] > 1)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + WINDOW, -1)
    return int((np.cumsum(marks) > 0).sum())


def _lines(m: Measures) -> list[bytes]:
    return [line for line in m.text.split(b"\n") if line.strip(_WHITE)]


MEASURES: dict[str, Callable[[Measures], object]] = {
    "words": lambda m: m.text.split(),
    "lines": _lines,
    "n_words": lambda m: len(m["words"]),
    "word_chars": lambda m: len(m.text.translate(None, _WHITE + _CONTINUES)),
    "n_symbols": lambda m: sum(map(m.text.count, (bytes([b]) for b in _SYMBOLS))),
    "n_lines": lambda m: len(m["lines"]),
    "n_dup_lines": lambda m: len(m["lines"]) - len(set(m["lines"])),
    "n_repeat_words": _repeated_words,
    "n_letters": lambda m: len(m.text) - len(m.text.translate(None, _LETTERS)),
    "n_capitals": lambda m: len(m.text) - len(m.text.translate(None, _CAPITALS)),
    "n_letter_words": lambda m: sum(b"\x01" in w for w in m.text.translate(_HAS_LETTER).split(b" ")),
    "n_cut_lines": lambda m: sum(line.rstrip(_WHITE).endswith((b"...", "…".encode())) for line in m["lines"]),
    "n_list_lines": lambda m: sum(line.lstrip(_WHITE).startswith((b"-", b"*", "•".encode())) for line in m["lines"]),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` sees the measures it names, in that order."""

    name: str
    measures: tuple[str, ...]
    rejects: Callable[..., bool]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 20 * n),
)
RULES = BASE_RULES + (
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 3 * n),
    Rule("short_or_long_words", ("word_chars", "n_words"), lambda c, n: not 2 * n <= c <= 12 * n),
    Rule("capitals", ("n_capitals", "n_letters"), lambda c, n: 2 * c > n),
    Rule("words_without_letters", ("n_letter_words", "n_words"), lambda k, n: 10 * k < 7 * n),
    Rule("cut_lines", ("n_cut_lines", "n_lines"), lambda c, n: 10 * c > 3 * n),
    Rule("lists", ("n_list_lines", "n_lines"), lambda c, n: 10 * c > 9 * n),
)


def _rejects(rule: Rule, m: Measures) -> bool:
    return rule.rejects(*[m[x] for x in rule.measures])


# measures that others are made from
_PARTS = {"n_words": "words", "n_repeat_words": "words", "n_lines": "lines", "n_dup_lines": "lines", "n_cut_lines": "lines", "n_list_lines": "lines"}


def _with_parts(names: Sequence[str]) -> set[str]:
    return set(names) | {_PARTS[x] for x in names if x in _PARTS}


def measure_sample(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[dict[frozenset[str], int], dict[str, float]]:
    """How many sample texts each set of rules rejects, and the seconds that each measure took in the sample."""
    own = _with_parts([x for r in rules for x in r.measures])
    needs = [x for x in MEASURES if x in own]  # parts stand first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, sets, seconds = rows, Counter(), dict.fromkeys(needs, 0)
        for b in slices(batches):
            for text in b.column(0).slice(0, left).to_pylist():
                m = Measures(text)
                for x in needs:
                    start = time.perf_counter_ns()
                    m[x]
                    seconds[x] += time.perf_counter_ns() - start
                sets[",".join(r.name for r in rules if _rejects(r, m))] += 1
            left -= b.num_rows
            if left <= 0:
                break
        out = [("set", k, v) for k, v in sets.items()] + [("time", k, v) for k, v in seconds.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()),
                                          pa.array([r[2] for r in out], pa.int64())], ["kind", "name", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "kind string, name string, n long").groupBy("kind", "name").agg(F.sum("n").alias("n")).collect()
    sets = {frozenset(filter(None, r["name"].split(","))): r["n"] for r in found if r["kind"] == "set"}
    return sets, {r["name"]: r["n"] / 1e9 for r in found if r["kind"] == "time"}


def ordered(rules: Sequence[Rule], sets: dict[frozenset[str], int], seconds: dict[str, float], free: Sequence[str] = ()) -> list[Rule]:
    """The rules by rejections among the texts left over per second of measures not yet taken; ``free`` measures cost nothing."""
    taken, left, out, todo = _with_parts(free), dict(sets), [], list(rules)
    while todo:
        def worth(r: Rule) -> float:
            cost = sum(seconds.get(x, 0.0) for x in _with_parts(r.measures) - taken)
            return sum(n for s, n in left.items() if r.name in s) / (cost + 1e-9)

        best = max(todo, key=worth)  # of equal ones the first in the list
        todo.remove(best)
        out.append(best)
        taken |= _with_parts(best.measures)
        left = {s: n for s, n in left.items() if best.name not in s}
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", report: Sequence[str] = (),
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id_col``, the measures in ``report`` (long), ``kept``, ``failed_rule`` of every row."""
    ship_package(docs.sparkSession)
    order = ordered(rules, *measure_sample(docs, rules, text_col, sample_rows), free=report)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            reported, failed = [], []
            for text in b.column(1).to_pylist():
                m = Measures(text)
                reported.append([m[x] for x in report])
                failed.append(next((r.name for r in order if _rejects(r, m)), None))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([r[i] for r in reported], pa.int64()) for i in range(len(report))],
                 pa.array([f is None for f in failed], pa.bool_()), pa.array(failed, pa.string())], [id_col, *report, "kept", "failed_rule"])

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    measures = "".join(f"`{x}` long, " for x in report)
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, {measures}kept boolean, failed_rule string")
