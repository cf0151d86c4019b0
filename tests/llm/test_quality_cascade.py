"""Quality rules against plain Python, and the order of the cascade."""

from __future__ import annotations

import re

from llm_fixtures import empty, odd, odd_rows, plain

from plumbline.llm import quality_cascade
from plumbline.llm.quality_cascade import RULES, Measures, Rule, judge, ordered

REPORT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else set(windows)
    inside = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


TEXTS = [None, "", " \n ", "a b c d e", "a b c d e a b c d e", "a b c d e x a b c d e x a b c d", "one two\none two\n\n \none two ", "é ü ñ 日本", "#$ a|b <x> & * %",
         "x\x0by\x0cz\r\nw", "a a a a a a a a", "no\x1cbreak here", "a\tb  c\n" * 30, "line one\nline one\nline two"]


def test_measures():
    for text in TEXTS:
        m = Measures(text)
        assert tuple(m[x] for x in REPORT) == slow(text), text
    m = Measures("Ends...\nGoes on…\n- list\n • list\n*x\n12 34 !? É9")
    assert [m[x] for x in ("n_lines", "n_cut_lines", "n_list_lines", "n_letter_words", "n_capitals", "n_letters")] == [6, 2, 3, 8, 2, 19]  # a character beyond ASCII passes for a letter


def test_rows(spark):
    found = plain(judge(odd(spark), report=REPORT), "doc_id", *REPORT)
    assert found == sorted([(r[0], *slow(r[1])) for r in odd_rows()], key=lambda r: [(v is not None, v) for v in r])
    assert judge(empty(spark)).count() == 0 and judge(empty(spark), report=REPORT).columns == ["doc_id", *REPORT, "kept", "failed_rule"]


def test_verdict_needs_every_rule(spark):
    good = "The wind came over the hill and all the trees along the river bent down to listen."
    bad = ["few words", "STOP SHOUTING AT ALL THE PEOPLE WHO COME HERE TO READ THINGS", "a# b# c# d# e# f# g# h# i# j# k#", "one two three four five " * 9,
           "1 2 3 4 5 6 7 8 9 10 11 12 x y", "x y z w a b c d e f g h i j", "what now...\nand then...\nmore of it...\nand so on here..."]
    docs = spark.createDataFrame(list(enumerate([good, *bad, good + "\n" + good[:20]])), "doc_id int, text string")
    kept = [r[0] for r in plain(judge(docs).where("kept"))]
    assert kept == [0, len(bad) + 1]
    why = {r["doc_id"]: r["failed_rule"] for r in judge(docs).collect()}
    assert why[0] is None and all(why[i + 1] in {r.name for r in RULES} for i in range(len(bad)))
    for order in (RULES, RULES[::-1]):  # the verdict does not hang on the order
        assert [r[0] for r in plain(judge(docs, order).where("kept"))] == kept


def test_sample_and_order(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c"] * 30 + ["many different words stand in this plain and harmless line of text"] * 20)],
                                 "doc_id int, text string").repartition(2)
    sets, seconds = quality_cascade.measure_sample(docs, RULES, rows=1000)
    assert sum(sets.values()) == 50 and sum(n for s, n in sets.items() if "few_words" in s) == 30
    assert seconds["words"] > 0 and set(seconds) >= {m for r in RULES for m in r.measures}
    few, _ = quality_cascade.measure_sample(docs, RULES, rows=3)
    assert sum(few.values()) == 6

    cheap, dear, twin = Rule("cheap", ("n_lines",), bool), Rule("dear", ("n_repeat_words",), bool), Rule("twin", ("n_symbols",), bool)
    cost = {"lines": 0.1, "n_lines": 0.0, "words": 1.0, "n_repeat_words": 9.0, "n_symbols": 0.2}
    hits = {frozenset({"cheap", "twin"}): 50, frozenset({"dear"}): 60, frozenset(): 100}
    # twin rejects what cheap has rejected already, so it comes after dear though it costs less
    assert [r.name for r in ordered([twin, dear, cheap], hits, cost)] == ["cheap", "dear", "twin"]
    assert [r.name for r in ordered([twin, dear, cheap], hits, cost, free=["n_repeat_words"])][0] == "dear"
