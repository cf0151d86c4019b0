"""Operators that work row by row: license scan and HTML text."""

from __future__ import annotations

import re
import time

import numpy as np
from llm_fixtures import DDL, empty, odd, odd_rows, plain

from plumbline.llm import html_text, license_scan


def slow_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def unfiltered(words):
    """Detections without the keyword prefilter, then suppression by comparing all with all."""
    found = [(m.start(), m.end(), r) for r in license_scan.rules() for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])".encode(), words)]
    order = sorted(found, key=lambda d: (d[2].priority, d[0] - d[1], d[0]))
    kept = []
    for d in order:
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    return sorted((a, b, r.label) for a, b, r in kept)


TEXTS = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0. All rights reserved.",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later",
    "Copyright (c) 2020 A. ALL RIGHTS RESERVED. all rights reserved", "cc by cc-by CC BY", "the submit button permits nothing, accuracy by design",
    "see https://opensource.org/licenses/MIT for details", "Creative Commons Attribution-ShareAlike 4.0", "tous droits réservés", "Dual: GPL v2 or MPL 2.0",
    "Neither the name of Foo nor the names of its contributors", "ccé by", "x" * 50_000 + " general public license",
]


def test_base_and_rules():
    assert len(license_scan.rules()) > 300
    for text in [*TEXTS, None, "", " "]:
        found = license_scan.scan_text(text)
        assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"], found["base_labels"]) == slow_base(text)
        assert set(filter(None, found["base_labels"].split(","))) <= set(filter(None, found["labels"].split(",")))
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        joined = b" ".join(words)
        assert sorted((a, b, r.label) for a, b, r in license_scan.detect(joined)) == unfiltered(joined)
    labels = [license_scan.scan_text(t)["labels"] for t in TEXTS]
    assert labels[:5] == ["mit", "apache-2.0", "cc-by,cc-by-nc-4.0,reserved", "gpl,gpl-3.0", "lgpl-2.1"]
    assert labels[7] == "" and labels[11] == "gpl-2.0,mpl-2.0"


def test_scan_rows(spark):
    found = plain(license_scan.scan(odd(spark)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert found == sorted([(r[0], *slow_base(r[1])) for r in odd_rows()], key=lambda r: [(v is not None, v) for v in r])
    assert license_scan.scan(empty(spark)).count() == 0


ARTICLE = "<h1>Title &amp; more</h1><p>First   paragraph with\n words.<p>Bold <b>in</b>side, <i>open</p><p>Is.</p><ul><li>item one<li>item two</ul>"
WANT = "Title & more First paragraph with words. Bold inside, open Is. item one item two"
LONG_P = "<p>" + "A long text of a page that goes on and on with many words. " * 5 + "</p>"


def test_main_text():
    frame = ("<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav>"
             "<div class='ad'>Buy this product now, it is really good and cheap.</div>{}<footer>&copy; all</footer></body></html>")
    assert html_text.main_text(frame.format(f"<article>{ARTICLE}</article>")) == WANT
    assert html_text.main_text(frame.format(f"<div id=content>{ARTICLE}{LONG_P}</div><aside>{LONG_P}</aside><div class='comments'>{LONG_P}</div>"
                                            "<form>Mail <input><button>Go</button></form><header>Top</header>")).startswith(WANT)
    assert html_text.main_text(frame.format(f"<main>{LONG_P}<section>{LONG_P}</section></main><div>{LONG_P}</div>")).count("A long text") == 10
    for text in [None, "", "<p></p>", "<nav>only menu</nav>", "<script>x</script>"]:
        assert html_text.main_text(text) == ""
    assert html_text.main_text("just words &lt;here&gt;") == "just words <here>"
    deep = "<div>" * 3000 + "text in the deep" + "</div>" * 3000
    assert html_text.main_text(deep) == "text in the deep"
    assert len(html_text.main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>")) == 20_000 * 10 - 1


def test_classes_strike_parts_and_not_wrappers():
    def page(body):
        return html_text.main_text(f"<body>{body}</body>")
    want = " ".join([LONG_P[3:-4].strip()])
    assert page(f'<div class="content with-sidebar">{LONG_P}<div class="sidebar">no</div></div>') == want
    assert page(f'<div class="site has-sidebar"><div id="side-bar">no</div>{LONG_P}</div>') == want
    assert page(f'<div class="page-header">no</div><article><div class="entry-header"><h1>Head</h1></div>{LONG_P}</article>') == "Head " + want
    assert page(f'<div class="comments-enabled"><article>{LONG_P}</article><div class="comments">{LONG_P}</div></div>') == want
    assert page(f'<main>{LONG_P}<div class="more-stories"><p>Other things to read</p></div><div class="newsletterBox">no</div></main>') == want
    assert page(f'<article>{LONG_P}<div class="notice">no</div><button>no</button></article>') == want


def test_the_cluster_decides_inside_the_region():
    links = "".join(f"<li><a href=x>Link number {i}</a></li>" for i in range(30))
    for region in ("article", "main"):
        text = html_text.main_text(f"<{region}>{LONG_P}<p>Is.</p><p><a href=y>One link.</a></p>{LONG_P}<ul>{links}</ul>{LONG_P}</{region}>")
        assert "Link number" not in text and text.count("A long text") == 15 and "Is. One link." in text


def test_work_grows_with_the_length_alone():
    for page in ["<b>" * 200_000, "<div>" * 200_000, "<p><i>" + "<b>" * 100_000 + "</i>" * 100_000, "<li><p>" * 100_000, "<a>" * 1000 + "</p>" * 100_000,
                 "<table><tr><td>" * 50_000]:
        start = time.perf_counter()
        assert html_text.main_text(page + "word") == "word"
        assert time.perf_counter() - start < 15


def test_long_texts_are_scanned_in_step():
    text = "Licensed under the MIT license, and the GNU General Public License. CC BY 4.0, all rights reserved. "
    start = time.perf_counter()
    found = license_scan.scan_text(text * 10_000)
    assert time.perf_counter() - start < 30 and found["n_base"] == 30_000 and len(found["spans"]) >= 20_000


def test_smoothing_is_gaussian():
    x = np.array([0.0, 0, 1, 0, 0, 0, 5])
    kernel = {d: np.exp(-d * d / 2) for d in range(-3, 4)}
    for i, got in enumerate(html_text.smoothed(x)):
        near = [(kernel[j - i], x[j]) for j in range(len(x)) if abs(j - i) <= 3]
        assert abs(got - sum(w * v for w, v in near) / sum(w for w, _ in near)) < 1e-12


def test_pages(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x"), (1, "u", f"<article>{ARTICLE}</article>", "x"), (2, None, None, None), (None, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert plain(html_text.extract(pages)) == [(None, "v", "", 0), (1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (2, None, "", 0)]
    assert html_text.extract(pages.where("false")).count() == 0
    assert DDL
