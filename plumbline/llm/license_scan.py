"""License scan with ordered signature rules.

A rule is a pattern with a label, a priority and keywords. Hundreds of rules come from the tables below: one row for each license
or notice, several signature forms for each (identifier tag, licence name with its version, grant sentence, address).
Three steps, each over the whole text:

1. **Keyword prefilter**: a rule is tried only if its keywords occur in the text.
2. **Patterns**: every match of a tried rule is a detection with a place, a label and a priority.
3. **Suppression**: detections are taken in order of priority, longer and earlier ones first; one that lies within
   the interval of a taken one is dropped.

Base phrases (``BASE``) are counted as places where their words stand consecutively; their labels always stay. Text is lower-cased in
A-Z only and words are runs of digits, letters a-z and characters beyond ASCII. A row is scanned where it is read: no shuffle,
and memory holds one batch of texts.

Edge cases: a null or empty text has no words, no labels, null positions and score 0. Repeated rows give repeated results.
Long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import slices
from plumbline.session import ship_package

# Phrases of the base scan and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, pattern of the name, pattern of the version (empty: none), keywords of which one must occur.
LICENSES = [
    ("apache-1.0", "apache( software)?", "1 0", "apache"),
    ("apache-1.1", "apache( software)?", "1 1", "apache"),
    ("apache-2.0", "apache( software)?", "2( 0)?", "apache"),
    ("gpl-1.0", "(gnu )?(gpl|general public)", "1( 0)?", "gpl |general public"),
    ("gpl-2.0", "(gnu )?(gpl|general public)", "2( 0)?", "gpl |general public"),
    ("gpl-3.0", "(gnu )?(gpl|general public)", "3( 0)?", "gpl |general public"),
    ("lgpl-2.0", "(gnu )?(lgpl|(lesser|library) general public)", "2( 0)?", "lgpl |lesser general|library general"),
    ("lgpl-2.1", "(gnu )?(lgpl|(lesser|library) general public)", "2 1", "lgpl |lesser general|library general"),
    ("lgpl-3.0", "(gnu )?(lgpl|lesser general public)", "3( 0)?", "lgpl |lesser general|library general"),
    ("agpl-1.0", "(gnu )?(agpl|affero general public)", "1( 0)?", "agpl |affero"),
    ("agpl-3.0", "(gnu )?(agpl|affero general public)", "3( 0)?", "agpl |affero"),
    ("gfdl-1.1", "(gnu )?(fdl|gfdl|free documentation)", "1 1", "fdl |free documentation"),
    ("gfdl-1.2", "(gnu )?(fdl|gfdl|free documentation)", "1 2", "fdl |free documentation"),
    ("gfdl-1.3", "(gnu )?(fdl|gfdl|free documentation)", "1 3", "fdl |free documentation"),
    ("mpl-1.0", "(mpl|mozilla public)", "1 0", " mpl |mozilla"),
    ("mpl-1.1", "(mpl|mozilla public)", "1 1", " mpl |mozilla"),
    ("mpl-2.0", "(mpl|mozilla public)", "2( 0)?", " mpl |mozilla"),
    ("epl-1.0", "(epl|eclipse public)", "1 0", " epl |eclipse"),
    ("epl-2.0", "(epl|eclipse public)", "2( 0)?", " epl |eclipse"),
    ("cddl-1.0", "(cddl|common development and distribution)", "1 0", " cddl |common development"),
    ("cddl-1.1", "(cddl|common development and distribution)", "1 1", " cddl |common development"),
    ("cpl-1.0", "(cpl|common public)", "1 0", " cpl |common public"),
    ("eupl-1.1", "(eupl|european union public)", "1 1", " eupl |european union"),
    ("eupl-1.2", "(eupl|european union public)", "1 2", " eupl |european union"),
    ("artistic-1.0", "artistic", "1 0", "artistic"),
    ("artistic-2.0", "artistic", "2( 0)?", "artistic"),
    ("bsl-1.0", "(bsl|boost software)", "1( 0)?", " bsl |boost"),
    ("osl-2.1", "(osl|open software)", "2 1", " osl |open software"),
    ("osl-3.0", "(osl|open software)", "3( 0)?", " osl |open software"),
    ("afl-2.1", "(afl|academic free)", "2 1", " afl |academic free"),
    ("afl-3.0", "(afl|academic free)", "3( 0)?", " afl |academic free"),
    ("zpl-2.0", "(zpl|zope public)", "2 0", " zpl |zope"),
    ("zpl-2.1", "(zpl|zope public)", "2 1", " zpl |zope"),
    ("psf-2.0", "(psf|python software foundation)", "2( 0)?", " psf |python software"),
    ("lppl-1.3", "(lppl|latex project public)", "1 3[a-c]?", " lppl |latex project"),
    ("ms-pl", "(ms pl|microsoft public)", "", " ms pl |microsoft public"),
    ("ms-rl", "(ms rl|microsoft reciprocal)", "", " ms rl |microsoft reciprocal"),
    ("ofl-1.1", "(ofl|sil open font)", "1 1", " ofl |open font"),
    ("upl-1.0", "(upl|universal permissive)", "1 0", " upl |universal permissive"),
    ("cecill-2.1", "cecill", "2 1", "cecill"),
    ("mulan-2.0", "(mulanpsl|mulan permissive software)", "2( 0)?", "mulan"),
    ("odbl-1.0", "(odbl|open database)", "1 0", " odbl |open database"),
    ("odc-by-1.0", "(odc by|open data commons attribution)", "1 0", " odc by |open data commons"),
    ("mit", "(mit|expat)", "", " mit | expat "),
    ("mit-0", "mit (0|no attribution)", "", " mit "),
    ("isc", "isc", "", " isc "),
    ("bsd-2-clause", "(bsd 2 clause|simplified bsd|freebsd)", "", "bsd"),
    ("bsd-3-clause", "(bsd 3 clause|new bsd|modified bsd|revised bsd)", "", "bsd"),
    ("bsd-4-clause", "(bsd 4 clause|original bsd)", "", "bsd"),
    ("0bsd", "(0bsd|zero clause bsd|bsd zero clause)", "", "bsd"),
    ("zlib", "zlib( libpng)?", "", " zlib "),
    ("wtfpl", "(wtfpl|do what the fuck you want to public)", "", " wtfpl |what the fuck"),
    ("unlicense", "unlicense", "", "unlicense"),
    ("postgresql", "postgresql", "", "postgresql"),
    ("ncsa", "(ncsa|university of illinois ncsa open source)", "", " ncsa "),
    ("curl", "curl", "", " curl "),
    ("ruby", "ruby", "", " ruby "),
    ("php-3.01", "php", "3 01", " php "),
    ("vim", "vim", "", " vim "),
    ("json", "json", "", " json "),
]
# Parts of the attribution licenses.
CC_PARTS = {"cc-by": "by", "cc-by-sa": "by sa", "cc-by-nc": "by nc", "cc-by-nd": "by nd", "cc-by-nc-sa": "by nc sa", "cc-by-nc-nd": "by nc nd"}
CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(ative|ative work)?s?"}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
# Notices without a license name: label, pattern, keyword.
NOTICES = [
    ("reserved", "all rights reserved", "reserved"),
    ("reserved", "(tous droits|alle rechte|todos los derechos) (réservés|vorbehalten|reservados)", "tous droits|alle rechte|los derechos"),
    ("copyright", "copyright( c| ©)? [0-9]{4}", "copyright "),
    ("public-domain", "(released into|dedicated to|placed in|in) the public domain", "domain"),
    ("cc0-1.0", "(cc0|cc zero|creative commons zero)( 1 0)?( universal)?", " cc0 | cc zero |commons zero"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "is hereby granted"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "permission notice"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use"),
    ("bsd-3-clause", "neither the name of .{1,60}? nor the names of (its|any) contributors", "nor the names"),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice", "redistributions"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice", "redistributions"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", "advertising"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors", "is provided as is"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("gpl", "gnu general public license", "gnu general"),
    ("gpl", "general public license", "general public"),
    ("lgpl", "gnu (lesser|library) general public license", "gnu l"),
    ("agpl", "gnu affero general public license", "gnu affero"),
    ("proprietary", "(strictly )?(confidential and proprietary|proprietary and confidential)", "and proprietary|proprietary and"),
    ("proprietary", "unauthori[sz]ed (copying|reproduction|distribution) (of this .{1,30}? )?is (strictly )?prohibited", "unauthori"),
    ("cc-by", "cc by", " cc by "),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str  # over words with single spaces
    priority: int  # smaller is stronger
    keywords: tuple[str, ...]  # of each, one of the alternatives must occur
    weight: float


@cache
def rules() -> tuple[Rule, ...]:
    """All signature rules in order: identifier tags, grants, names with versions, addresses, notices."""
    out = []
    for label, name, version, key in LICENSES:
        full = f"{name}( software)?( public)?( licen[cs]e)?,?( version| v)?( ?{version})" if version else f"{name} licen[cs]e"
        tag = re.sub(r"[^a-z0-9]+", " ", label)
        only = "( only| or later)?"
        out += [
            Rule(label, f"spdx license identifier {tag}{only}", 0, ("spdx license",), 1.0),
            Rule(label, f"(licensed|released|distributed|available|published|provided) (under|according to) (the )?(terms of )?(the )?{full}{only}",
                 1, (key, " under | according to "), 0.95),
            Rule(label, f"(subject|according) to (the )?(terms of )?(the )?{full}{only}", 1, (key, "subject to |according to "), 0.9),
            Rule(label, f"{full}{only}", 2, (key,), 0.8),
            Rule(label, f"(https?|www) .{{0,40}}?licen[cs]es? {tag}( html| txt| php)?", 3, (" http| www", "licens|licenc"), 0.85),
        ]
    for label, parts in CC_PARTS.items():
        named = " ".join(CC_NAMES[p] for p in parts.split())
        for v in CC_VERSIONS:
            own = f"{label}-{v.replace(' ', '.')}"
            out += [
                Rule(own, f"cc {parts} {v}", 1, (" cc by ",), 0.95),
                Rule(own, f"creative commons {named}( international| unported| generic)? {v}", 1, ("creative commons",), 0.95),
                Rule(own, f"creativecommons org licenses {parts} {v}", 1, ("creativecommons org",), 0.95),
            ]
        out += [Rule(label, f"creative commons {named}", 3, ("creative commons",), 0.7)]
        out += [Rule(label, f"cc {parts}", 3, (" cc by ",), 0.6)]
    out += [Rule(label, pattern, 4, (key,), 0.5) for label, pattern, key in NOTICES]
    return tuple(out)


@cache
def _compiled() -> dict[bytes, list[tuple[int, Rule, re.Pattern[bytes], list[list[bytes]]]]]:
    """Rules by each alternative of their first keyword, with place in the order, pattern and all keywords."""
    out: dict[bytes, list] = {}
    for i, r in enumerate(rules()):
        pattern = re.compile(b"(?<![^ ])(?:" + r.pattern.encode() + b")(?![^ ])")
        keys = [[k.encode() for k in group.split("|")] for group in r.keywords]
        for k in keys[0]:
            out.setdefault(k, []).append((i, r, pattern, keys))
    return out


# ASCII that is neither a digit nor a letter separates words
_TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_BASE = [(label, phrase.encode(), re.compile(b"(?<![^ ])" + phrase.encode() + b"(?![^ ])")) for phrase, label in BASE.items()]


def detect(words: bytes) -> list[tuple[int, int, Rule]]:
    """Detections in a text of single-spaced words that remain after suppression, in order of place."""
    padded = b" " + words + b" "
    tried = {}
    for key, own in _compiled().items():
        if key in padded:
            tried |= {x[0]: x for x in own if all(any(k in padded for k in group) for group in x[3])}
    found = [(m.start(), m.end(), rule) for _, rule, pattern, _ in tried.values() for m in pattern.finditer(words)]
    found.sort(key=lambda d: (d[2].priority, d[0] - d[1], d[0]))
    # the furthest end of what was kept with a start up to here: prefix maxima in a Fenwick tree over the starts
    rank = {start: r for r, start in enumerate(sorted({d[0] for d in found}), 1)}
    tree, kept = [0] * (len(rank) + 1), []
    for start, end, rule in found:
        reach, r = 0, rank[start]
        while r:
            reach, r = max(reach, tree[r]), r & r - 1
        if reach >= end:  # it lies within one
            continue
        kept.append((start, end, rule))
        r = rank[start]
        while r < len(tree):
            tree[r] = max(tree[r], end)
            r += r & -r
    return sorted(kept, key=lambda d: d[:2])


def scan_text(text: str | None) -> dict:
    """Everything that is reported of one text."""
    parts = (text or "").encode("utf-8", "replace").lower().translate(_TO_WORDS).split()
    words = b" ".join(parts)
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])  # of each word

    def word(at: int) -> int:
        return int(np.searchsorted(starts, at, "right")) - 1

    places, base = [], set()
    for label, phrase, pattern in _BASE:
        if phrase in words:
            own = [word(m.start()) for m in pattern.finditer(words)]
            if own:
                base.add(label)
                places += own
    kept = detect(words)
    labels = base | {r.label for _, _, r in kept}
    weight = max([r.weight for _, _, r in kept] + [0.5] * bool(base), default=0.0)
    return {"n_words": len(parts), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": weight,
            "spans": [(word(a), word(b - 1) + 1, r.label, r.priority) for a, b, r in kept]}


FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
          "labels": pa.string(), "score": pa.float64(),
          "spans": pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, positions, labels, score and the ``spans`` (word positions) of detections."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in FIELDS["spans"].value_type]
        for b in slices(batches):
            rows = [scan_text(t) for t in b.column(1).to_pylist()]
            for r in rows:
                r["spans"] = [dict(zip(names, s, strict=True)) for s in r["spans"]]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([r[n] for r in rows], t) for n, t in FIELDS.items()], [id_col, *FIELDS])

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                                "labels string, score double, spans array<struct<first:long,end:long,label:string,priority:int>>")
