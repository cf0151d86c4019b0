"""Small tables with everything that is awkward in them."""

from __future__ import annotations

import random

DDL = ("doc_id long, text string, lang string, source string, n_chars long, id string, fp long, tag long, key string, keep_id long, kept boolean, "
       "fingerprint string, leaf string, tokens long, lang_pred string, score double, labels string, start long, value string, kinds string")
EXTRA = (None, 1, 2, "k", 9, False, "f", "l", 3, "xx", 0.5, "y", 4, "v", "z")
LONG = "lorem ipsum dolor sit amet " * 20_000


def odd_rows():
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta"]
    prose = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(6)]
    texts = [None, "", " ", "...", "one", prose[0], prose[0], prose[0].replace(" ", "  "), prose[1], prose[1] + " end", prose[2], LONG, "日本語 текст", None, prose[3]]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, prose[0], "en", "s0", 1), (5, prose[0], "en", "s0", 1), (None, prose[4], "en", None, 1), (None, prose[4], "de", "s1", None), (None, prose[1], "en", "s0", 1)]
    return [(*r, *EXTRA) for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), DDL).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DDL)


def plain(df, *cols):
    """Rows as sorted tuples, nulls first."""
    rows = [tuple(r[c] for c in cols or df.columns) for r in df.collect()]
    return sorted(rows, key=lambda r: [(v is not None, v) for v in r])
