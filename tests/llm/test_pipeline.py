"""Every stage of the pipeline on all its predecessor kept, against brute force."""

from __future__ import annotations

import base64
import hashlib
import os

import duckdb
import public_tokenizers
import pytest
import tiktoken
from llm_fixtures import empty, odd
from test_dedup import classes, norm, slow_fingerprint

import corpus_pipeline
from plumbline.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_letter(rows):
    return [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]


def first_of_equal(rows):
    first = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        first.setdefault(norm(r["text"]), r)
    return list(first.values())


def first_of_near(rows):
    prints = [slow_fingerprint(r["text"]) for r in rows]
    groups = {}
    for r, label in zip(rows, classes(prints), strict=True):
        groups.setdefault(label, []).append(r)
    return [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]


def encoded(rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        out.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    return out


def key(r):
    return [(v is not None, v) for v in r]


def mixed(rows):
    """The ids that the mixture takes, by the same SQL as the mixing query."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [[r[c] for c in COLUMNS[:4]] for r in rows])
    return {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries._mixing_sql(corpus_pipeline.SHARE, corpus_pipeline.EPOCHS)})").fetchall()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    wants = {"language_id": with_letter, "exact_dedup": first_of_equal, "simhash": first_of_near}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        if name in wants:
            rows = wants[name](rows)
            assert docs.columns == COLUMNS
            assert sorted(map(tuple, docs.collect())) == sorted(tuple(r[c] for c in COLUMNS) for r in rows), name
        elif name == "mixing":
            ids = mixed(rows)
            rows = [r for r in rows if r["doc_id"] in ids]
            assert docs.columns == COLUMNS and 0 < len(rows)
            assert sorted(map(tuple, docs.collect())) == sorted(tuple(r[c] for c in COLUMNS) for r in rows)
        else:
            assert sorted(map(tuple, docs.collect())) == sorted(encoded(rows))


def test_odd_and_empty_tables(spark, tmp_path):
    for name, table, rows in (("odd", odd(spark), True), ("empty", empty(spark), False)):
        table.select(*COLUMNS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        want = [r.asDict() for r in docs.collect()]
        for stage, f in corpus_pipeline.STAGES[:3]:
            docs = f(spark, docs, f"{tmp_path}/{name}").cache()
            want = {"language_id": with_letter, "exact_dedup": first_of_equal, "simhash": first_of_near}[stage](want)
            # of rows that are alike in id and text, any one stays
            assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=key) == sorted(((r["doc_id"], r["text"]) for r in want), key=key), stage
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(found) == rows and all(r["n_tokens"] > 0 for r in found)
