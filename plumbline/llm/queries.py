"""The driver queries of this subpackage, one per operator, over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from plumbline.llm import (
    ann_forest, byte_bpe, exact_dedup, html_text, language_id, license_scan, mixing, phrases, pii, quality_cascade, ranked_search, simhash,
    substring_dedup,
)
from plumbline.plans.inputs import Book, table

BOOK = Book()
KEY = "surrogates of the driver tables"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@BOOK.query("op1_byte_bpe")
def op1(spark, sf_dir):
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@BOOK.query("op2_substring_dedup")
def op2(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@BOOK.query("op3_html_text")
def op3(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@BOOK.query("op4_pii_surrogates")
def op4(spark, sf_dir):
    return pii.replace(table(spark, sf_dir, "documents"), KEY)


@BOOK.query("op6_simhash")
def op6(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@BOOK.query("op7_ann_forest")
def op7(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return ann_forest.nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


@BOOK.query("op8_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)""")
def op8(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest=True)


@BOOK.query("op9_license_scan")
def op9(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


@BOOK.query("op10_language_id")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(~language_id.held_out(F.col("doc_id")))
    found = language_id.predict(docs, language_id.train(learn))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# Target weights of the mixture: domains by name, all languages of a domain alike, all sources of a language alike.
DOMAINS = 4
WEIGHTS = {("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0}
SEED, EPOCHS, SHARE = 17, 4, 0.6


def source_tree():
    """Domain (a hash of the source's name stands in for a catalogue of sources), language, source."""
    domain = F.concat(F.lit("d"), F.crc32(F.col("source").cast("binary")) % DOMAINS)
    return [domain, F.col("lang"), F.col("source")]


def _mixing_sql(share: float = SHARE, epochs: int = EPOCHS) -> str:
    """The mixture in DuckDB: water filling for each level of the tree, then the seeded prefix."""
    cases = " ".join(f"WHEN '{path[0]}' THEN {w}" for path, w in WEIGHTS.items())
    keys, levels = ["domain", "lang", "source"], []
    for i, key in enumerate(keys):
        own, above = ", ".join(keys[:i + 1]), keys[:i]
        same = " AND ".join(f"n.{k} IS NOT DISTINCT FROM p.{k}" for k in above) or "TRUE"
        weight = f"CASE n.domain {cases} ELSE 1.0 END" if i == 0 else "1.0"
        part = f"PARTITION BY {', '.join(above)}" if above else ""
        path = " || ',' || ".join(f"coalesce(to_json(n.{k})::VARCHAR, 'null')" for k in keys[:i + 1])
        levels.append(f"""c{i} AS (SELECT n.*, {weight}::DOUBLE AS w, p.budget, '[' || {path} || ']' AS node
  FROM (SELECT {own}, sum(supply) * {epochs} AS cap FROM leaves GROUP BY {own} HAVING sum(supply) > 0) n JOIN b{i} p ON {same}),
r{i} AS (SELECT *, row_number() OVER (o) AS place, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c{i} WINDOW o AS ({part} ORDER BY cap / w, node)),
s{i} AS (SELECT *, min(CASE WHEN level * w <= cap THEN place END) OVER ({part}) AS first_open FROM r{i}),
b{i + 1} AS (SELECT {own}, coalesce(least(cap::DOUBLE, max(CASE WHEN place = first_open THEN level END) OVER ({part}) * w), cap::DOUBLE) AS budget FROM s{i})""")
    ladder = ",\n".join(levels)
    same = " AND ".join(f"d.{k} IS NOT DISTINCT FROM q.{k}" for k in keys)
    # DuckDB has no crc32, so the domains of the sources are listed
    from zlib import crc32

    domains = " ".join(f"WHEN 'src{i}' THEN 'd{crc32(f'src{i}'.encode()) % DOMAINS}'" for i in range(20))
    return rf"""
WITH d AS (SELECT doc_id, lang, source, CASE source {domains} END AS domain,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply FROM d GROUP BY ALL),
b0 AS (SELECT least(sum(supply) * {share}::DOUBLE, (sum(supply) * {epochs})::DOUBLE) AS budget FROM leaves),
{ladder},
q AS (SELECT l.*, floor(b.budget / supply)::BIGINT AS whole, (floor(b.budget) - floor(b.budget / supply) * supply)::BIGINT AS rest
      FROM leaves l JOIN b3 b ON {same.replace('d.', 'l.').replace('q.', 'b.')}),
p AS (SELECT d.*, q.whole, q.rest, ('0x' || substr(md5('{SEED}:' || whole || ':' || doc_id), 1, 15))::BIGINT AS position
      FROM d JOIN q ON {same}),
t AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY position) AS upto FROM p)
SELECT doc_id, domain, lang, source, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS copies
FROM t WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0"""


@BOOK.query("op5_mixing", _mixing_sql())
def op5(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), source_tree(), WEIGHTS, SHARE, EPOCHS, SEED)
    return mixed.select("doc_id", source_tree()[0].alias("domain"), "lang", "source", F.col("__copies").alias("copies"))


@BOOK.query("op11_quality_cascade", r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT i, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '[A-Za-z]')) AS n_letters,
             len(list_filter(words, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS n_letter_words,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(-|\*|•)'))) AS n_list_lines FROM w),
p AS (SELECT i, words, unnest(range(1, len(words) - 3)) AS pos FROM w),
g AS (SELECT i, pos, array_to_string(words[pos:pos + 4], ' ') AS gram FROM p),
t AS (SELECT i, pos, count(*) OVER (PARTITION BY i, gram) AS times FROM g),
r AS (SELECT i, count(DISTINCT k) AS n FROM (SELECT i, unnest(range(pos, pos + 5)) AS k FROM t WHERE times > 1) GROUP BY i)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       coalesce(r.n, 0)::BIGINT AS n_repeat_words, n_words < 10 OR 100 * coalesce(r.n, 0) > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * coalesce(r.n, 0) > 20 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 2 * n_capitals > n_letters OR 10 * n_letter_words < 7 * n_words
            OR 10 * n_cut_lines > 3 * n_lines OR 10 * n_list_lines > 9 * n_lines) AS kept
FROM m LEFT JOIN r USING (i)""")
def op11(spark, sf_dir):
    report = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = quality_cascade.judge(table(spark, sf_dir, "documents"), report=report)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select("doc_id", *report, failed.alias("base_failed"), "kept")


@BOOK.query("op12_phrase_mining", r"""
WITH p AS (SELECT lang, unnest(list_transform(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) AS words
           FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
s AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS pos FROM p, range(1, 6) AS ks(k) WHERE len(words) >= k),
f AS (SELECT lang, k, array_to_string(words[pos:pos + k - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_ AS (SELECT lang, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase, a FROM c WHERE k > 2),
over_ AS (SELECT lang, phrase, max(a) AS around FROM inner_ GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN over_ o USING (lang, phrase) WHERE o.around IS NULL OR 100 * o.around < 100 * c.a),
cut AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS pos FROM kept),
scored AS (SELECT cut.lang, cut.phrase, a, pos, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:pos], ' ')
           JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[pos + 1:cut.k], ' ') JOIN n ON n.lang = cut.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) AS place FROM scored),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best WHERE place = 1)
SELECT * FROM ranked WHERE rank <= 2000""")
def op12(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@BOOK.query("op13_ranked_search", r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) AS nn, sum(len(terms))::BIGINT AS ll FROM d WHERE len(terms) > 0),
m AS (SELECT i, doc_id, 100 - 90 + ((90 * len(terms) * nn) // ll) AS m FROM d, c WHERE len(terms) > 0),
tf AS (SELECT i, term, count(*) AS tf FROM (SELECT i, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
s AS (SELECT q.item_id, m.i, m.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (i) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10""")
def op13(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
