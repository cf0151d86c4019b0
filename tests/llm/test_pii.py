from __future__ import annotations

import re

from llm_fixtures import empty, odd
from pyspark.sql import functions as F

from plumbline.llm import pii


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in pii.replace(df, key).collect()}


def test_no_python_in_the_plan(spark):
    plan = pii.replace(odd(spark), "k")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


def test_replacements_are_keyed_consistent_and_alike(spark):
    texts = [
        "Dr. Anna Miller wrote to Mrs. Miller at Anna.Miller@corp.example.com, call +1 (555) 123-4567.",
        "anna.miller@CORP.example.com or +1 555.123.4567; MR. JOHN SMITH", "Mr. John Miller, 4785-3805-9239-1139 or 4785380592391139",
        "from 10.0.0.1 with 123-45-6789 and DE89 3704 0044 0532 0130 00", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ok', "г-жа Анна Петрова", "nothing 12 here",
    ]
    found = run(spark, texts)
    out = [found[i].text for i in range(len(texts))]
    for value in ["Anna", "Miller", "corp", "555", "4785-", "10.0.0.1", "123-45", "3704", "24be", "Анна", "Петрова", "JOHN"]:
        assert not any(value.lower() in o.lower() for o in out), value
    names = re.match(r"Dr\. (\S+) (\S+) wrote to Mrs\. (\S+) at (\S+), call \+1 \((\d{3})\) (\d{3})-(\d{4})\.$", out[0])
    assert names and names[1] in pii.GIVEN["latin"]["f"] and names[2] == names[3]
    mail, phone = names[4], names[5] + names[6] + names[7]
    assert re.match(rf"{re.escape(mail)} or \+1 {phone[:3]}\.{phone[3:6]}\.{phone[6:]};", out[1]) and mail.endswith(".example.org")
    third = re.match(r"Mr\. (\S+) (\S+), (\d{4}-\d{4}-\d{4}-\d{4}) or (\d{16})$", out[2])
    assert third[1] in pii.GIVEN["latin"]["m"] and third[2] == names[2] and third[3].replace("-", "") == third[4]
    assert re.match(r"from \d+\.\d+\.\d+\.\d+ with \d{3}-\d{2}-\d{4} and DE\d\d( \d{4}){4} \d\d$", out[3])
    assert re.match(r'token = "[0-9a-f]{40}" ok$', out[4])
    sixth = re.match(r"г-жа (\S+) (\S+)$", out[5])
    assert sixth[1] in pii.GIVEN["cyrillic"]["f"] and re.match("^[А-Яа-я]+$", sixth[2])
    assert out[6] == texts[6] and found[6].n_entities == 0 and found[0].n_entities == 4 and found[0].kinds == "mail,name,phone"
    assert run(spark, texts, "other")[0].text != out[0]


def test_surrogates_stay_distinct(spark):
    # far more values than given names and single-letter mail names exist
    rows = [("given", f"name{i}", "f") for i in range(150)] + [("mail", f"{c}@a.b", "n") for c in "abcdefghijklmnopqrstuvwxyz"]
    rows += [("address", f"10.0.{i // 250}.{i % 250}", "n") for i in range(500)] + [("surname", f"sur{i}", "n") for i in range(300)]
    found = pii.surrogates(spark.createDataFrame(rows, "kind string, canon string, gender string"), "k").collect()
    assert len(found) == len(rows)
    assert len({(r.kind, r.surrogate.lower()) for r in found}) == len(rows)
    real = {(k, c) for k, c, _ in rows}
    assert not any((r.kind, r.surrogate.lower()) in real for r in found)
    again = pii.surrogates(spark.createDataFrame(rows[::-1], "kind string, canon string, gender string"), "k").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_surrogate_never_equals_a_real_value(spark):
    one = spark.createDataFrame([("ssn", "123456789", "n")], "kind string, canon string, gender string")
    first = pii.surrogates(one, "k").first().surrogate
    both = {r.canon: r.surrogate for r in pii.surrogates(one.union(spark.createDataFrame([("ssn", first, "n")], one.schema)), "k").collect()}
    assert both["123456789"] not in (first, "123456789") and both[first] not in (first, "123456789") and len(set(both.values())) == 2


def test_gender_conflicts_are_neutral(spark):
    found = run(spark, ["Mr. Quentil Abc met Mrs. Quentil Abd"])
    a, b = re.match(r"Mr\. (\S+) \S+ met Mrs\. (\S+) \S+$", found[0].text).groups()
    assert a == b and a in pii.GIVEN["latin"]["n"]


def test_odd_rows(spark):
    docs = odd(spark).withColumn("text", F.when(F.col("doc_id") == 5, F.lit("mail x.y@z.de")).otherwise(F.col("text")))
    found = pii.replace(docs, "k").collect()
    assert len(found) == docs.count()
    before = sorted((r.doc_id or -1, r.text or "") for r in docs.collect() if r.doc_id != 5)
    assert sorted((r.doc_id or -1, r.text or "") for r in found if r.doc_id != 5) == before
    five = [r for r in found if r.doc_id == 5]
    assert len(five) == 3 and len({r.text for r in five}) == 1 and "x.y" not in five[0].text
    assert pii.replace(empty(spark), "k").count() == 0


def test_clean_texts_stay(spark):
    texts = ["1.2.3", "version 2.10.300.4000", "aaaa", "+", "Mr.", "a@b", "2024-01-02", "12345678", "Dr. who", "x" * 100_000 + " 1"]
    assert [r.text for _, r in sorted(run(spark, texts).items())] == texts
