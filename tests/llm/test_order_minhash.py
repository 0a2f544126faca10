import hashlib

import pytest
from pyspark.sql import functions as F

from epithet.llm import order_minhash as omh

from .conftest import ODD, prose


def sketches(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: r.p for r in df.select("i", omh.fingerprint(F.col("text")).alias("p")).collect()}


def likeness(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    return df.select(omh.likeness(omh.fingerprint(F.col("a")), omh.fingerprint(F.col("b")))).first()[0]


def test_report_against_plain_python(make_docs, spark):
    texts = [*ODD, *[prose(n, 5 * n) for n in range(1, 40)], prose(9, 45), prose(9, 45)]
    rows = [(3 * i % 101, t, "s") for i, t in enumerate(texts)] + [(None, "no id at all here", "s")]
    docs = make_docs(rows, ["1 AS bucket", "2 AS print", "3 AS next_text"])
    got = {r.doc_id: r for r in omh.fingerprint_report(docs).collect()}
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    prints = sketches(spark, [t or "" for _, t, _ in order])
    assert len(got) == len(rows)
    for n, (doc, text, _) in enumerate(order):
        text, following = text or "", order[(n + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = set(prints[n]), set(prints[(n + 1) % len(order)])
        bins = {x >> 32 for x in a | b}
        assert r.near_next == pytest.approx(len(a & b) / len(bins) if bins else 1.0)
        assert 0 <= r.near_edited <= 1
        assert r.fingerprint == "".join(f"{x:010x}" for x in prints[n])


def test_equal_and_single_documents(make_docs):
    docs = make_docs([prose(1, 80), prose(1, 80), None])
    got = {r.doc_id: r for r in omh.fingerprint_report(docs).collect()}
    assert got[0].fingerprint == got[1].fingerprint and got[1].near_next == 1.0
    assert got[2].fingerprint == "" and got[2].near_edited == 1.0
    (one,) = omh.fingerprint_report(make_docs([prose(2, 60)])).collect()
    assert one.near_next == 1.0
    assert omh.fingerprint_report(make_docs([])).count() == 0


def test_repeated_ids_all_stand(make_docs):
    rows = [(5, prose(n % 3, 40), "s") for n in range(9)] + [(6, "x", "s")]
    assert omh.fingerprint_report(make_docs(rows)).count() == 10


def test_order_matters_and_edits_lower_likeness(spark):
    words = prose(3, 400).split()
    text = " ".join(words)
    blocks = [words[i : i + 20] for i in range(0, 400, 20)]
    moved = " ".join(w for b in reversed(blocks) for w in b)
    near = " ".join(words[:390] + ["other"] * 10)
    assert likeness(spark, text, text) == 1.0
    assert likeness(spark, text, near) > 0.7
    # nearly the same set of k-mers, in another order
    assert likeness(spark, text, moved) < 0.7
    assert likeness(spark, text, prose(77, 400)) < 0.05


def test_short_texts_keep_order(spark):
    words = [f"{w}{i}" for i, w in enumerate(prose(8, 36).split())]
    moved = " ".join(words[18:] + words[:18])
    text = " ".join(words)
    (a,), (b,) = (sketches(spark, [t]).values() for t in (text, moved))
    assert {x >> 32 for x in a} == {x >> 32 for x in b} == set(range(64))
    # 32 of 34 k-mers are shared, but their order is not
    assert likeness(spark, text, moved) < 0.75
    same = len(set(a) & set(b)) / 64
    assert likeness(spark, text, moved) == same


def test_two_kmers_in_both_orders(spark):
    # equal k-mers but for their order: as sets, all signatures would be equal
    a, b = "p q r s p q r t p q r s", "p q r t p q r s p q r t"
    assert likeness(spark, a, b) < 1.0
    assert all(len(p) == 64 for p in sketches(spark, [a, b, "four words are here", "p q r s"]).values())


def test_texts_with_few_words_are_taken_by_characters(spark):
    long = "".join(prose(5, 200).split())
    other = "".join(prose(6, 200).split())
    near = long[:-60] + other[:60]
    assert 0.6 < likeness(spark, long, near) < 1.0
    assert likeness(spark, long, long[500:] + long[:500]) < 0.95
    assert likeness(spark, long, other) < 0.5
    assert likeness(spark, "one  word", "one\tword") == 1.0
    assert len(sketches(spark, ["日本語のテキスト"])[0]) == 64


def test_repeats_are_numbered(spark):
    once, twice = prose(4, 120), prose(4, 120) + "\n" + prose(4, 120)
    assert likeness(spark, once, twice) < 0.95
    assert likeness(spark, twice, twice) == 1.0
    assert sketches(spark, ["a b c " * 3000])[0]


def test_no_python_in_the_plan(make_docs):
    plan = omh.fingerprint_report(make_docs(["a b", "c d"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
