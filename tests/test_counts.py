"""Counting tokens: right for odd documents, and without dealing out a row a token."""

from __future__ import annotations

from collections import Counter

from lodestone.index import Index, Inverted, counted, frequencies
from lodestone.queries import ANALYZERS, QUERIES

SF = "/root/testdata/sf0.001"
SPEC = {"analyzers": ANALYZERS, "fields": {"text": {"type": "text", "analyzer": "ws"}}}
ODD = ["b a  b\ta", "", None, "   ", "x", "a　b c a\x85a\xa0é​b", "b" + " b" * 300 + " a", "’a’ “b”\r\n\x0b’a’"]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _docs(spark, keys):
    return Index.over("odd", SPEC, spark.createDataFrame(list(zip(keys, ODD, strict=True)), "doc_id long, text string"), "doc_id").docs


def _brute(keys):
    out = {}
    for key, text in zip(keys, ODD, strict=True):
        out.setdefault(key, Counter()).update((text or "").split())
    return {(k, t): n for k, c in out.items() for t, n in c.items()}


def test_tfidf_counts_within_documents_and_sorts_no_postings(spark):
    df = QUERIES["tfidf"](spark, SF)
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in physical and "hashpartitioning(doc_id" not in physical
    assert "size(array_remove(split" not in _plan(df).split("Generate")[-1]  # no filter that Spark infers takes texts apart again


def test_counts_equal_brute_force(spark):
    keys = list(range(len(ODD)))
    found = counted(_docs(spark, keys), "doc_id", "text").collect()
    assert {(r["key"], r["token"]): r["tf"] for r in found} == _brute(keys) and len(found) == len(_brute(keys))
    assert all(r["dl"] == len(ODD[r["key"]].split()) for r in found)


def test_documents_that_share_a_key_are_added_up(spark):
    keys = [1, None, None, 2, 1, 1, None, None]
    brute = _brute(keys)
    found = counted(_docs(spark, keys), "doc_id", "text").collect()
    assert {(r["key"], r["token"]): r["tf"] for r in found} == brute and len(found) == len(brute)
    df = {r["token"]: r["df"] for r in frequencies(_docs(spark, keys), "doc_id", "text").collect()}
    assert df == Counter(t for _, t in brute)


def test_idf_deals_out_no_documents(spark):
    df = QUERIES["idf"](spark, SF)
    assert "hashpartitioning(doc_id" not in df._jdf.queryExecution().executedPlan().toString()
    assert "size(array_remove(split" not in _plan(df).split("Generate")[-1]


def test_tf_deals_out_nothing(spark):
    df = QUERIES["tf"](spark, SF)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_saved_postings_are_counted_within_documents(spark):
    held = Inverted.of(_docs(spark, list(range(len(ODD)))), "doc_id", "text")
    assert "Exchange" not in held.postings._jdf.queryExecution().executedPlan().toString()
    assert [f.dataType.simpleString() for f in held.postings.schema if f.name in ("tf", "dl")] == ["int", "int"]


def test_saved_index_of_documents_that_share_a_key(spark, tmp_path):
    keys = [1, None, None, 2, 1, 1, None, None]
    Inverted.of(_docs(spark, keys), "doc_id", "text").write(str(tmp_path))
    held, brute = Inverted.read(spark, str(tmp_path)), _brute(keys)
    assert {(r["key"], r["token"]): r["tf"] for r in held.postings.collect()} == brute
    assert {r["token"]: r["df"] for r in held.frequencies.collect()} == Counter(t for _, t in brute)
