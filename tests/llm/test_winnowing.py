"""Decontamination against a word-by-word brute force."""

import hashlib
import re

import pytest

from lodestone.llm import winnowing
from lodestone.llm._shared import read

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = WORDS.findall(lowered(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = WORDS.findall(lowered(text)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out[doc] = (len(w), len(hit), len({x for x in found if x is not None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_matches_brute_force_on_whole_tables(spark, sf):
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = result(winnowing.contamination(docs, items))
    assert got == expected
    assert any(x[-1] for x in got.values())


ITEMS = [
    (1, "a b c d e f g h i j"),
    (2, "One Two, three"),
    (3, "solo"),
    (4, None),
    (5, " ... "),
    (None, "n1 n2 n3 n4 n5 n6 n7 n8 n9 n10 n11"),
    (7, "x x x x x x x x x x x x"),
    (8, "É é a1 b c d e f g h i j k l"),
    (10, "a b c d e f g h i j z"),
]
DOCS = [
    (1, "A-b.c d\n e f g h i j and more"),
    (2, "a b c d e f g h i"),
    (3, "one two three one TWO three"),
    (4, "the solo act"),
    (5, None),
    (6, ""),
    (7, "x " * 40),
    (8, "É é a1 b c d e f g h i j k l"),
    (9, "é é a1 b c d e f g h i j k l m"),
    (11, "n0 n1 n2 n3 n4 n5 n6 n7 n8 n9 n10 n11 n12"),
    (12, "word " * 30000 + "a b c d e f g h i j"),
]


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, t) for i, t in DOCS], "doc_id long, text string, FP string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert result(winnowing.contamination(docs, items)) == brute(DOCS, ITEMS)
    kept = winnowing.clean(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in brute(DOCS, ITEMS).items() if not r[-1]}


def test_items_of_every_length(spark):
    made = {n: " ".join(f"t{n}x{i}" for i in range(n)) for n in range(1, 12)}
    docs = [(n, f"some words {text} and more") for n, text in made.items()]
    docs += [(100 + n, f"some words {text.rsplit(' ', 1)[0]} and more") for n, text in made.items() if n > 1]  # a word short
    docs.append((200, "t10x0 t10x1 t10x2 t10x3 t10x4 " + made[5]))  # 5 words of a long item don't count
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = result(winnowing.contamination(frame, spark.createDataFrame(list(made.items()), "item_id long, text string")))
    assert got == brute(docs, made.items())
    assert all(got[n][1:3] == (n, 1) for n in made) and got[200][1:3] == (5, 1)


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty_tables(spark, empty):
    docs = spark.createDataFrame([] if empty == "docs" else DOCS, "doc_id long, text string")
    items = spark.createDataFrame([] if empty == "items" else ITEMS, "item_id long, text string")
    rows = winnowing.contamination(docs, items).collect()
    assert len(rows) == docs.count() and not any(r.contaminated for r in rows)
