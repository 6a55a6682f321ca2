"""Removed bytes against a brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np

from lodestone.llm import suffix_repeats as sr
from lodestone.llm._shared import read


def brute(texts, length=sr.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.md5(d[i : i + length]).digest() for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[hashlib.md5(d[i : i + length]).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def got(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_matches_brute_force_on_a_whole_table(spark, sf):
    docs = read(spark, sf, "documents")
    rows = docs.select("doc_id", "text").collect()
    expected = sorted((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows])))
    assert got(sr.remove_repeats(docs)) == expected
    assert any(r[2] for r in expected)


def cases():
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abcdefghij é") for _ in range(pick.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    texts = [None, "", "short", prose(40), passage, passage, "pre " + passage + " post", prose(30) + passage[40:320] + prose(30)]
    for _ in range(25):  # edits at many offsets of one passage
        at = pick.randrange(len(passage) - 3)
        texts.append(prose(pick.randint(0, 9)) + passage[:at] + "#" + passage[at + 1 :] + prose(pick.randint(0, 9)))
    texts += ["x" * 500, "ab" * 300, "x" * 199, "x" * 200, passage[:199], passage[7:207], passage[7:206] + "%"]
    return texts


def test_edits_runs_and_edges(spark):
    texts = cases()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, th string")
    assert got(sr.remove_repeats(docs)) == sorted((i, *b) for i, b in enumerate(brute(texts)))


def test_a_text_beyond_a_segment(spark):
    pick = random.Random(11)
    noise = "".join(pick.choice("abcdefghij klmnopq") for _ in range(1_200_000))
    texts = [noise, noise[500_000:500_400], "x" + noise[sr.SEGMENT - 150 : sr.SEGMENT + 150] + "y", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = sorted((i, *b) for i, b in enumerate(brute(texts)))
    assert got(sr.remove_repeats(docs)) == expected and expected[0][2] == 700


def test_anchors_depend_on_content_alone():
    data = [(t or "").encode() for t in cases()]
    raw, places = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    for t, one in enumerate(data):
        alone = [x for s in sr.anchors(np.frombuffer(one, np.uint8), np.array([0, len(one)])) for x in zip(s[0], *s[4:])]
        among = [x for s in sr.anchors(raw, places) for x in zip(s[0][s[3] == t], *(c[s[3] == t] for c in s[4:]))]
        assert {x[:2] for x in alone} == {x[:2] for x in among}
        windows = lambda found: {(p - off, p) for _, p, lo, hi in found for off in range(lo, hi + 1)}
        assert windows(alone) == windows(among) and len({s for s, _ in windows(alone)}) == max(0, len(one) - sr.LENGTH + 1)


def test_names_are_of_content_and_length():
    pick = random.Random(2)
    raw = np.frombuffer(bytes(pick.choice(b"ab") for _ in range(40_000)), np.uint8)
    deep = sr._buckets(raw, sr.DEPTH, 0), sr._buckets(raw, sr.DEPTH, 1)
    starts = np.array([pick.randrange(39_000) for _ in range(3000)])
    lengths = np.array([pick.randrange(sr.DEPTH, 3 * sr.DEPTH) for _ in starts])
    names = list(zip(*(sr._spans(deep[lane], starts, lengths, lane).tolist() for lane in (0, 1))))
    strings = [raw[s : s + n].tobytes() for s, n in zip(starts, lengths)]
    assert len(set(names)) == len(set(strings)) == len(set(zip(names, strings)))


def test_repeated_ids_and_empty_table(spark):
    text = "".join(random.Random(3).choice("abcdefgh ") for _ in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "other " * 9), (None, text[50:]), (2, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.n_bytes): r.n_removed for r in sr.remove_repeats(docs).collect()}
    assert rows == {(1, 300): 300, (1, 54): 0, (None, 250): 250, (2, 0): 0}
    assert sr.remove_repeats(docs.limit(0)).count() == 0
