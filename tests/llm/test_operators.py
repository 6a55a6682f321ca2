"""The other corpus operators against brute force, held-out accuracy or exact round trips, with their edge cases."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import language, line_chunks, linkgraph, mixing, simhash, similar, toxicity, vectors, warc, winnowing
from lodestone.llm._shared import ranked, read
from lodestone.llm.components import connected_components
from lodestone.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, score string, node long, copies int"
LONG = "lorem ipsum dolor sit amet " * 20000


def rows(*texts):
    """Documents with clashing extra columns, a repeated row and a null id."""
    made = [(i, t, ("en", None)[i % 2], (None, "a", "b")[i % 3], "s", 1, 2) for i, t in enumerate(texts)]
    return [*made, made[0], (None, texts[-1], "en", "a", None, None, None)]


def find(roots, x):
    while roots.setdefault(x, x) != x:
        x = roots[x]
    return x


def classes(nodes, links):
    roots = {}
    for n in nodes:
        find(roots, n)
    for a, b in links:
        x, y = sorted((find(roots, a), find(roots, b)))
        roots[y] = x
    return {n: find(roots, n) for n in nodes}


# Components


def test_components_of_chains_stars_and_loops(spark):
    pick = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(200, 260)] + [(5, 5), (7, 8), (8, 7), (None, 3)]
    edges += [(pick.randrange(1000, 1200), pick.randrange(1000, 1200)) for _ in range(120)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    proper = [(a, b) for a, b in edges if a is not None and a != b]
    assert found == classes({x for e in proper for x in e}, proper)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks(spark):
    found = ranked(spark.range(1000).withColumn("k", F.col("id") * 7919 % 1000).repartition(7), [F.col("k")], "place")
    assert all(r.k == r.place for r in found.collect())


# SimHash


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints():
    for text in (None, "", " \t\r\n", "one", "One TWO", "a b c", "É é x\x0by", "a b c d " * 50, LONG[:5000]):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hashes_shingles_alike(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_simhash_classes_on_a_whole_table(spark, sf):
    docs = read(spark, sf, "documents")
    got = simhash.near_duplicates(docs).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) for r in got}
    assert fps == {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert {r.doc_id: r.component_id for r in got} == classes(fps, links)
    assert len(links) > 5 and all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_all_links_within_the_radius_are_found(spark, seed):
    pick = random.Random(seed)
    fps = {pick.getrandbits(64) for _ in range(40)}
    for fp in list(fps):
        for bits in range(1, 5):
            for _ in range(3):
                other = fp
                for b in pick.sample(range(64), bits):
                    other ^= 1 << b
                fps.add(other)
    base = pick.getrandbits(64)
    fps |= {base ^ (1 << i) ^ (1 << j) for i in range(0, 40, 3) for j in range(40)}  # a dense group
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert all(((a ^ b) % 2**64).bit_count() <= 3 and a != b for a, b in found)
    expected = classes(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % 2**64).bit_count() <= 3])
    assert classes(signed, found) == expected


def test_simhash_edges(spark):
    docs = spark.createDataFrame(rows("a b c d e f g h", None, "", "  ", "A b C d e f g h", LONG, LONG), DOCS)
    got = {r.doc_id: (r.component_id, r.kept) for r in simhash.near_duplicates(docs).collect()}
    assert got == {0: (0, True), 1: (1, True), 2: (1, False), 3: (1, False), 4: (0, False), 5: (5, True), 6: (5, False), None: (5, False)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 5]  # of the repeated row one stays
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_unique_texts_stay_under_null_and_repeated_ids(spark, similarity):
    copy = "one text that three rows hold under ids of their own"
    made = [(None, "u n i q u e text here"), (3, copy), (None, copy), (7, "totally other words"), (7, copy), (3, copy)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(made)], "doc_id long, text string, keep long")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs, similarity=similarity).collect()), key=repr)
    assert kept == sorted([made[0], made[1], made[3]], key=repr)
    clean = winnowing.clean(docs, spark.createDataFrame([(1, copy)], "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=repr) == sorted([made[0], made[3]], key=repr)
    judged = winnowing.contamination(docs, spark.createDataFrame([(1, copy)], "item_id long, text string")).collect()
    assert sorted((r.n_words, r.n_hit) for r in judged) == [(3, 0), (8, 0), *[(11, 11)] * 4]


def test_a_crowded_variant_is_dealt_out(spark):
    pick = random.Random(3)
    base = pick.getrandbits(63)
    fps = {base ^ pick.getrandbits(8) for _ in range(200)} | {base ^ (pick.getrandbits(6) << 40) for _ in range(60)}
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), limit=16).collect()
    expected = classes(fps, [(a, b) for i, a in enumerate(sorted(fps)) for b in sorted(fps)[:i] if (a ^ b).bit_count() <= 3])
    assert classes(fps, found) == expected


# Shingle sets


def plain_similar(docs):
    """The ids that stay of (id, text)."""
    words = {d: (t or "").encode().lower().split() for d, t in docs}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return {d for d, root in classes(sets, links).items() if d == root}


def test_one_of_each_similar_group_stays(spark, sf):
    import corpus_pipeline

    pick = random.Random(9)
    made = []
    for _ in range(12):
        base = [str(pick.randrange(10**6)) for _ in range(400)]
        made.append(base)
        for n in range(2, 16):  # up to about 14 words changed: similarities from 0.95 down to below 0.8
            other = list(base)
            for i in pick.sample(range(400), n):
                other[i] = "changed" + str(pick.randrange(10**6))
            made.append(other)
    texts = {i: " ".join(w) for i, w in enumerate(made)} | {9000: None, 9001: " ", 9002: "", 9003: "a B", 9004: "A b", 9005: "c"}
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), sf)
    assert {r.doc_id for r in kept.collect()} == plain_similar(texts.items())
    docs = read(spark, sf, "documents")
    assert {r.doc_id for r in simhash.keep_one(docs, similarity=0.8).collect()} == plain_similar([(r.doc_id, r.text) for r in docs.collect()])


def plain_sketch(text):
    words = (text or "").encode().lower().split()
    hashes = {xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))} if words else set()
    found = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    return found - 2**64 if found >= 2**63 else found


def test_balls_nominate_and_shingle_sets_decide(spark, sf, monkeypatch):
    import corpus_pipeline

    pick = random.Random(4)
    texts = {900: None, 901: "", 902: "one", 903: "one two", 904: "a b c d e f"}
    for g in range(8):
        base = [str(pick.randrange(10**6)) for _ in range(600)]
        for k, n in enumerate((0, 1, 1, 2, 2, 4, 60)):
            other = list(base)
            for i in pick.sample(range(600), n):
                other[i] = str(pick.randrange(10**6))
            texts[10 * g + k] = " ".join(other)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    # the stage hands the SimHash of every shingle set to the balls
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *a, **k: seen.extend(r.fp for r in fps.collect()) or links(fps, *a, **k))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    sketches = {d: plain_sketch(t) for d, t in texts.items()}
    assert sorted(seen) == sorted(set(sketches.values()))
    assert kept == plain_similar(texts.items())

    # without bands, what balls connect is linked if the sets are alike, and nothing else
    rows = similar.keyed(docs)
    bare = similar.distinct_sets(rows).withColumn("keys", F.array().cast("array<long>"))
    rooted = lambda sets: {r.doc: r.root for r in similar.classes(docs, rows, simhash.with_balls(sets), 0.8).collect()}
    found = rooted(bare)
    near = [(a, b) for a in texts for b in texts if a < b and ((sketches[a] ^ sketches[b]) % 2**64).bit_count() <= 3]
    by_balls = classes(texts, near)
    words = {d: (t or "").split() for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    linked = classes(texts, [(a, b) for a, b in alike if by_balls[a] == by_balls[b]])
    assert all((found[a] == found[b]) == (linked[a] == linked[b]) for a in texts for b in texts)
    assert len(near) > 20 and len(set(linked.values())) > len(set(classes(texts, alike).values()))  # balls link some, not all

    # one ball around everything: the sets alone decide
    found, linked = rooted(bare.withColumn("fp", F.lit(0).cast("long"))), classes(texts, alike)
    assert all((found[a] == found[b]) == (linked[a] == linked[b]) for a in texts for b in texts)


# Toxicity


def zipped(n, seed, toxic):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    return " ".join([pick.choice(words) for _ in range(n)] + (["idiot"] if toxic else []))


def test_toxicity_on_held_out_documents(spark):
    made = [(i, zipped(60, i, i % 7 == 0)) for i in range(1500)] + [(None, None), (2000, ""), (0, zipped(60, 0, True)), (2001, LONG + " idiot")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(1500)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.judged(docs, labels).collect()
    assert len(got) == len(made) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1500]
    assert not any(r.predicted for r in held if r.doc_id % 7)
    assert sum(r.predicted for r in held if r.doc_id % 7 == 0) >= 0.85 * sum(r.doc_id % 7 == 0 for r in held)
    assert {r.doc_id: r.score for r in got}[2001] > 0.5 > {r.doc_id: r.score for r in got}[2000]
    clash = docs.withColumn("toxicity", F.lit("x")).withColumn("score", F.lit(1))
    kept = toxicity.reject(clash, labels)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_toxicity_without_two_kinds_of_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    found = toxicity.judged(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len({r.score for r in found.collect()}) == 1
    assert toxicity.judged(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_pairs_of_terms_are_learned():
    pick = np.random.default_rng(1)
    both = [np.unique(np.concatenate([pick.integers(100, 160, 8), [x for x, on in ((1, pick.random() < 0.5), (2, pick.random() < 0.5)) if on]])) for _ in range(4000)]
    labels = np.array([int(1 in x and 2 in x) for x in both])
    machine = toxicity.fit(labels, [x.astype(np.int64) for x in both])
    score = lambda *b: machine.score([machine.place[x] for x in b if x in machine.place])
    assert score(1, 2) > 0.9 and max(score(1), score(2), score()) < toxicity.THRESHOLD


def test_toxicity_on_the_labelled_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    machine = toxicity.train(docs, labels)
    held = docs.where(toxicity.held_out(F.col("doc_id"))).join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id").select("toxic", "text")
    recall, share = {}, {}
    for name, one in (("pairs", machine), ("none", replace(machine, factors=machine.factors * 0))):
        got = toxicity.score(held, one).select("toxic", "score").toPandas()
        recall[name], share[name] = (float((got.score[got.toxic == y] >= toxicity.THRESHOLD).mean()) for y in (1, 0))
    assert recall["pairs"] >= 0.75 and share["pairs"] <= 0.01 and recall["pairs"] >= recall["none"] + 0.1


def test_scores_sum_all_pairs():
    pick = np.random.default_rng(4)
    machine = toxicity.Machine(0.3, pick.normal(size=30), pick.normal(size=(30, toxicity.FACTORS)), {i: i for i in range(30)}, 1.7, -0.2)
    for n in (0, 1, 2, 9):
        rows = pick.choice(30, n, replace=False).tolist()
        raw = 0.3 + sum(machine.weights[i] for i in rows) + sum(machine.factors[i] @ machine.factors[j] for i in rows for j in rows if i < j)
        assert machine.score(rows) == pytest.approx(1 / (1 + np.exp(-(1.7 * raw - 0.2))))


def test_rows_that_share_one_rare_term_all_count():
    pick = np.random.default_rng(2)
    labels = np.array([0] * 540 + [1] * 60)
    common = lambda: pick.integers(100, 160, 8).tolist()
    made = [np.unique([*common(), 1000 + i % 60, *([1] if y else [])]) for i, y in enumerate(labels)]
    assert toxicity.fit(labels, made).score([]) < 0.5
    machine = toxicity.fit(labels, made)
    score = machine.score([machine.place[1]]) if 1 in machine.place else 0
    assert score > 0.9 and (toxicity.witness_weights(labels, made) == 1).sum() > 500


def test_near_copies_of_one_label_share_one_weight():
    pick = random.Random(6)
    sets = [frozenset(pick.sample(range(300), pick.randint(1, 30))) for _ in range(60)] + [frozenset()] * 2
    sets += [x ^ frozenset(pick.sample(range(300), pick.randint(0, 4))) for x in sets for _ in range(3)]
    labels = np.array([pick.randint(0, 1) for _ in sets])
    like = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    expected = [1 / sum(like(x, y) and k == m for y, m in zip(sets, labels)) for x, k in zip(sets, labels)]
    assert toxicity.witness_weights(labels, [np.array(sorted(x), np.int64) for x in sets]).tolist() == pytest.approx(expected)
    assert min(expected) < 0.5


# Lines


def test_chunks_join_to_the_text():
    for text in ("", "a", "a\n", "\n\n\n", "a\nb\nc\n" * 50, LONG):
        assert "\n".join(line for c in line_chunks.chunks(text) for line in c) == text
    assert line_chunks.chunks(None) == []


def plain_lines(docs):
    """What stays of each (id, text), rows in order of id."""
    seen, out = {}, {}
    for doc, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, xxhash_of(d[1]))):
        kept = []
        for no, lines in enumerate(line_chunks.chunks(text)):
            body = "\n".join(lines)
            if sum(bool(x.strip()) for x in lines) >= line_chunks.MIN_LINES:
                if body in seen:
                    continue
                seen[body] = (doc, no)
            kept += lines
        out[doc, text] = None if text is None else "\n".join(kept)
    return out


def xxhash_of(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def test_lines_on_a_whole_table(spark, sf):
    docs = read(spark, sf, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    expected = plain_lines(list(before.items()))
    got = line_chunks.dedup_lines(docs).collect()
    assert {(r.doc_id, before[r.doc_id]): r.text for r in got} == expected
    assert any(r.n_removed_chunks for r in got)


def test_shared_lines_are_found_after_insertions(spark):
    pick = random.Random(4)
    line = lambda: " ".join(str(pick.randrange(10**6)) for _ in range(5))
    shared = [line() for _ in range(60)]
    texts = ["\n".join(shared), "\n".join([line(), line(), line(), *shared]), None, "", LONG, "\n".join([*shared, line()])]
    docs = spark.createDataFrame(rows(*texts), DOCS.replace("node long", "n_lines long"))
    got = line_chunks.dedup_lines(docs)
    assert got.columns == [*docs.columns, "_n_lines", "n_removed_lines", "n_chunks", "n_removed_chunks"]
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(texts) + 2 and found[2].text is None and found[3].text == "" and found[4].text == LONG
    assert found[1].n_removed_lines > 25 and found[5].n_removed_lines > 25
    expected = {d: t for (d, _), t in plain_lines([(r[0], r[1]) for r in rows(*texts)]).items()}
    assert {d: r.text for d, r in found.items()} == expected
    assert line_chunks.dedup_lines(docs.limit(0)).count() == 0


def plain_passages(docs):
    """The same for passages, line by line."""
    first, out = {}, {}
    blank = lambda x: not x.strip()
    for doc, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, xxhash_of(d[1]))):
        lines, gone = [] if text is None else text.split("\n"), set()
        for start in range(len(lines)):
            for end in range(start + 1, len(lines) + 1):
                part = lines[start:end]
                full = sum(not blank(x) for x in part)
                if full > 2 or blank(part[0]):
                    break
                single = end == start + 1 and (len(part[0].split()) >= 50 or len(part[0]) >= 250)
                if single or (full == 2 and not blank(part[-1])):
                    body = tuple(part)
                    if first.setdefault(body, (doc, text, start)) != (doc, text, start):
                        gone |= set(range(start, end))
        kept = [x for i, x in enumerate(lines) if i not in gone]
        out[doc, text] = None if text is None else "" if gone and all(map(blank, kept)) else "\n".join(kept)
    return out


def test_passages_on_a_whole_table(spark, sf):
    before = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    got = line_chunks.dedup_passages(read(spark, sf, "documents")).collect()
    assert {(r.doc_id, before[r.doc_id]): r.text for r in got} == plain_passages(list(before.items()))
    lines = lambda texts: {x for t in texts for x in (t or "").split("\n") if x.strip()}
    assert lines(r.text for r in got) == lines(before.values())


def test_shared_passages_go_whole_inside_foreign_lines(spark):
    pick = random.Random(5)
    line = lambda n=5: " ".join(str(pick.randrange(10**6)) for _ in range(n))
    shared = [[line() for _ in range(n)] for n in range(2, 9)] + [[line(60)], ["字" * 300], [line(), "", line()]]
    texts = ["\n".join(x for s in shared for x in [line(), *s]), *["\n".join([line(), *s, line()]) for s in shared]]
    texts += ["\n\n" + "\n".join(shared[0]) + "\n", "lone\n" + line(), "lone\n" + line(), "x\nx\nx", None, ""]
    docs = spark.createDataFrame(rows(*texts), DOCS)
    found = {r.doc_id: r for r in line_chunks.dedup_passages(docs).collect()}
    assert all(found[i + 1].n_removed_lines == len(s) for i, s in enumerate(shared))
    assert {i: r.text for i, r in found.items()} == {d: t for (d, _), t in plain_passages([r[:2] for r in rows(*texts)]).items()}
    n = len(shared)
    assert found[0].text == texts[0] and found[n + 1].text == "" and found[n + 2].n_removed_lines == found[n + 3].n_removed_lines == 0


# WARC


def test_records_round_trip(spark, tmp_path):
    big = "x" * (3 * warc.CHUNK + 5)
    data = [(5, "http://a/\r\nX: y", "é" * 10), (3, None, "é" * 10), (4, "u", None), (9, "u", ""), (7, "b", big), (8, "b", big), (8, "b", big), (None, "n", "alone"), (None, "n", big)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload_bytes", F.lit(1))
    folder, manifest = warc.write(pages)
    chunks = warc.read_chunks(folder, manifest).collect()
    bodies = defaultdict(list)
    for r in sorted(chunks, key=lambda r: r.chunk_no):
        assert r.data is None or len(r.data) <= warc.CHUNK
        if r.record_type == "response":
            bodies[r.record_id].append(bytes(r.data or b""))
    assert b"".join(bodies["<urn:page:7>"]) == big.encode() and len(bodies["<urn:page:7>"]) == 4
    for part in (r for r in chunks if r.record_id == "<urn:page:7>"):
        upto = big.encode()[: part.payload_bytes]
        assert part.payload_digest == base64.b32encode(hashlib.sha1(upto).digest()).decode()
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=repr)
    n = len(big)
    expected = [(3, 20, "response", None), (5, 20, "revisit", 3), (4, 0, "response", None), (9, 0, "revisit", 4), (7, n, "response", None), (8, n, "revisit", 7), (8, n, "revisit", 7), (None, 5, "response", None), (None, n, "revisit", 7)]
    assert got == sorted(expected, key=repr)
    small = {r.page_id: r.record_type for r in warc.round_trip(pages.where("page_id is not null"), least=21).collect()}
    assert small[5] == small[9] == "response" and small[8] == "revisit"
    kept, _ = warc.write(pages, folder=str(tmp_path / "kept"))
    assert kept == f"file:{tmp_path}/kept" and any(x.suffix == ".gz" for x in (tmp_path / "kept").iterdir())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_a_damaged_archive_stops_the_job(spark, tmp_path):
    archive = warc.Archive(f"file:{tmp_path}")
    archive.add(1, "u", memoryview(b"payload"), None)
    name, records, size = archive.close()
    import gzip

    path = tmp_path / name
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"payload", b"paYload")))
    manifest = spark.createDataFrame([(name, records, size)], "name string, records long, bytes long")
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read_chunks(f"file:{tmp_path}", manifest).collect()


# Links between hosts


def test_rules_and_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Www.Example.NET/en/1", "http://example.net/fr", "http://a.net", "http://a.net/", "http://xnet/", "http://b.example.com/de/?q", "http://b.example.com/x", "http://o.org/fr/#f", "http://q.org?x=/fr/", "x://É.NET:80/p"]
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in linkgraph.verdicts(pages).collect()}
    assert [got[i].host for i in range(len(urls))] == ["", "", "", "", "www.example.net", "example.net", "a.net", "a.net", "xnet", "b.example.com", "b.example.com", "o.org", "q.org", "É.net:80"]
    assert [got[i].path for i in (4, 6, 7, 9, 11, 12)] == ["/en/1", "", "/", "/de/", "/fr/", ""]
    assert [got[i].rule for i in range(len(urls))] == [None] * 4 + ["example.net/en/", "net/", None, "net/", None, "example.com/de/", None, "org/fr/", None, None]
    assert got[0].verdict == "allow" and got[5].verdict == "block" and got[4].verdict == "allow"
    assert linkgraph.verdicts(pages.limit(0)).count() == 0


def plain_propagation(seeds, weights):
    edges = sorted(weights)
    out, into = Counter(a for a, _ in edges), Counter(b for _, b in edges)
    step = {h: (t * (1 - linkgraph.DAMPING), d * (1 - linkgraph.DAMPING)) for h, (t, d) in seeds.items()}
    total = dict(step)
    for _ in range(linkgraph.ROUNDS):
        new = defaultdict(lambda: [0.0, 0.0])
        for a, b in edges:
            new[b][0] += linkgraph.DAMPING * weights[a, b] * step.get(a, (0, 0))[0] / out[a]
            new[a][1] += linkgraph.DAMPING * weights[a, b] * step.get(b, (0, 0))[1] / into[b]
        step = {h: tuple(x) for h, x in new.items()}
        for h, (t, d) in step.items():
            total[h] = (total.get(h, (0, 0))[0] + t, total.get(h, (0, 0))[1] + d)
    return total


def test_propagation(spark):
    pick = random.Random(1)
    hosts = [f"h{i}" for i in range(12)]
    edges = sorted({(a, b) for a in hosts for b in hosts if a != b and pick.random() < 0.2})
    weights = {e: pick.choice([1.0, 0.5]) for e in edges}
    seeds = {"h0": (1.0, 0.0), "h1": (0.0, 1.0), "h2": (0.3, 0.0)}
    got = linkgraph.propagate(spark.createDataFrame([(h, *x) for h, x in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame([(*e, w) for e, w in weights.items()], "src string, dst string, weight double"))
    expected = {h: x for h, x in plain_propagation(seeds, weights).items() if max(x) > 0}
    found = {r.host: (r.trust, r.distrust) for r in got.collect()}
    assert set(found) == set(expected) and all(found[h] == pytest.approx(expected[h]) for h in expected)


def test_linking_to_blocked_hosts_is_blocked(spark):
    link = lambda *hosts: "".join(f"<a href='//{h}/x'>y</a>" for h in hosts)
    pages = [(1, "http://bad.net/x", None), (2, "http://fan.example.com/x", link("bad.net", "BAD.net")), (3, "http://calm.example.com/x", link("calm.example.com")), (4, "http://bad.net/y", "")]
    got = {r.page_id: r.verdict for r in linkgraph.verdicts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block"}


def plain_verdicts(pages, links):
    """By definition from (id, host, path) and pairs of hosts."""
    rules = sorted(linkgraph.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    ruled = {i: next((v for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), None) for i, host, path in pages}
    edges = {(a, b): 1.0 for a, b in links if a != b}
    for host in {h for _, h, _ in pages} | {b for _, b in edges}:
        while host.count(".") > 1:
            parent = host.split(".", 1)[1]
            edges = {(host, parent): linkgraph.KIN, (parent, host): linkgraph.KIN} | edges
            host = parent
    seeds = {}
    for host in {h for _, h, _ in pages}:
        mine = [ruled[i] for i, h, _ in pages if h == host]
        share = (mine.count("allow") - mine.count("block")) / len(mine)
        seeds[host] = (max(share, 0.0), max(-share, 0.0))
    total = plain_propagation(seeds, edges)
    alone = {h: (t * (1 - linkgraph.DAMPING), d * (1 - linkgraph.DAMPING)) for h, (t, d) in seeds.items()}
    by = lambda scores, h: "block" if round(scores[h][1] - scores[h][0], 9) >= linkgraph.THRESHOLD else "allow"
    return {i: ruled[i] or by(total, h) for i, h, _ in pages}, {i: ruled[i] or by(alone, h) for i, h, _ in pages}


def test_verdicts_by_brute_force(spark):
    pick = random.Random(12)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "m") for b in ("one", "two", "six", "ten", "far") for c in ("org", "net", "com", "example.com", "example.net")]
    shapes = ["<a HREF='https://{}/x'>", '<img srcset="/y 1x, //{}/z 2x">', "<base href=//{}>", '<form action="http://{}?q=1">', '<a href="/go?url=http://{}/t">', "<p style='background:url(https://{})'>"]
    pages, edges, rows_ = [], [], []
    for i in range(220):
        host, path = pick.choice(hosts), pick.choice(["/", "/en/a", "/de/b", "/fr/c", ""])
        to = [pick.choice(hosts) for _ in range(pick.randrange(4))] if host.startswith("www") else []
        pages.append((i, host, path))
        edges += [(host, t) for t in to]
        rows_.append((i, f"http://{host}{path}", "<a href='/local'>" + "".join(pick.choice(shapes).format(t.upper() if pick.random() < 0.2 else t) for t in to) + "x" * pick.choice([0, 100_000]), "clash"))
    rows_ += rows_[:3]
    frame = spark.createDataFrame(rows_, "page_id long, url string, html string, trust string")
    expected, alone = plain_verdicts([*pages, *pages[:3]], edges)
    got = {r.page_id: r.verdict for r in linkgraph.verdicts(frame).collect()}
    assert got == expected
    assert sum(expected[i] != alone[i] for i in expected) >= 10  # propagation decides some


def test_verdicts_of_the_table(spark, sf):
    got = {r.page_id: (r.host, r.path, r.verdict) for r in linkgraph.verdicts(read(spark, sf, "pages")).collect()}
    expected, _ = plain_verdicts([(i, h, p) for i, (h, p, _) in got.items()], [])
    assert {i: v for i, (_, _, v) in got.items()} == expected


# Vectors


def test_vectors_against_all_pairs(spark):
    pick = np.random.default_rng(3)
    far = pick.standard_normal((150, 16))
    near = np.concatenate([far[:40] + 0.02 * pick.standard_normal((40, 16)) for _ in range(3)])
    wide = far[50] + 0.28 * pick.standard_normal((60, 16))  # a component that no pivot covers
    data = np.concatenate([far, near, wide]).tolist()
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] * 16]
    ids = list(range(len(data)))
    frame = spark.createDataFrame([(i, v, "x") for i, v in zip([*ids, *range(1000, 1000 + len(bad)), None], [*data, *bad, data[0]])], "vec_id long, embedding array<double>, component string")
    unit = np.array(data) / np.linalg.norm(data, axis=1, keepdims=True)
    linked = unit @ unit.T >= vectors.THRESHOLD
    np.fill_diagonal(linked, False)
    copies = linked[0].astype(int)  # of the row under a null id
    copies[0] = 1
    expected = classes(ids, [(i, j) for i, j in zip(*np.nonzero(linked))])
    got = {r.vec_id: r for r in vectors.near_duplicates(frame).collect()}
    assert len(got) == frame.count()
    assert sum(got[i].component_id == expected[i] for i in ids) >= 0.98 * len(ids)
    assert sum(got[i].n_links for i in ids) >= 0.98 * linked.sum() and all(got[i].n_links <= linked[i].sum() + copies[i] for i in ids)
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1000 + len(bad)))
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (got[0].n_links, 0, False)  # a copy of the first
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_rows_that_repeat_an_id_all_take_part(spark):
    a, b, c = np.random.default_rng(1).standard_normal((3, 32))
    made = [(1, a), (1, b), (2, a + 0.01 * c), (3, b + 0.01 * c), (3, c), (4, 2 * c), (5, a), (1, a), (None, c)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in made], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(frame).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 1, 1), (2, 3, 1), (3, 1, 1), (3, 2, 3), (4, 2, 3), (5, 3, 1), (1, 3, 1), (None, 2, 3)], key=repr)


def planted(n, seed):
    """Random vectors, and pairs in bands of cosines: the pairs by band."""
    pick = np.random.default_rng(seed)
    data = pick.standard_normal((n, 64)).astype(np.float32)
    bands, at = {}, 0
    for low, high in ((0.901, 0.92), (0.92, 0.95), (0.95, 1.0)):
        for _ in range(200):
            x = data[at] / np.linalg.norm(data[at])
            y = pick.standard_normal(64)
            y -= (y @ x) * x
            cosine = pick.uniform(low, high)
            data[at + 1] = 3 * (cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y))
            bands.setdefault((low, high), []).append((at, at + 1))
            at += 2
    return data, bands


def test_recall_among_many_vectors(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    data, bands = planted(100_000, 7)
    pq.write_table(pa.table({"vec_id": np.arange(len(data)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(data.ravel()), 64).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    got = vectors.near_duplicates(spark.read.parquet(str(tmp_path / "v.parquet"))).where("n_links > 0").select("vec_id", "component_id").toPandas()
    root = dict(zip(got.vec_id, got.component_id))
    found = {band: np.mean([root.get(a) == root.get(b, -1) for a, b in pairs]) for band, pairs in bands.items()}
    assert found[0.901, 0.92] >= 0.95 and found[0.92, 0.95] >= 0.98 and found[0.95, 1.0] >= 0.99
    assert len(got) <= 1200  # nothing else is linked
    print(found)


# Mixing


def plain_targets(sizes):
    left, total = dict(sizes), sum(sizes.values())
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    capped = {}
    while True:
        rest, weights = total - sum(capped.values()), sum(weight[s] for s in left if s not in capped)
        share = {s: rest * weight[s] / weights for s in left if s not in capped} if weights else {}
        over = {s: 3 * sizes[s] for s, x in share.items() if x > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mixing(spark):
    pick = random.Random(8)
    made = [(i, "w " * pick.randint(1, 400), f"s{min(9, int(pick.expovariate(0.4)))}") for i in range(6000)]
    made += [(9000, None, "s0"), (9001, " ", "empty"), (9002, LONG, None), (9002, LONG, None), (None, "a b", "s1")]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs)
    found = got.collect()
    sizes, taken = Counter(), Counter()
    for _, text, source in made:
        sizes[source] += len((text or "").split())
    expected = plain_targets(sizes)
    assert len(found) == len(made) and all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in found)
    source_of = {i: s for i, _, s in made}
    for r in found:
        assert r.target == pytest.approx(expected[source_of[r.doc_id]]) and r.source_size == sizes[source_of[r.doc_id]]
        taken[source_of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - t) <= (400 if s is not None else 100000) for s, t in expected.items())
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(mixing.mix(docs.repartition(13)).collect()) == key(found)
    repeated = mixing.repeat(docs)
    assert repeated.columns == [*docs.columns, "copy"] and repeated.count() == sum(r.copies for r in found)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_is_unbiased():
    import pandas as pd

    total = np.zeros(40)
    for trial in range(400):
        ids = list(range(trial * 1000, trial * 1000 + 40))
        group = pd.DataFrame({"doc_id": ids, "th": 0, "size": [5 + i % 7 for i in range(40)], "share": 0.3, "blocks": 1})
        done = mixing._round_block(group).sort_values("doc_id")
        assert set(done["share"]) <= {0.0, 1.0}
        total += done["share"].to_numpy()
    assert abs(total.mean() / 400 - 0.3) < 0.01 and np.abs(total / 400 - 0.3).max() < 0.12


# Languages


def test_languages_on_held_out_documents(spark, sf):
    docs = read(spark, sf, "documents")
    got = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def plain_language(docs):
    """Predictions for (id, text, lang) by definition, from one word to the next. All documents are in the sample."""
    words = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    counts = defaultdict(lambda: defaultdict(Counter))
    for i, text, lang in docs:
        if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for w in words(text):
                counts[0][lang][w] += 1
                for n in (4, 3, 2, 1):
                    counts[n][lang].update(list(w) if n == 1 else [f" {w} "[k : k + n] for k in range(len(w) + 3 - n)])
    langs = sorted(counts[0])
    size = {n: len({t for c in counts[n].values() for t in c}) for n in counts}
    total = {n: {x: sum(counts[n][x].values()) for x in langs} for n in counts}

    def scores(n, term):
        logs = [np.log((counts[n][x][term] + 0.5) / (total[n][x] + 0.5 * size[n])) for x in langs]
        return np.array(logs) - np.mean(logs)

    def of(w):
        if any(w in counts[0][x] for x in langs):
            return scores(0, w)
        for n in (4, 3, 2, 1):
            known = [g for g in (list(w) if n == 1 else [f" {w} "[k : k + n] for k in range(len(w) + 3 - n)]) if any(g in counts[n][x] for x in langs)]
            if known:
                return np.mean([scores(n, g) for g in known], axis=0)
        return np.zeros(len(langs))

    out, seen = {}, {}
    for i, text, _ in docs:
        found = words(text)
        for w in set(found) - set(seen):
            seen[w] = of(w)
        if found:
            mean = np.mean([seen[w] for w in found], axis=0) * min(len(found), 12)
            out[i] = (langs[int(mean.argmax())], 1 / np.exp(mean - mean.max()).sum())
        else:
            out[i] = ("und", 0.0)
    return out


def test_languages_by_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    expected = plain_language([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op9_language_id"](spark, sf).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in expected.items()}
    assert all(got[i][1] == pytest.approx(expected[i][1], abs=1e-6) for i in expected)


def test_backoff_to_shorter_ngrams():
    counted = [("a", 0, "word"), ("b", 0, "wort"), ("a", 3, "ing"), ("b", 2, "ch"), ("b", 1, "ß")]
    fitted = language.tables(*map(list, zip(*counted)), [5] * len(counted))
    assert fitted.predict(["word", "WORT", "zinging", "zzch", "ß", None, "1"])[0] == ["a", "b", "a", "b", "b", "und", "und"]
    langs, scores = fitted.predict(["qqq"])
    assert (langs, scores.tolist()) == (["a"], [0.5])  # nothing known: the first language, at even odds


def test_language_edges(spark):
    docs = spark.createDataFrame(rows("hello world", None, "", "123 ½ Ⅷ ...", LONG, "hello"), DOCS)
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, language.train(docs)).collect()}
    assert [got[i] for i in range(6)] == ["en", "und", "und", "und", "en", "en"] and got[None] == "en"
    assert language.identify(docs.limit(0), language.train(docs)).count() == 0
    none = language.identify(docs, language.train(docs.limit(0))).collect()
    assert len(none) == 8 and {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


# The pipeline


def test_stages(spark, sf):
    import corpus_pipeline

    docs = read(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.table(stage(spark, docs, sf), "stage")
        assert docs.columns == columns, name
        assert 0.5 * before.count() < docs.count() <= before.count(), name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert mixed.columns == [*columns, "copy"] and mixed.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0


def test_all_ten_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 11))
