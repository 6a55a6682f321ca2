"""Benchmark decontamination by winnowing, in DataFrame operations only.

Both sides keep the smallest hash of each window of ``WINDOW`` consecutive k-grams.
``K + WINDOW - 1`` words is the window length of the contract, so any shared window holds
at least one k-gram whose hash both sides keep. A kept hash that meets is a hit; it is
extended word by word to both sides, on the words themselves, and counts if the run
reaches the window length. Items shorter than that are one window of their own length:
for those few lengths (at most nine) every n-gram hash of a document is held, and a hit
must equal the whole item. Equal places of many items are one place with a list of items.

Rows are told apart by id and text, so rows that share an id, null or not, are judged apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import ascii_lower, fresh, same_row, table, text_hash

N = 10
K = 5
WINDOW = N - K + 1
#: Between words; what is left are digits, a-z and all characters beyond ASCII.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), GAPS), ""), F.array().cast("array<string>"))


def _joined(a: Column, b: Column, shift: int, merge) -> Column:
    """``merge`` of each element of ``a`` with the one of ``b`` that lies ``shift`` places on, as long as there is one."""
    n = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1 + shift, n), merge)


def _with_grams(df: DataFrame, n: int, name: str) -> DataFrame:
    """Adds the hashes of the n words from each position that has so many; those of 1, 2, 4 and 8 words are put together."""
    df = df.withColumn("__p1", F.transform("words", lambda w: F.xxhash64(w)))
    both = lambda x, y: F.xxhash64(x, y)
    width = 1
    while width * 2 <= n:
        df = df.withColumn(f"__p{width * 2}", _joined(F.col(f"__p{width}"), F.col(f"__p{width}"), width, both))
        width *= 2
    df, held = df.withColumn("__gram", F.col(f"__p{width}")), width
    while held < n:
        width //= 2
        if held + width <= n:
            df = df.withColumn("__gram", _joined(F.col("__gram"), F.col(f"__p{width}"), held, both))
            held += width
    return df.withColumn(name, F.col("__gram")).drop("__gram", *[f"__p{1 << i}" for i in range(4)])


def _kept_hashes(df: DataFrame, short: list[int]) -> DataFrame:
    """Adds ``fps``: the winnowed hashes of ``words`` and, for each short length, all n-gram hashes."""
    none = F.array().cast("array<bigint>")
    df = _with_grams(df, K, "__m1")
    least = lambda x, y: F.least(x, y)
    df = df.withColumn("__m2", _joined(F.col("__m1"), F.col("__m1"), 1, least)).withColumn("__m4", _joined(F.col("__m2"), F.col("__m2"), 2, least))
    df = df.withColumn("__m6", _joined(F.col("__m4"), F.col("__m2"), 4, least))  # the minimum of WINDOW grams
    for n in short:
        df = _with_grams(df, n, f"__s{n}")
    parts = [F.when(F.size("words") >= N, F.col("__m6")).otherwise(none), *[F.col(f"__s{n}") for n in short]]
    return df.withColumn("fps", F.array_distinct(F.concat(*parts))).drop("__m1", "__m2", "__m4", "__m6", *[f"__s{n}" for n in short])


def _short_lengths(items: DataFrame) -> list[int]:
    n = F.size("words")
    return sorted(r[0] for r in items.where((n > 0) & (n < N)).select(n).distinct().collect())


def _exploded(df: DataFrame, array: Column, name: str, *carry: str) -> DataFrame:
    """A row for each element. Not by a plain explode: the filter on sizes inferred for one is pushed down, and computes the array anew at each step that led to it."""
    return df.select(*carry, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def _numbered(n: int):
    return lambda g, i: F.struct(F.lit(n).alias("n"), (i + 1).alias("i"), g.alias("fp"))


def _places(df: DataFrame, reach: int, carry: list[str]) -> DataFrame:
    """A row for each element ``n, i, fp`` of the array ``at``: these, the n words from position i, and ``reach`` words to either side, nearest first."""
    rows = F.transform(
        "at",
        lambda p: F.struct(
            p["n"].alias("n"),
            p["fp"].alias("fp"),
            p["i"].alias("i"),
            F.slice("words", p["i"], p["n"]).alias("gram"),
            F.reverse(F.slice("words", F.greatest(p["i"] - reach, F.lit(1)), F.least(p["i"] - 1, F.lit(reach)))).alias("before"),
            F.slice("words", p["i"] + p["n"], reach).alias("after"),
        ),
    )
    return _exploded(df, rows, "__r", *carry).select(*carry, "__r.*")


def _item_places(items: DataFrame, short: list[int], reach: int) -> tuple[DataFrame, DataFrame]:
    """The distinct places of the items (``n, fp, place, i_gram, i_before, i_after``) and ``place, item_id``: who holds each.

    Those of the kept k-grams of long items, or the whole of each item of a ``short`` length.
    """
    if short:
        own = [_with_grams(items.where(F.size("words") == n), n, "__g").withColumn("at", F.transform("__g", _numbered(n))) for n in short]
        df = reduce(DataFrame.union, [x.select("item_id", "words", "at") for x in own])
    else:
        df = _with_grams(_kept_hashes(items.where(F.size("words") >= N), []), K, "__g")
        df = df.withColumn("at", F.filter(F.transform("__g", _numbered(K)), lambda p: F.array_contains("fps", p["fp"])))
    rows = _places(df, reach, ["item_id"]).withColumn("place", F.xxhash64("n", "gram", F.lit("|"), "before", F.lit("|"), "after"))
    rows = table(rows.select("item_id", "n", "fp", "place", *[F.col(c).alias(f"i_{c}") for c in ("gram", "before", "after")]), "places")
    first = rows.groupBy("place").agg(F.first(F.struct("n", "fp", "i_gram", "i_before", "i_after")).alias("r")).select("place", "r.*")
    return table(first, "place"), rows.select("place", "item_id").distinct()


def _common(a: str, b: str) -> Column:
    """How many words ``a`` and ``b`` share from their start."""
    same = F.zip_with(F.col(a), F.col(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc, th, place, first, last``, word runs of a document that lie in an item, each at least a window long; and ``place, item_id``.

    ``docs`` has ``doc, th, words``; ``items`` has ``item_id, words``.
    """
    found, held, lengths = None, None, _short_lengths(items)
    for short in [[], lengths] if lengths else [[]]:  # an item may have K words as well
        reach, grams = 0 if short else N - K, docs
        right, owners = _item_places(items, short, reach)
        for n in short or [K]:
            grams = _with_grams(grams, n, f"__g{n}")
        every = F.concat(*[F.transform(f"__g{n}", _numbered(n)) for n in short or [K]])
        met = _exploded(grams, every, "p", "doc", "th").select("doc", "th", "p.*").join(right.select("n", "fp").distinct(), ["n", "fp"], "left_semi")
        met = table(met.groupBy("doc", "th").agg(F.collect_set(F.struct("n", "i", "fp")).alias("at")), "met")
        left = _places(docs.join(met, same_row(docs, met)).select(docs["doc"], docs["th"], "words", "at"), reach, ["doc", "th"])
        run = left.join(right, ["n", "fp"]).where("gram = i_gram")
        run = run.select("doc", "th", "place", "i", "n", _common("before", "i_before").alias("b"), _common("after", "i_after").alias("a"))
        if not short:
            run = run.where(F.col("b") + K + F.col("a") >= N)
        run = run.select("doc", "th", "place", (F.col("i") - 1 - F.col("b")).alias("first"), (F.col("i") + F.col("n") + F.col("a") - 2).alias("last"))
        found, held = (run, owners) if found is None else (found.union(run), held.union(owners))
    return found, held


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies in any occurrence of a window (10 consecutive words of an
    item, or all words of a shorter one). ``items_sha256`` is of the ids of all items with
    a window that occurs, sorted as strings and comma-joined (of the empty string if
    none). Null and empty texts have no words and no hits; items without words match
    nothing; null item ids count as hits but name no item, and items that repeat an id are
    one in the counts. Rows that share an id are judged each by its own text. Empty tables are none contaminated.

    Only hashes that meet are shuffled, and texts of documents that hold one are looked
    at again. What is joined with documents is written as a table first, so Spark broadcasts
    it if small enough and else splits a hash that many documents share.
    """
    rows, per_doc = _judged(docs, benchmark, id_col, text_col, item_col, item_text)
    found = rows.join(per_doc, same_row(rows, per_doc), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return found.select(
        rows["doc"].alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """``doc, th, n_words`` of all rows; ``doc, th, n_hit, n_items, items_sha256`` of the contaminated ones."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("doc"), text_hash(text).alias("th"), text.alias("text"))
    items = table(benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text).cast("string")).alias("words")), "items")
    kept = _kept_hashes(source.select("doc", "th", words(F.col("text")).alias("words")), _short_lengths(items))
    kept = table(kept.select("doc", "th", F.size("words").cast("long").alias("n_words"), "fps"), "fingerprints")
    met = kept.select("doc", "th", F.explode("fps").alias("fp")).join(table(_item_hashes(items), "hashes"), "fp", "left_semi")
    met = table(met.select("doc", "th").distinct(), "met")
    near = source.join(met, same_row(source, met), "left_semi").dropDuplicates(["doc", "th"])
    near = table(near.select("doc", "th", words(F.col("text")).alias("words")), "near")
    runs, owners = hits(near, items)
    runs = table(runs.distinct(), "runs")
    places = runs.select("doc", "th", "place").distinct()
    named = places.join(table(owners, "owners"), "place").groupBy("doc", "th").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    spans = runs.groupBy("doc", "th").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))))
    per_doc = spans.join(named, same_row(spans, named)).select(
        spans["doc"],
        spans["th"],
        F.size(covered).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    )
    return kept.select("doc", "th", "n_words"), table(per_doc, "hit")


def _item_hashes(items: DataFrame) -> DataFrame:
    """``fp``: what the items keep, each hash once."""
    found = _exploded(_kept_hashes(items.where(F.size("words") >= N), []), F.col("fps"), "fp")
    for n in _short_lengths(items):
        found = found.union(_exploded(_with_grams(items.where(F.size("words") == n), n, "__g"), F.col("__g"), "fp"))
    return found.distinct()


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, all columns unchanged.

    A row goes by its own text: others that share its id, null or not, stay. Repeated rows stay or go
    together, null and empty texts stay, and without items all rows do.
    """
    _, bad = _judged(docs, benchmark, id_col, text_col, item_col, item_text)
    key, hashed = fresh(docs, "hit_doc"), fresh(docs, "hit_th")
    bad = bad.select(F.col("doc").alias(key), F.col("th").alias(hashed))
    on = docs[id_col].eqNullSafe(F.col(key)) & (text_hash(docs[text_col].cast("string")) == F.col(hashed))
    return docs.join(bad, on, "left_anti")


def _sql_words(column: str) -> str:
    lowered = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


SQL = f"""
WITH i AS (SELECT item_id, {_sql_words("text")} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), {N}) AS n, array_to_string(w[k:k + least(len(w), {N}) - 1], ' ') AS g FROM i, unnest(range(1, len(w) - least(len(w), {N}) + 2)) AS t(k) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
d AS MATERIALIZED (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
g AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(k)),
hit AS MATERIALIZED (SELECT g.doc_id, g.k, g.n, win.item_id FROM g JOIN win ON g.g = win.g AND g.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
