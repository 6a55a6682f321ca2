"""URL verdicts: rules first, then trust and distrust carried over the graph of hosts.

The graph has an edge where a page of one host names an address of another (in an
attribute, a list of sources, a style or the query of another address), and edges both ways between a host and its
parent domain, as far up as a domain has a dot: hosts of one domain answer for each other
in part, as such an edge passes on ``KIN`` of what a link does.

Hosts most of whose ruled pages are allowed are trusted seeds, hosts with blocked ones
distrusted seeds, each with the share of its pages as mass. Trust runs forward along
links (personalised PageRank), distrust backward: who links to blocked hosts earns some.
A host is blocked where distrust exceeds trust by ``THRESHOLD`` or more. All of it is
DataFrame operations; each round is two joins and one aggregation. What hosts are joined with are tables,
so Spark broadcasts a small one and else splits a host that a third of the edges lead to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import ascii_lower, cut, fresh, table

#: (verdict, host, path): a rule holds for the host and its subdomains where the path starts so.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
ROUNDS = 20
KIN = 0.5
#: Half of what a host keeps that is a seed with all its pages.
THRESHOLD = round(0.5 * (1 - DAMPING), 9)
LINKS = r"(?i)(?:https?:|=\s*[\x22\x27]?\s*|,\s*)//([^/?#\x22\x27\s<>()]+)"
#: Hosts that are addresses have no parent domain.
NUMERIC = r"^[0-9.:]*$"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, ties by code point; null if none."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ordered
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst``: each pair of different hosts of which a page of one names an address of the other, once."""
    targets = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINKS), F.lit(1))))
    found = pages.where(F.col(html_col).isNotNull()).select(host_of(F.col(url_col)).alias("src"), targets.alias("dst"))
    return found.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> dst and src <> ''").distinct()


def domains(hosts: DataFrame) -> DataFrame:
    """``src, dst``: edges both ways between each ``host``, its parent domain, and so on up to the last that has a dot."""
    labels = F.split("host", "[.]")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(labels) - 2),
        lambda k: F.struct(F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("src"), F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("dst")),
    )
    some = hosts.where((F.size(labels) > 2) & ~F.col("host").rlike(NUMERIC)).select(F.explode(steps).alias("e")).select("e.src", "e.dst").distinct()
    return some.union(some.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, weight``: the edges of the graph, each once."""
    named = table(links(pages, url_col, html_col), "links")
    hosts = pages.select(host_of(F.col(url_col)).alias("host")).where("host <> ''").union(named.select("dst")).distinct()
    every = named.withColumn("weight", F.lit(1.0)).union(domains(hosts).withColumn("weight", F.lit(KIN)))
    return every.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` of all hosts reached, from ``seeds`` with the same columns and ``edges`` (``src, dst, weight``).

    What a round passes on is summed up, so a round without anything to pass ends it.
    """
    edges = table(edges, "edges")
    out = table(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_out")), "out")
    into = table(edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in")), "into")
    edges = table(edges.join(out, "src").join(into, "dst"), "edges")
    step = cut(seeds.select("host", ((1 - DAMPING) * F.col("trust")).alias("trust"), ((1 - DAMPING) * F.col("distrust")).alias("distrust")).where("trust > 0 or distrust > 0"))
    total = step
    for _ in range(rounds if not edges.isEmpty() else 0):
        ahead = edges.join(step, edges.src == step.host).select(F.col("dst").alias("host"), (DAMPING * F.col("weight") * F.col("trust") / F.col("n_out")).alias("trust"), F.lit(0.0).alias("distrust"))
        back = edges.join(step, edges.dst == step.host).select(F.col("src").alias("host"), F.lit(0.0).alias("trust"), (DAMPING * F.col("weight") * F.col("distrust") / F.col("n_in")).alias("distrust"))
        step = cut(ahead.union(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).where("trust > 0 or distrust > 0"))
        if step.isEmpty():
            break
        total = cut(total.union(step).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    return total


def verdicts(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``id_col, host, path, rule, verdict`` and the host's ``trust`` and ``distrust``.

    Null urls and those without ``://`` have host and path empty, fit no rule and are
    allowed, as is any host that nothing is known of. Null html has no links; html is read
    whole. Repeated rows are judged alike (each counts in its host's shares). Rules that tie in
    length go by code point. An empty table gives no rows.
    """
    host, path = fresh(pages, "host"), fresh(pages, "path")
    judged = pages.select(F.col(id_col), host_of(F.col(url_col)).alias(host), path_of(F.col(url_col)).alias(path))
    judged = judged.withColumn("__rule", matching_rule(F.col(host), F.col(path), rules))
    share = (F.count_if(F.col("__rule.verdict") == "allow") - F.count_if(F.col("__rule.verdict") == "block")) / F.count(F.lit(1))
    seeds = judged.where(F.col(host) != "").groupBy(F.col(host).alias("host")).agg(share.alias("share"))
    seeds = seeds.select("host", F.greatest("share", F.lit(0.0)).alias("trust"), F.greatest(-F.col("share"), F.lit(0.0)).alias("distrust"))
    scores = propagate(seeds, host_edges(pages, url_col, html_col)).withColumnRenamed("host", "__host")
    found = judged.join(scores, F.col(host) == F.col("__host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_method = F.when(F.round(distrust - trust, 9) >= THRESHOLD, "block").otherwise("allow")
    return found.select(
        F.col(id_col), F.col(host).alias("host"), F.col(path).alias("path"), F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", by_method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"),
    )


def sql() -> str:
    """``verdicts`` over ``pages`` in DuckDB's SQL, all rounds spelled out."""
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END"
    lowered = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    fits = lambda x: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v if x else h + p}'" for v, h, p in ordered)
    links = LINKS.replace("'", "''")
    ctes = [
        f"p AS MATERIALIZED (SELECT page_id, html, coalesce({lowered(f'regexp_extract({rest}, $$^[^/?#]*$$, 0)')}, '') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"j AS MATERIALIZED (SELECT page_id, host, path, CASE {fits(0)} END AS rule, CASE {fits(1)} END AS v FROM p)",
        f"l AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, {lowered('dst')} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{links}', 1)) AS dst FROM p)) WHERE src <> dst AND src <> '')",
        "h AS (SELECT DISTINCT string_split(host, '.') AS w FROM (SELECT host FROM p WHERE host <> '' UNION SELECT dst FROM l) WHERE NOT regexp_matches(host, '^[0-9.:]*$'))",
        "o AS (SELECT DISTINCT array_to_string(w[k:], '.') AS src, array_to_string(w[k + 1:], '.') AS dst FROM h, unnest(range(1, len(w) - 1)) AS t(k))",
        f"e0 AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, 1.0::DOUBLE AS w FROM l UNION ALL SELECT src, dst, {KIN}::DOUBLE FROM o UNION ALL SELECT dst, src, {KIN}::DOUBLE FROM o) GROUP BY src, dst)",
        "e AS MATERIALIZED (SELECT src, dst, w, count(*) OVER (PARTITION BY src) AS n_out, count(*) OVER (PARTITION BY dst) AS n_in FROM e0)",
        "s AS (SELECT host, (count(*) FILTER (v = 'allow') - count(*) FILTER (v = 'block')) / count(*) AS share FROM j WHERE host <> '' GROUP BY host)",
        f"r0 AS MATERIALIZED (SELECT host, {1 - DAMPING!r} * greatest(share, 0.0::DOUBLE) AS t, {1 - DAMPING!r} * greatest(-share, 0.0::DOUBLE) AS d FROM s)",
    ]
    for k in range(ROUNDS):
        ctes.append(
            f"r{k + 1} AS MATERIALIZED (SELECT host, sum(t) AS t, sum(d) AS d FROM (SELECT dst AS host, {DAMPING} * w * t / n_out AS t, 0.0::DOUBLE AS d FROM e JOIN r{k} ON src = host UNION ALL SELECT src, 0.0::DOUBLE, {DAMPING} * w * d / n_in FROM e JOIN r{k} ON dst = host) GROUP BY host)"
        )
    union = " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(ROUNDS + 1))
    ctes.append(f"score AS (SELECT host, sum(t) AS t, sum(d) AS d FROM ({union}) GROUP BY host)")
    return f"WITH {', '.join(ctes)} SELECT page_id, j.host AS host, path, rule, coalesce(v, CASE WHEN round(coalesce(d, 0) - coalesce(t, 0), 9) >= {THRESHOLD!r} THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN score ON j.host = score.host"
