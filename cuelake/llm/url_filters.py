"""URL filters: rules by host and path, and link-graph propagation where no rule fits.

Hosts of pages that a rule allows are trusted, hosts of pages that one blocks are not. Personalised
PageRank carries trust along links and distrust against them: who links to a blocked host earns
distrust. A score counts visits: of a walk that begins at a seed host, by its share of the seed pages,
and goes on with the damping's chance, measured by those of an average seed host. A host whose distrust
exceeds its trust, and a small prior, by a factor is blocked; so neither the number of pages nor that of
hosts elsewhere moves a verdict. DataFrame functions alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

#: (host, path, verdict): fits the host and its subdomains where the path starts so; the longest rule wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING, FACTOR = 0.85, 2.0
#: Trust that every host has, in visits of an average seed host: what the evidence against it must exceed.
PRIOR = 0.35
#: Rounds go on until another ROUNDS_PER_WRITE of them add less than this share; each round adds at most DAMPING of what the one before added.
TOLERANCE, ROUNDS_PER_WRITE = 1e-4, 4
LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
_URL = "://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, _URL, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null. One branch a rule: for lists of up to hundreds."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: how many pages of one host link to another. Relative links stay on their host and make none."""
    host, _ = host_and_path(F.col(url_col))
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER)))
    links = pages.select(host.alias("src"), F.explode(targets).alias("dst")).filter("src <> '' AND src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank. links: src, dst, n. seeds: host, seed. Returns host, score for every host that a walk reaches.

    score: the visits that a walk pays it, begun at a seed host by its share of all seeds and going on at each step with
    the chance `damping`. Where a host has no links the walk ends, and the next one begins: PageRank with that mass given
    back to the seeds is this, up to a common factor. A round is one join on the host and one sum with map-side partials.
    """
    total = lambda of, c: of.agg(F.sum(c)).first()[0] or 0.0  # noqa: E731  # one number
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    share = materialize(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "shares")
    base = seeds.select("host", (F.col("seed").cast("double") / F.lit(total(seeds, "seed") or 1.0)).alias("score"))
    if share.isEmpty():  # nowhere to go
        return base
    base = materialize(base, "seeds")
    rank, known, grown = base, 1.0, True
    while grown:
        for _ in range(ROUNDS_PER_WRITE):
            moved = share.join(rank.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (damping * F.col("share") * F.col("score")).alias("score"))
            rank = base.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score"))
        rank = materialize(rank, "rank")
        before, known = known, total(rank, "score")
        grown = known - before > tolerance * known
    return rank


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", factor: float = FACTOR) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict (allow or block).

    A null url, or one without ://, has an empty host and path, no rule and is allowed. A null html has no links.
    Hosts that neither trust nor distrust reaches are allowed. Repeated rows give repeated results and count
    repeatedly as seeds and links; all pages so many times over get the same verdicts. Other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    ruled = F.col("found.verdict")
    seeds = materialize(rows.filter("found IS NOT NULL AND host <> ''").groupBy("host").agg(F.count_if(ruled == "allow").alias("allowed"), F.count_if(ruled == "block").alias("blocked")), "seeds")
    links = materialize(host_links(pages, url_col, html_col), "host-links")
    trust = propagate(links, seeds.filter("allowed > 0").select("host", F.col("allowed").alias("seed")))
    against = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(against, seeds.filter("blocked > 0").select("host", F.col("blocked").alias("seed")))
    seeded = lambda c: seeds.filter(F.col(c) > 0).count()  # noqa: E731  # one number
    trusted, distrusted = seeded("allowed"), seeded("blocked")
    enough = factor * (F.coalesce("trust", F.lit(0.0)) * trusted + PRIOR)
    bad = distrust.toDF("host", "distrust").join(trust.toDF("host", "trust"), "host", "left").filter(F.col("distrust") * distrusted > enough).select("host", F.lit("block").alias("by_links"))
    out = rows.join(bad, "host", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce(ruled, F.col("by_links"), F.lit("allow")).alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


#: As many rounds as the tolerance can need.
_ORACLE_ROUNDS = math.ceil(math.log(TOLERANCE * (1 - DAMPING)) / math.log(DAMPING))


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    fits = "".join(
        f" WHEN (host = {quote(h)} OR ends_with(host, {quote('.' + h)})) AND starts_with(path, {quote(p)}) THEN {{}}" for h, p, _ in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    )
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    rule = "CASE" + fits.format(*(quote(h + p) for h, p, _ in ordered)) + " END"
    verdict = "CASE" + fits.format(*(quote(v) for *_, v in ordered)) + " END"
    sql = f"""
WITH p AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, {quote(_URL)}, 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, {quote(_URL)}, 2), '') AS path
  FROM pages
),
j AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS ruled FROM p),
s AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow') AS allowed, count(*) FILTER (WHERE ruled = 'block') AS blocked FROM j WHERE ruled IS NOT NULL AND host <> '' GROUP BY host),
h AS (SELECT DISTINCT page_id, host AS src, translate(dst, '{_UPPER}', '{_LOWER}') AS dst
  FROM (SELECT page_id, host, unnest(regexp_extract_all(coalesce(html, ''), {quote(LINK)}, 1)) AS dst FROM p)),
l AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM h WHERE src <> '' AND src <> dst GROUP BY src, dst)"""
    for name, seed, src, dst in (("t", "allowed", "src", "dst"), ("d", "blocked", "dst", "src")):
        sql += f""",
{name}e AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS share FROM l),
{name}b AS MATERIALIZED (SELECT host, {seed} / sum({seed}) OVER () AS score FROM s WHERE {seed} > 0),
{name}0 AS MATERIALIZED (SELECT * FROM {name}b)"""
        for i in range(_ORACLE_ROUNDS):
            sql += f""",
{name}{i + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT * FROM {name}b UNION ALL SELECT e.dst, {DAMPING!r} * e.share * r.score FROM {name}e e JOIN {name}{i} r ON e.src = r.host) GROUP BY host)"""
        sql += f""",
{name} AS (SELECT * FROM {name}{_ORACLE_ROUNDS})"""
    return (
        sql
        + f""",
n AS (SELECT count(*) FILTER (WHERE allowed > 0) AS trusted, count(*) FILTER (WHERE blocked > 0) AS distrusted FROM s)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN d.score * distrusted > {FACTOR!r} * (coalesce(t.score, 0.0) * trusted + {PRIOR!r}) THEN 'block' END, 'allow') AS verdict
FROM j CROSS JOIN n LEFT JOIN t ON j.host = t.host LEFT JOIN d ON j.host = d.host
"""
    )


ORACLE_SQL = _oracle()
