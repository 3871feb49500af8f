"""URL filters: path rules first, then trust and distrust spread over the host graph. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleryloom.llm.common import salted_join, table
from galleryloom.session import materialize

BLOCK, ALLOW = "block", "allow"
# Host, path, verdict.
RULES = (("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW))
# Share of a host's score that its links pass on, rounds of passing, and the distrust that blocks a host.
DAMPING = 0.85
ROUNDS = 12
BLOCK_AT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host behind the first `://` (A-Z lower-cased) and path behind it; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict, NULL without one; of equally long ones the first in order."""
    name = verdict = None
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, rule_verdict) if verdict is None else verdict.when(fits, rule_verdict)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def host_edges(pages: DataFrame, host: Column, html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted. Relative links stay within a host."""
    links = F.filter(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1)), lambda x: x.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"))
    full = F.transform(links, lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))
    targets = pages.select(host.alias("src"), F.explode(full).alias("_link")).select("src", host_and_path(F.col("_link"))[0].alias("dst"))
    return targets.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: (host, score), in units of a seed's own weight.

    score = seed + damping * sum over incoming links of (score of the source * its share of the source's links).
    `edges` has src, dst, n; `seeds` has host, seed. Each round is one join on the source, with hubs spread
    over many tasks, and one map-side sum; it is written to the shared folder.
    """
    outgoing = edges.groupBy("src").agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_load"))
    outgoing = materialize(outgoing, "outgoing")
    scores = seeds.select("host", F.col("seed").cast("double").alias("score"))
    for _ in range(rounds):
        known = scores.withColumnRenamed("host", "src").join(outgoing.hint("shuffle_merge"), "src")
        passed = salted_join(edges, known, "src", "_load", F.col("dst"), "inner")
        share = F.col("score") * F.col("n") / F.col("_all") * damping
        both = passed.select(F.col("dst").alias("host"), share.alias("score")).union(seeds.select("host", F.col("seed").cast("double")))
        scores = materialize(both.groupBy("host").agg(F.sum("score").alias("score")), "scores")
    return scores


def judge(
    pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int = ROUNDS,
    block_at: float = BLOCK_AT,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust and distrust of the host.

    A page with a fitting rule gets the rule's verdict. Otherwise its host decides: hosts are trusted and
    blocked seeds by the share of their pages that rules allow and block; trust follows links, distrust
    runs against them; a host with distrust of `block_at` or more, and more distrust than trust, is
    blocked, all others are allowed. NULL and malformed urls have empty host and path and are allowed; NULL html has no
    links; repeated pages are judged each and their links count each; an empty table gives an empty result.
    """
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("_ruled", verdict)
    edges = materialize(host_edges(pages.select(url_col, html_col), host, html_col), "edges")
    share = lambda kind: F.avg(F.when(F.col("_ruled") == kind, 1.0).otherwise(0.0))
    hosts = parsed.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("_pages"), share(ALLOW).alias("_trusted"), share(BLOCK).alias("_blocked"))
    hosts = materialize(hosts, "hosts")
    linked = edges.limit(1).count() > 0

    def score(kind: str, directed: DataFrame, name: str) -> DataFrame:
        seeds = hosts.where(F.col(kind) > 0).select("host", F.col(kind).alias("seed"))
        found = spread(directed, seeds, rounds) if linked else seeds.withColumnRenamed("seed", "score")
        return found.select("host", F.col("score").alias(name)).hint("shuffle_merge")

    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    scored = hosts.select("host", "_pages").join(score("_trusted", edges, "trust"), "host", "left").join(score("_blocked", against, "distrust"), "host", "left")
    scored = materialize(scored.fillna(0.0, ["trust", "distrust"]), "scored")
    judged = salted_join(parsed, scored, "host", "_pages", F.xxhash64("_id", "path"))
    bad = (F.col("distrust") >= block_at) & (F.col("distrust") > F.col("trust"))
    return judged.select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_ruled", F.when(bad, BLOCK).otherwise(ALLOW)).alias("verdict"), "trust", "distrust",
    )


def op4_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql_host(url: str) -> str:
    return f"CASE WHEN contains({url}, '://') THEN translate(regexp_extract(substr({url}, strpos({url}, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END"


def _sql_rules(what: int) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[what]}'" for h, p, v in ordered]
    return f"CASE {' '.join(cases)} END"


def _sql_spread(name: str, seed: str, src: str, dst: str) -> str:
    """The rounds of `spread` written out, one table expression each."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT host, {seed} AS score FROM hosts WHERE {seed} > 0)"]
    for i in range(ROUNDS):
        steps.append(
            f"{name}_{i + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT e.{dst} AS host, s.score * e.n / e.{src}_all * {DAMPING} AS score "
            f"FROM edges e JOIN {name}_{i} s ON s.host = e.{src} UNION ALL SELECT host, score FROM {name}_0) GROUP BY host)"
        )
    return ", ".join(steps)


ORACLE = f"""WITH split AS (SELECT page_id, html, {_sql_host("coalesce(url, '')")} AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
parsed AS (SELECT *, {_sql_rules(0)} AS rule, {_sql_rules(1)} AS ruled FROM split),
links AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{LINK.replace("'", "''")}', 1)) AS link FROM parsed),
targets AS (SELECT src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM links
  WHERE regexp_matches(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//')),
pairs AS (SELECT src, {_sql_host("link")} AS dst FROM targets),
counted AS (SELECT src, dst, count(*) AS n FROM pairs WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
edges AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY src) AS src_all, sum(n) OVER (PARTITION BY dst) AS dst_all FROM counted),
hosts AS MATERIALIZED (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS trusted,
  avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM parsed WHERE host <> '' GROUP BY host),
{_sql_spread("trust", "trusted", "src", "dst")}, {_sql_spread("distrust", "blocked", "dst", "src")}
SELECT page_id, parsed.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.score, 0) >= {BLOCK_AT}
  AND coalesce(d.score, 0) > coalesce(t.score, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN trust_{ROUNDS} t ON t.host = parsed.host LEFT JOIN distrust_{ROUNDS} d ON d.host = parsed.host"""

QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {"op4_url_filter": ORACLE}
