"""URL filter: allow and block rules, and for urls without a rule, trust and distrust spread over the host graph.

Hosts with allowed urls are seeds of trust, hosts with blocked urls seeds of distrust, each by the share of the
host's urls that the rules judge. Trust flows along links (personalised PageRank); distrust flows against them, from a
blocked host to the hosts that link to it (the same walk on the reversed graph). That walk splits a host's distrust over all
that link to it, so a verdict goes by *blame*: a host's own distrust and the mean blame of what its links lead to, whatever
else leads there. A host is blocked when its blame outweighs its trust and a set part of a seed's. Only DataFrame functions;
the edge table is aggregated to one row per pair of hosts before the first iteration, and an iteration is one join and
one aggregation with map-side combine. Iterations end when no score changes by more than a tolerance.

The SQL iterates so often that scores cannot change any more by the tolerance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, PRECISION = 0.85, 9
#: Largest change of a score in five iterations that counts as none.
TOLERANCE = 1e-7
#: Part of a wholly blocked seed's own distrust that a host needs to be blocked.
THRESHOLD = 0.5
LINK = "(?i)(?:href|src)\\s*=\\s*[\"']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\\s<>]+)"
_PARTS = "://([^/?#]*)([^?#]*)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """Null, or a url without ``://``, has the empty host."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule whose host is the host or a parent of it and whose path begins the path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): absolute links in ``href`` and ``src`` attributes between different hosts, counted."""
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1))).alias("dst"))
    return found.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _settled(new: DataFrame, old: DataFrame, tolerance: float) -> bool:
    """Scores only grow from the restart shares, so five iterations change a score at least as much as the last."""
    change = F.col("score") - F.coalesce("was", F.lit(0.0))
    return new.join(old.withColumnRenamed("score", "was"), ["kind", "host"], "left").where(change > tolerance).isEmpty()


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, iterations: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust, blame) of every host that is a seed or in a link.

    ``seeds``: (host, trust, distrust), ``links``: (src, dst, n), already written. A host passes on trust and distrust in
    proportion to n; blame comes to it in proportion to the n of its own links. Without ``iterations`` the scores
    are iterated until they settle. Without links the seeds keep their restart share.
    """
    kinds = (("trust", "trust"), ("distrust", "distrust"), ("blame", "distrust"))
    start = seeds.select("host", F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(of).alias("score")) for kind, of in kinds])))
    start = start.where("score > 0").select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    out = start
    if not links.isEmpty():
        out = start = written(start, "start")
        outward, inward = links.groupBy("src").agg(F.sum("n").alias("outward")), links.groupBy("dst").agg(F.sum("n").alias("inward"))
        way = lambda kind, host, to, total: F.struct(F.lit(kind).alias("kind"), F.col(host).alias("host"), F.col(to).alias("to"), (F.lit(damping) * F.col("n") / F.col(total)).alias("part"))
        each = F.array(way("trust", "src", "dst", "outward"), way("distrust", "dst", "src", "inward"), way("blame", "dst", "src", "outward"))
        ways = written(links.join(outward, "src").join(inward, "dst").select(F.inline(each)), "ways")
        done, i, old = iterations == 0, 0, start
        while not done:
            moved = ways.join(out, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("part")).alias("score"))
            out = moved.union(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            i += 1
            if i % 5 == 0:
                out = written(out, "scores")
                done = iterations is None and _settled(out, old, tolerance)
                old = out
            done = done or i == iterations
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return out.groupBy("host").agg(*[pick(kind) for kind, _ in kinds])


def judge_urls(
    pages: DataFrame,
    rules=RULES,
    damping: float = DAMPING,
    iterations: int | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per page, repeated rows included.

    Null html has no links; a url without host has no scores and is allowed; hosts on a tie are allowed. Other columns
    are ignored. An empty table gives an empty one.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("own.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    links = written(host_links(pages, url_col, html_col), "links")
    scores = written(spread(seeds, links, damping, iterations), "scores")
    score = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), PRECISION)
    bad = (score("blame") > score("trust")) & (score("blame") >= round(threshold * (1 - damping), PRECISION))
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        score("trust").alias("trust"), score("distrust").alias("distrust"),
    )


def judge_urls_sql(rules=RULES, damping: float = DAMPING, iterations: int | None = None, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL, over ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    After n turns a score lacks at most damping to the power of n + 1; by default that is less than the tolerance.
    """
    iterations = iterations or math.ceil(math.log(TOLERANCE / 10) / math.log(damping))
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick: " ".join(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{pick((v, h, p))}'" for v, h, p in ordered)
    link = LINK.replace("'", "''")
    score = lambda kind: f"round(coalesce(sum(score) filter (kind = '{kind}'), 0), {PRECISION}) as {kind}"
    return f"""
with recursive judged as (
  select *, case {case(lambda r: r[1] + r[2])} end as rule, case {case(lambda r: r[0])} end as own from (
    select page_id, html, translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{_UPPER}', '{_LOWER}') as host,
           regexp_extract(coalesce(url, ''), '{_PARTS}', 2) as path from pages)),
seeds as (select host, avg(case when own = 'allow' then 1.0 else 0.0 end) trust, avg(case when own = 'block' then 1.0 else 0.0 end) distrust
  from judged where host <> '' group by 1),
links as (select src, dst, count(*) n from (select host as src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') as dst from judged)
  where src <> '' and dst <> '' and src <> dst group by 1, 2),
shares as (select *, {damping} * n / sum(n) over (partition by src) as outward, {damping} * n / sum(n) over (partition by dst) as inward from links),
ways as (select 'trust' kind, src host, dst "to", outward part from shares union all select 'distrust', dst, src, inward from shares union all select 'blame', dst, src, outward from shares),
s0 as (select kind, host, score * {1 - damping} score from (select 'trust' kind, host, trust score from seeds union all select 'distrust', host, distrust from seeds union all select 'blame', host, distrust from seeds) where score > 0),
s as (select 0 as i, kind, host, score from s0 union all
  select i, kind, host, sum(score) from (select s.i + 1 as i, w.kind, w."to" as host, s.score * w.part as score from s join ways w on w.kind = s.kind and w.host = s.host where s.i < {iterations}
    union all select t.i + 1, s0.kind, s0.host, s0.score from s0 join (select distinct i from s where i < {iterations}) t on true) group by i, kind, host),
scores as (select host, {score("trust")}, {score("distrust")}, {score("blame")} from s where i = {iterations} group by 1)
select page_id, j.host as host, path, rule, coalesce(own, case when coalesce(blame, 0) > coalesce(trust, 0)
  and coalesce(blame, 0) >= {round(threshold * (1 - damping), PRECISION)} then 'block' else 'allow' end) as verdict,
  coalesce(trust, 0.0) as trust, coalesce(distrust, 0.0) as distrust
from judged j left join scores s on j.host = s.host"""
