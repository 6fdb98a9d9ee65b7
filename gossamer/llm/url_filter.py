"""URL filters by link-graph propagation.

Where no rule names a page's address, its host decides: trust spreads from trusted seed hosts along links (personalised
PageRank), distrust from blocked seed hosts against them (who links to bad hosts is suspect), and a host whose distrust
passes a threshold that its own links set, and its trust, is blocked.
"""

from __future__ import annotations

from collections.abc import Iterable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.checkpoints import checkpoint
from gossamer.llm.common import table

#: (verdict, host, path): a rule fits its host and all subdomains where the path begins so; the longest wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
#: Share of what a host's links could bring it, were all its targets blocked seeds, from which it is blocked.
THRESHOLD = 0.5
#: Scores move by less than DAMPING ** n after n rounds, so the tolerance is met long before the last one.
ROUNDS, TOLERANCE = 200, 1e-6

_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Addresses with a host: in attributes that name another document, in a refresh, and in srcset's list.
_LINK = r"(?i)(?:\b(?:href|src|action|formaction|cite|data|poster|longdesc|background)\s*=\s*[\"']?\s*|\burl\s*=\s*[\"']?\s*|\bsrcset\s*=\s*[\"']?\s*|\bcontent\s*=\s*[\"']?\s*)(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>,]+)"


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; empty if there is none."""
    return F.coalesce(_lower(F.regexp_extract(url, _ADDRESS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null. For rule lists short enough to be an expression."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1:])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + begin).alias("rule"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst), the distinct pairs of different hosts with a link from one to the other; relative links stay on their host."""
    target = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), _lower)))
    return pages.select(F.col("host").alias("src"), target.alias("dst")).where("src <> '' and src <> dst").distinct()


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of every host that a score reaches.

    ``seeds`` has (host, kind, weight), kind 0 for trust and 1 for distrust. Trust flows along links, shared among a host's
    targets; distrust flows back, shared among a host's sources. Both go round in one aggregation, which combines before
    its shuffle; each round is checkpointed and ends the loop once no score moves by more than the tolerance. If that is not so after
    ``rounds`` of them, RuntimeError is raised.
    """
    arcs = links.select(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to")).union(
        links.select(F.lit(1), F.col("dst"), F.col("src"))
    )
    degree = arcs.groupBy("kind", "host").agg(F.count("*").alias("degree"))
    arcs = checkpoint(arcs.join(degree, ["kind", "host"]).select("kind", "host", "to", (damping / F.col("degree")).alias("share")))
    start = checkpoint(seeds.groupBy("kind", "host").agg((F.sum("weight") * (1 - damping)).alias("score")))
    now = start
    for _ in range(rounds):
        moved = now.join(arcs, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share")).alias("score"))
        after = checkpoint(start.union(moved).groupBy("kind", "host").agg(F.sum("score").alias("score")))
        change = now.select("kind", "host", (-F.col("score")).alias("score")).union(after).groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("d"))
        largest = change.agg(F.max("d")).first()[0]
        now = after
        if largest is None or largest <= tolerance:
            break
    else:
        raise RuntimeError(f"scores still moved by {largest} after {rounds} rounds")
    return now.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("score"))), F.lit(0.0)).alias("distrust"),
    )


def filter_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, blocked_hosts: DataFrame | None = None, trusted_hosts: DataFrame | None = None,
    threshold: float = THRESHOLD, id_col: str = "page_id",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, decided_by, trust, distrust) for every row of pages (url, html).

    The longest rule that fits decides. Where none does, the host decides: hosts in the table ``blocked_hosts`` (host) are blocked. Any
    other one is blocked where the distrust that its links bring it is ``threshold`` or more of what they could bring were all its targets
    blocked seeds, and a larger share than the trust is of what the links to it could bring, were they all from trusted seeds. Blocked seeds
    are ``blocked_hosts``, and each host by the share of its pages that a rule blocks; trusted ones are ``trusted_hosts`` and each host by
    the share of its pages that a rule allows. A seed's own weight does not count against it: rules name paths, and not the host's other
    pages. A null or addressless url has empty host and path and is allowed; a null html has no links; repeated rows get
    equal results and count each; further columns are not looked at; an empty table gives no rows.
    """
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), html.alias("html"))
    ruled = plain.withColumn("by", rule_for(F.col("host"), F.col("path"), rules))
    links = checkpoint(host_links(plain))
    share = lambda verdict: F.avg(F.coalesce(F.col("by.verdict") == verdict, F.lit(False)).cast("double"))
    own = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("bad"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trusted").alias("weight")), F.struct(F.lit(1).alias("kind"), F.col("bad").alias("weight"))))
    given = own.select("host", kinds.alias("k")).select("host", "k.*")
    for kind, table_ in ((0, trusted_hosts), (1, blocked_hosts)):
        if table_ is not None:
            given = given.union(table_.select(F.lower("host").alias("host")).distinct().select("host", F.lit(kind), F.lit(1.0)))
    seeds = checkpoint(given.groupBy("host", "kind").agg(F.max("weight").alias("weight")).where("weight > 0"))
    scores = propagate(links, seeds)
    # what comes by links, and what would come were all of a host's neighbours seeds of full weight
    start = seeds.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("weight") * (1 - DAMPING))), F.lit(0.0)).alias(n) for k, n in ((0, "trust_own"), (1, "distrust_own"))])
    most = DAMPING * (1 - DAMPING)
    targets, sources = links.groupBy("src").agg(F.count("*").alias("n")), links.groupBy("dst").agg(F.count("*").alias("n"))
    could_distrust = links.join(sources, "dst").groupBy(F.col("src").alias("host")).agg(F.sum(most / F.col("n")).alias("could_distrust"))
    could_trust = links.join(targets, "src").groupBy(F.col("dst").alias("host")).agg(F.sum(most / F.col("n")).alias("could_trust"))
    by_host = scores.join(start, "host", "left").join(could_distrust, "host", "left").join(could_trust, "host", "left")
    came = lambda n: F.coalesce(F.greatest(F.col(n) - F.coalesce(f"{n}_own", F.lit(0.0)), F.lit(0.0)) / F.col(f"could_{n}"), F.lit(0.0))
    by_host = by_host.select("host", "trust", "distrust", ((came("distrust") >= threshold) & (came("distrust") > came("trust"))).alias("bad"))
    if blocked_hosts is not None:
        listed = blocked_hosts.select(F.lower("host").alias("host")).distinct().withColumn("listed", F.lit(True))
        by_host = by_host.join(listed, "host", "left").withColumn("bad", F.col("bad") | F.coalesce("listed", F.lit(False))).drop("listed")
    # Checkpointed, so that the join deals both sides anew and a host with very many pages can be split.
    out = ruled.select("page_id", "host", "path", "by").join(checkpoint(by_host), "host", "left")
    return out.select(
        "page_id", "host", "path", F.col("by.rule").alias("rule"),
        F.coalesce("by.verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("by").isNotNull(), "rule").otherwise("graph").alias("decided_by"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url; the seeds are the rules' own. Edge cases as in ``filter_urls``."""
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
