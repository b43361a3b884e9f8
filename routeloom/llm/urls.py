"""URL filters: longest matching rule first, then trust and distrust propagated over the host link graph.

Hosts of allowed pages are trusted seeds and hosts of blocked pages distrusted ones, weighed by their pages. Trust is
the personalised PageRank over links from host to host, distrust that over the links reversed, as a page that links to
bad hosts is suspect. A host is blocked if its distrust exceeds `ratio` times its trust. All of it is DataFrame work.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import bounded_batches, checkpointed, saved, table

#: Fixed values, those of the query's contract: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^(?:.*?)://([^/?#]*)([^?#]*)"
HREF = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does. Rules are few: each is one condition."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): absolute links between different hosts, counted. Relative links stay on their host."""
    p = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF), F.lit(1))).alias("href"))
    dst = host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), F.col("href"))).otherwise(F.col("href")))
    links = p.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(kind, host, rank) for seeds (kind, host, mass) over links (kind, src, dst, weight), each kind on its own.

    rank = (1 - damping) * seed + damping * (what arrives by links + the seed's part of what hosts without links hold).
    Masses are scaled to 1 for each kind. Ends once ranks move by less than the tolerance in all, or after `rounds` if
    given. Every round shrinks the movement by the damping at least, so the tolerance holds after some 90 rounds.
    Without links the ranks are the seeds, as all mass returns to them.
    """
    total = seeds.groupBy("kind").agg(F.sum("mass").alias("total"))
    seed = checkpointed(seeds.join(total, "kind").where("total > 0").select("kind", "host", (F.col("mass") / F.col("total")).alias("seed")))
    out = links.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    share = checkpointed(links.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("out")).alias("share")))
    rank = seed.select("kind", "host", F.col("seed").alias("rank"))
    if share.limit(1).count() == 0:
        return rank
    for _ in count() if rounds is None else range(rounds):
        sent = rank.join(share, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        kept = sent.groupBy("kind").agg(F.sum("got").alias("moved"))
        back = seed.join(kept, "kind", "left").select("kind", "host", (F.col("seed") * (1 - damping * F.coalesce("moved", F.lit(0.0)))).alias("base"))
        new = back.join(sent, ["kind", "host"], "full").select("kind", "host", (F.coalesce("base", F.lit(0.0)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new = checkpointed(new)
        moved = new.alias("n").join(rank.alias("r"), ["kind", "host"], "full").agg(F.sum(F.abs(F.coalesce("n.rank", F.lit(0.0)) - F.coalesce("r.rank", F.lit(0.0))))).first()[0]
        rank = new
        if (moved or 0.0) < tolerance:
            break
    return rank


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, ratio: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of pages.

    The longest fitting rule decides; without one the host's ranks do. Hosts that neither rank reaches are allowed, and
    so are urls that are null or have no "://" (host and path empty). Repeated rows are judged alike.
    """
    bounded_batches(pages.sparkSession)
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    p = saved(p.withColumn("m", match_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "m.rule", F.col("m.verdict").alias("ruled")), "urls")
    kind = F.when(F.col("ruled") == "allow", F.lit("trust")).otherwise(F.lit("distrust"))
    seeds = p.where("ruled is not null and host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count(F.lit(1)).cast("double").alias("mass"))
    links = checkpointed(host_links(pages, url_col, html_col))
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("weight")))
    rank = propagate(seeds, both)
    ranks = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))
    zero = F.lit(0.0)
    j = p.join(ranks, "host", "left").select("page_id", "host", "path", "rule", "ruled", F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
    own = F.when(F.col("distrust") > ratio * F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    return j.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
