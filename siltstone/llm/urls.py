"""URL filters: host and path rules, and trust and distrust spread over the links between hosts."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or without ://: empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct<name, verdict> of the longest rule that fits, else null."""

    def fits(r: Rule) -> Column:
        return ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)

    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    found = reduce(lambda c, r: c.when(fits(r), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))), ordered, F.when(F.lit(False), F.lit(None)))
    return found if ordered else F.lit(None).cast("struct<name:string,verdict:string>")


def host_edges(pages: DataFrame, *, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, n): absolute links between different hosts, summed for each pair before and after the shuffle."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return links.select("src", host_of(full).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, cut_every: int = 8, least_change: float = 1e-7) -> DataFrame:
    """(host, trust, distrust): personalised PageRank of trust along links, and of distrust against them.

    edges (src, dst, n); seeds (host, trust, distrust), one row for each host, weights 0 to 1. A host hands on its
    trust in the shares of its links, and its distrust to those that link to it in the shares of their links. Edges are
    summed by pair of hosts, and both walks share one join and one sum a round. Ends when cut_every rounds change no host by
    more than least_change. Each round passes on at most damping of what changed, so that comes after a known number of rounds; more is an error.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    forth = edges.join(out, "src").select(F.lit(True).alias("good"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("all")).alias("p"))
    back = edges.join(into, "dst").select(F.lit(False).alias("good"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("all")).alias("p"))
    steps = cut(forth.union(back))
    kinds = F.explode(F.array(F.struct(F.lit(True).alias("good"), F.col("trust").alias("seed")), F.struct(F.lit(False).alias("good"), F.col("distrust").alias("seed")))).alias("k")
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    nodes = seeds.select("host", "trust", "distrust").union(linked).select("host", kinds).groupBy("host", "k.good").agg(F.max("k.seed").alias("seed"))
    state = cut(nodes.withColumn("x", (1 - damping) * F.col("seed")))
    mass = state.agg(F.sum("seed")).first()[0] or 0.0
    most = 1 + cut_every + math.ceil(math.log(max(mass, least_change) / least_change) / -math.log(damping))
    for done in range(0, most + cut_every, cut_every):
        if done >= most:
            raise RuntimeError("the walk does not come to rest: shares of links must not sum to over 1")
        began, now = state, state
        for _ in range(cut_every):
            s = now.select(F.col("good").alias("g"), "host", "x")
            got = s.join(steps, (F.col("g") == F.col("good")) & (F.col("host") == F.col("a"))).groupBy("good", "b").agg(F.sum(F.col("x") * F.col("p")).alias("got"))
            got = got.select(F.col("good").alias("g2"), "b", "got")
            now = began.join(got, (F.col("good") == F.col("g2")) & (F.col("host") == F.col("b")), "left").select(
                "host", "good", "seed", ((1 - damping) * F.col("seed") + damping * F.coalesce("got", F.lit(0.0))).alias("x")
            )
        state = cut(now.join(began.select("host", "good", F.col("x").alias("was")), ["host", "good"]))
        change = state.agg(F.max(F.abs(F.col("x") - F.col("was")))).first()[0]
        state = state.drop("was")
        if not change or change < least_change:
            break
    one = lambda good: F.round(F.sum(F.when(F.col("good") == good, F.col("x"))), 12)
    return state.groupBy("host").agg(one(True).alias("trust"), one(False).alias("distrust"))


def judge(pages: DataFrame, *, rules: tuple[Rule, ...] = RULES, damping: float = 0.85, least: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust): one row for each row of pages.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins and its verdict
    stands. Other pages get their host's: block if distrust is more than trust and at least a share least of what a
    host all of whose pages are blocked has by itself, else allow. Seeds are the shares of a host's pages that rules
    allow and block. Null urls, and urls without ://, have empty host and path and are allowed. Null html has no
    links. Repeated rows each get a row and count as pages. An empty table gives no row.
    """
    own = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda v: (F.count_if(F.col("r.verdict") == v) / F.count("*"))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    edges = cut(host_edges(pages, url_col=url_col, html_col=html_col))
    scores = propagate(edges, seeds, damping=damping)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least * (1 - damping))
    other = F.when(bad, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("r.name").alias("rule"), F.coalesce("r.verdict", other).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
