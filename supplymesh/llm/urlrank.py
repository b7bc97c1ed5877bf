"""URL filters: rules by host and path, and trust and distrust propagated over links between hosts.

Rules judge the urls they fit. Hosts whose urls are allowed by rules are seeds of trust, hosts whose urls
are blocked are seeds of distrust, each as strong as its part of all such urls. Trust follows links
(personalised PageRank); distrust follows them backwards, to those who link to distrusted hosts.
A host is blocked if distrust has more than the given share of what it got of both.

Everything here is DataFrame expressions; no Python runs on the executors. Hosts and hubs that hold
over a thousandth of the rows, of which there can't be more than a thousand, are broadcast or
salted, the others joined by shuffles, so that no host makes a task larger than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymesh.llm.common import checkpointed

#: (verdict, host and path) of the production rules.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DAMPING, ROUNDS, CHANGE, SHARE = 0.85, 1000, 1e-6, 0.5
#: A host is hot with more than this part of all rows; salts of a hub's edges.
HOT, SALTS = 1000, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links to another host, with or without a scheme; the group is the host.
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(length, rule, verdict); null if none does. A rule fits its host and that host's
    subdomains, if the path starts with the rule's. Of rules given twice, the last verdict counts."""
    by_host: dict[str, dict[str, str]] = {}
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a verdict is allow or block, not {verdict}")
        by_host.setdefault(rule.partition("/")[0], {})[rule] = verdict
    if not by_host:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")

    def known(rule: str, verdict: str) -> Column:
        begins = rule[len(rule.partition("/")[0]) :]
        return F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(begins).alias("begins"))

    table = F.create_map(*(x for h, own in by_host.items() for x in (F.lit(h), F.array(*(known(r, v) for r, v in own.items())))))
    labels = F.split(host_, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    candidates = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(candidates, lambda x: path_.startswith(x["begins"])))
    return F.when(best.isNotNull(), F.struct(best["length"].alias("length"), best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (source, target) host pairs of links in pages (host, html), without those within a host or of pages without one."""
    linked = pages.filter((F.col("host") != "") & F.col("html").contains("//")).select(F.col("host").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("t"))
    return linked.select("source", F.translate("t", _UPPER, _LOWER).alias("target")).filter("source != target and target != ''").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, change: float = CHANGE) -> DataFrame:
    """Trust and distrust of hosts, from seeds (host, trust, distrust) and edges (source, target): host, trust, distrust.

    Each round adds what hosts hand on along their edges, trust to those they link to and distrust to those that link to
    them, in equal parts. Trust and distrust each add up to one, as of the seeds and so of all hosts: what a host without edges holds of
    one kind goes back to that kind's seeds. That is the same as leaving it out and scaling the kind to one in the end, since
    both give multiples of the same sum over walks from the seeds. Ends when a round changes less than ``change``, which damping
    brings about; it is an error if ``rounds`` don't do.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit("t").alias("kind")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), F.lit("d").alias("kind")))
    both = checkpointed(both)
    total = both.count()
    held = checkpointed(seeds.select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("trust").cast("double").alias("own")), F.struct(F.lit("d").alias("kind"), F.col("distrust").cast("double").alias("own")))).alias("x")).select("host", "x.*").filter("own > 0"))
    sums = {r.kind: r.s for r in held.groupBy("kind").agg(F.sum("own").alias("s")).collect()}
    held = held.withColumn("own", F.col("own") / F.when(F.col("kind") == "t", sums.get("t", 1.0)).otherwise(sums.get("d", 1.0)))
    state = held.select("host", "kind", F.col("own").alias("score"))
    if total:
        degree = both.groupBy("a", "kind").agg(F.count("*").alias("degree"))
        hubs = checkpointed(degree.filter(F.col("degree") > total / HOT).select("a", "kind", F.lit(SALTS).alias("salts")))  # at most HOT rows
        salted = checkpointed(both.join(F.broadcast(hubs), ["a", "kind"], "left").select("a", "b", "kind", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")))
        degree = checkpointed(degree.join(F.broadcast(hubs), ["a", "kind"], "left").select("a", "kind", "degree", F.coalesce("salts", F.lit(1)).alias("salts")))
        for _ in range(rounds):
            gives = state.join(degree.withColumnRenamed("a", "host"), ["host", "kind"]).select(F.col("host").alias("a"), "kind", (F.col("score") * damping / F.col("degree")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
            moved = salted.join(gives, ["a", "kind", "salt"]).select(F.col("b").alias("host"), "kind", F.col("part").alias("score"), F.lit(0.0).alias("was"))
            parts = moved.unionByName(held.select("host", "kind", F.col("own").alias("score"), F.lit(0.0).alias("was"))).unionByName(state.select("host", "kind", F.lit(0.0).alias("score"), F.col("score").alias("was")))
            state = checkpointed(parts.groupBy("host", "kind").agg(F.sum("score").alias("score"), F.sum("was").alias("was")))
            moved_by = state.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0
            state = state.drop("was")
            if moved_by <= change:
                break
        else:
            raise RuntimeError("trust and distrust haven't settled")
    reached = {r.kind: r.s for r in state.groupBy("kind").agg(F.sum("score").alias("s")).collect()}
    amount = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score") / reached.get(kind, 1.0)).otherwise(0.0))
    return state.groupBy("host").agg(amount("t").alias("trust"), amount("d").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, share: float = SHARE, url: str = "url", html: str = "html") -> DataFrame:
    """pages' page_id with host, path, rule, verdict, and by_rule: whether the verdict is a rule's.

    A url that no rule fits has its host's verdict: block if distrust is over ``share`` of the host's trust and distrust
    together, else allow. Hosts that neither reaches are allowed, and so are urls without a host. Every row gives one row, also
    repeated ones; null html has no links; other columns aren't used.
    """
    u = F.col(f"`{url}`").cast("string")
    base = pages.select("page_id", host(u).alias("host"), path(u).alias("path"), F.col(f"`{html}`").cast("string").alias("html"))
    ruled = base.select("page_id", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("r")).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    hosts = checkpointed(ruled.groupBy("host").agg(F.count("*").alias("rows"), F.count_if(F.col("verdict") == "allow").alias("trust"), F.count_if(F.col("verdict") == "block").alias("distrust")))
    seeds = hosts.filter("host != '' and trust + distrust > 0").select("host", "trust", "distrust")
    reached = propagate(seeds, host_edges(base.select("host", "html")))
    of_host = F.when(F.col("distrust") > share * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    judged = checkpointed(hosts.select("host", "rows").join(reached, "host", "left").select("host", "rows", F.coalesce(of_host, F.lit("allow")).alias("of_host")))
    total = judged.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(judged.filter(F.col("rows") > total / HOT).select("host", "of_host"))  # at most HOT rows
    cold = judged.filter(F.col("rows") <= total / HOT).select("host", "of_host")
    by_rule = ruled.filter("rule is not null").select("*", F.lit(True).alias("by_rule"))
    free = ruled.filter("rule is null").select("page_id", "host", "path", "rule")
    end = ["page_id", "host", "path", "rule", F.col("of_host").alias("verdict"), F.lit(False).alias("by_rule")]
    by_hot = free.join(hot, "host").select(*end)
    by_cold = free.join(hot, "host", "left_anti").join(cold, "host").select(*end)
    return by_rule.unionByName(by_hot).unionByName(by_cold)
