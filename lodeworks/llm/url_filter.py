"""URL verdicts: host and path rules, then templates of a per-host path tree. Native: DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the end of a path among the segments; no path has it, as a path is cut at ?.
END = "?"
#: The rules of the contract: verdict, rule (host, then the start of the path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@dataclass(frozen=True)
class Tree:
    """From how many distinct values, and from which share of a node's URLs, a segment is a variable; difference in standard errors
    from which a branch differs from its siblings; weight of a parent's purity; purity that blocks."""

    values: int = 8
    share: float = 0.2
    differ: float = 1.96
    prior: float = 4.0
    block: float = 0.8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def differs(judged: str, blocked: str, all_judged: str, all_blocked: str, errors: float) -> Column:
    """Whether a branch's share of blocked URLs differs from that of its siblings together: a test of two proportions with
    continuity correction. A branch without labels, or whose siblings have none, differs from nothing."""
    j, b, rest, other = F.col(judged), F.col(blocked), F.col(all_judged) - F.col(judged), F.col(all_blocked) - F.col(blocked)
    pooled = F.col(all_blocked) / F.col(all_judged)
    noise = 1 / j + 1 / rest
    gap = F.abs(b / j - other / rest) - noise / 2
    return F.when((j > 0) & (rest > 0), (gap > 0) & (gap >= F.lit(errors) * F.sqrt(pooled * (1 - pooled) * noise))).otherwise(F.lit(False))


def grow(live: DataFrame, tree: Tree) -> DataFrame:
    """One level of the tree: of URLs (host, path, parts, depth, t, p, ...) at node t those that go on, at their child, with its purity.

    Branches that don't differ from their siblings are one wildcard, if their node has labels or its segment is a variable; those that do
    differ are one wildcard a direction where they agree with each other, else they keep their segment."""
    live = live.withColumn("s", F.coalesce(F.get("parts", F.col("depth")), F.lit(END)))
    branch = written(live.groupBy("host", "t", "p", "s").agg(F.sum("n").alias("n"), F.sum("judged").alias("judged"), F.sum("blocked").alias("blocked")))
    sums = [F.sum("judged").alias("j1"), F.sum("blocked").alias("b1")]
    # what is joined is written first: only then is a join on a hot host's key split at run time
    family = written(branch.groupBy("host", "t").agg(F.count("*").alias("values"), F.sum("n").alias("rows"), *sums))
    b = branch.join(family, ["host", "t"]).withColumn("far", differs("judged", "blocked", "j1", "b1", tree.differ))
    above = F.col("blocked") * F.col("j1") > F.col("b1") * F.col("judged")
    b = written(b.withColumn("way", F.when(F.col("far"), F.when(above, F.lit("*+")).otherwise(F.lit("*-")))))
    alike = written(b.where("way is not null").groupBy("host", "t", "way").agg(F.count("*").alias("ways"), F.sum("judged").alias("j2"), F.sum("blocked").alias("b2")))
    b = b.join(alike, ["host", "t", "way"], "left")
    variable = (F.col("values") >= tree.values) & (F.col("values") >= tree.share * F.col("rows"))
    own = F.when(F.col("s").isin("*", "*+", "*-"), F.concat(F.lit("\\"), "s")).otherwise(F.col("s"))
    name = F.when(F.col("s") == END, F.lit("")).when((F.col("ways") > 1) & ~differs("judged", "blocked", "j2", "b2", tree.differ), F.col("way"))
    name = name.when(F.col("way").isNotNull(), own).when(((F.col("j1") > 0) & (F.col("values") > 1)) | variable, F.lit("*")).otherwise(own)
    b = b.select("host", "t", "p", "s", F.concat("t", F.lit("/"), name).alias("child"), "judged", "blocked")
    purity = (F.sum("blocked") + F.lit(tree.prior) * F.col("p")) / (F.sum("judged") + F.lit(tree.prior))
    b = written(b)
    node = written(b.groupBy("host", "t", "p", "child").agg(purity.alias("q")).select("host", "child", "q"))
    place = written(b.select("host", "t", "s", "child").join(node, ["host", "child"]))
    went = live.join(place, ["host", "t", "s"])
    return went.select("host", "path", "parts", "n", "judged", "blocked", (F.col("depth") + 1).alias("depth"), F.col("child").alias("t"), F.col("q").alias("p"))


def judge(pages: DataFrame, rules=RULES, tree: Tree = Tree()) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, and its purity.

    URLs that a rule judges are the labelled ones. Per host a tree of path segments is grown level by level (see grow) until
    each URL ends or is the only one at its node, however deep. A node's purity is its share of blocked URLs, smoothed towards
    its parent's, the host's and the whole table's in turn; a URL without a rule is blocked where that of its last node reaches
    tree.block. Null urls and urls without :// have an empty host and path and are judged like any other host; rows that
    repeat a url count as often; no rows give no rows. Other columns don't matter.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    blocked = F.sum((F.coalesce(F.col("ruled"), F.lit("")) == "block").cast("long")).alias("blocked")
    urls = written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("ruled").alias("judged"), blocked))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    every = urls.agg(((total("blocked") + 1) / (total("judged") + 2)).alias("every"))
    root = urls.groupBy("host").agg(F.sum("judged").alias("j"), F.sum("blocked").alias("b")).crossJoin(F.broadcast(every))  # one row
    root = written(root.select("host", ((F.col("b") + F.lit(tree.prior) * F.col("every")) / (F.col("j") + F.lit(tree.prior))).alias("p")))
    parts = F.split(F.regexp_replace("path", r"^/", ""), "/")
    live = written(urls.join(root, "host").select("host", "path", parts.alias("parts"), "n", "judged", "blocked", F.lit(0).alias("depth"), F.lit("").alias("t"), "p"))
    done = []
    while not live.isEmpty():
        live = written(grow(live, tree))
        many = written(live.groupBy("host", "t").agg((F.count("*") > 1).alias("many")))
        live = written(live.join(many, ["host", "t"]))
        on = F.col("many") & (F.col("depth") <= F.size("parts"))
        done.append(live.where(~on).select("host", "path", "t", "p"))
        live = live.where(on).drop("many")
    found = reduce(DataFrame.union, done) if done else live.select("host", "path", "t", "p")
    out = rows.join(written(found), ["host", "path"])
    method = F.when(F.col("p") >= tree.block, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.col("t").alias("template"), F.col("p").alias("purity"))
