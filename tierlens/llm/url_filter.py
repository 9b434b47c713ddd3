"""URL filters: rules, and a tree of path templates per host for urls that no rule fits.

Paths are cut into segments. Runs of digits become wildcards; where a node of the tree still has many
different children that hardly repeat, the whole segment does. Urls that a rule fits are the labelled ones.
Branches whose share of blocked urls does not differ from that of their siblings are merged with them. A
template is rejected if its smoothed share of blocked urls is over one half; a host with few labels leans on
the same template of all hosts, and that on all labelled urls.

Rows are counted by host and path first, so the tree is built over different urls. Where a `depth` is given, a
deeper path ends in one wildcard for its rest; with None the tree follows every path to its end.

Defined results: a null url, or one without `://`, has an empty host and path. Repeated urls weigh as often as
they occur and share a verdict. Without labelled urls everything is allowed. Other columns pass through;
those named like the results are replaced.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import kept

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path)
RULES = (
    (ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"://([^/?#]*)([^?#]*)"
#: So many parts of the result are written as one.
MERGE = 16
#: A node is variable if it has over MANY children that occur fewer than FEW times on average.
MANY, FEW = 20, 5
#: Pseudo-counts of the smoothing, and how many standard errors make a branch differ from its siblings.
WEIGHT, DIFFERENT = 2.0, 1.96


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest]
    none = F.lit(None).cast("string")
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, longest)], none)
    return rule, F.coalesce(*[F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, longest)], none)


def templates(urls: DataFrame, depth: int | None = None) -> DataFrame:
    """`urls` (`host`, `path`, `n` and more) with `parent` and `template` of each path."""
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    )
    if depth is not None:
        first = F.concat(F.slice(segments, 1, depth), F.array(F.lit("**")))
        segments = F.when(F.size(segments) > depth, first).otherwise(segments)
    shapes = F.transform(segments, lambda x: F.regexp_replace(x, "[0-9]+", "*"))
    rows = urls.withColumn("shapes", shapes).withColumn("parent", F.lit("")).withColumn("template", F.lit(""))
    rows = kept(rows.withColumn("more", F.size("shapes") > 0), "urls")
    names, done, level = [*urls.columns, "parent", "template"], [], 0
    while True:
        done.append(rows.where("not more").select(names))
        if len(done) == MERGE:
            done = [kept(reduce(DataFrame.unionByName, done), "done")]
        rows = rows.where("more")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)
        shape = F.get("shapes", F.lit(level))
        count = (F.sum("n").alias("n"), F.count("*").alias("urls"))
        children = rows.withColumn("shape", shape).groupBy("host", "template", "shape").agg(*count)
        nodes = children.groupBy("host", "template").agg(
            F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("urls").alias("urls")
        )
        # Without MANY urls no node from here on is variable: only the others are followed segment by segment.
        variable = ((F.col("k") > MANY) & (F.col("n") < FEW * F.col("k"))).alias("variable")
        followed = kept(nodes.where(F.col("urls") > MANY).select("host", "template", variable), "nodes")
        rows = rows.join(followed, ["host", "template"], "left")
        alone, left = F.col("variable").isNull(), F.size("shapes") - level

        def rest(length):
            return F.concat("template", F.lit("/"), F.array_join(F.slice("shapes", F.lit(level + 1), length), "/"))

        step = F.concat("template", F.lit("/"), F.when(F.col("variable"), F.lit("*")).otherwise(shape))
        parent = F.when(alone & (left > 1), rest(left - 1)).otherwise(F.col("template"))
        rows = rows.select(
            *urls.columns, "shapes", parent.alias("parent"), F.when(alone, rest(left)).otherwise(step).alias("template"),
            (~alone & (left > 1)).alias("more"),
        )
        rows, level = kept(rows, "urls"), level + 1


def scores(rows: DataFrame) -> DataFrame:
    """`host`, `template`, `score`: smoothed share of blocked urls, after merging similar branches.

    `rows` has `host`, `parent`, `template`, `labelled` and `blocked` counts.
    """
    count = (F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    branches = kept(rows.groupBy("host", "parent", "template").agg(*count), "branches")
    pools = kept(branches.groupBy("host", "parent").agg(F.sum("labelled").alias("all"), F.sum("blocked").alias("bad")), "pools")
    everywhere = kept(branches.groupBy("template").agg(F.sum("labelled").alias("t_all"), F.sum("blocked").alias("t_bad")), "templates")
    total, bad = pools.agg(F.sum("all"), F.sum("bad")).first()
    prior = ((bad or 0) + 1) / ((total or 0) + 2)
    out = branches.join(pools, ["host", "parent"]).join(everywhere, "template")
    # The rest of the pool against this branch, by the normal test for two shares.
    rest, rest_bad = F.col("all") - F.col("labelled"), F.col("bad") - F.col("blocked")
    share = F.col("bad") / F.nullif(F.col("all"), F.lit(0))
    spread = F.sqrt(share * (1 - share) * (1 / F.nullif(F.col("labelled"), F.lit(0)) + 1 / F.nullif(rest, F.lit(0))))
    gap = F.abs(F.col("blocked") / F.nullif(F.col("labelled"), F.lit(0)) - rest_bad / F.nullif(rest, F.lit(0)))
    alone = F.coalesce(gap > DIFFERENT * spread, F.lit(False))
    n = F.when(alone, F.col("labelled")).otherwise(F.col("all"))
    b = F.when(alone, F.col("blocked")).otherwise(F.col("bad"))
    common = (F.col("t_bad") + WEIGHT * prior) / (F.col("t_all") + WEIGHT)
    return out.select("host", "template", ((b + WEIGHT * common) / (n + WEIGHT)).alias("score"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", depth: int | None = None) -> DataFrame:
    """`pages` with `host`, `path`, `rule`, `template`, `score` (of the template) and `verdict`."""
    own = ("host", "path", "rule", "template", "score", "verdict")
    host, path = host_path(F.col(url))
    rows = pages.drop(*own).withColumn("host", host).withColumn("path", path)
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("said", said)
    urls = urls.withColumn("labelled", F.when(F.col("said").isNotNull(), F.col("n")).otherwise(0))
    urls = urls.withColumn("blocked", F.when(F.col("said") == BLOCK, F.col("n")).otherwise(0))
    known = templates(urls, depth)
    found = scores(known)
    known = kept(known.select("host", "path", "template").join(kept(found, "scores"), ["host", "template"]), "judged")
    out = rows.join(known, ["host", "path"], "left").withColumn("rule", rule)
    method = F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW)
    return out.withColumn("verdict", F.coalesce(said, method))
