"""URL verdicts: fixed rules, then a tree of path templates per host.

Paths become sequences of segments; runs of digits are variable from the start. Going down the tree
level by level, rare children of a node with many children become a wildcard, and children whose
labelled pages are blocked at statistically the same rate as their siblings' are merged with
them. A template's purity is the share of blocked pages among its labelled ones, smoothed towards
its parent's, the first template's towards the host's, the host's towards its parent domain's, and the last
domain's towards the rate of all labelled pages. Pages that no rule decides are blocked if their
template's purity is at least ``REJECT`` and a page of the host or of a parent domain is labelled.
Labelled are the pages that a rule decides.

Levels are aggregations with partial sums and equi-joins with their results, so a host with very
many pages is split like any other large key. Segments after ``DEPTH`` share one tail node.

Defined cases: a null url or one without :// has an empty host and path and is allowed; a null
page_id stays null; repeated rows are rows; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.tables import written

# Rules as host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEPTH = 4
MANY_CHILDREN, RARE_SHARE = 20, 0.05
#: Labelled pages a branch needs to be compared, and standard errors within which rates are alike.
LEAST_LABELLED, ALIKE = 10, 1.0
SMOOTHING, REJECT = 4.0, 0.8


def parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, what: int | None = None) -> Column:
    """The longest rule that fits, as host and path; with ``what``, that field of the rule."""
    out = [
        F.when(((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1]), F.lit(r[0] + r[1] if what is None else r[what]))
        for r in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    ]
    return F.coalesce(*out)


def _smoothed(blocked: Column, labelled: Column, prior: Column) -> Column:
    return (blocked + SMOOTHING * prior) / (labelled + SMOOTHING)


def priors(pages: DataFrame) -> DataFrame:
    """Per host: _prior, the smoothed purity of its parent domains, and _known, whether they or the host have labelled pages."""
    hosts = written(pages.groupBy("host").agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("k")), "hosts")
    base = hosts.agg(F.coalesce(F.sum("k") / F.greatest(F.sum("m"), F.lit(1)), F.lit(0.0)).alias("base"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(labels, -i, i), ".").alias("domain")))
    above = hosts.select("host", "m", "k", F.inline(ends))
    domains = written(above.groupBy("domain").agg(F.sum("m").alias("m"), F.sum("k").alias("k")), "domains")
    way = above.select("host", "depth", "domain").join(domains, "domain")
    parents = F.sort_array(F.collect_list(F.when(F.col("domain") != F.col("host"), F.struct("depth", "m", "k"))))
    way = way.groupBy("host").agg(parents.alias("parents"), (F.max("m") > 0).alias("_known"))
    prior = F.aggregate("parents", F.col("base"), lambda up, x: _smoothed(x["k"], x["m"], up))
    return written(way.join(F.broadcast(base)).select("host", prior.alias("_prior"), "_known"), "priors")


def templates(pages: DataFrame) -> DataFrame:
    """pages (host, path, labelled, blocked, _prior, ...) with the template of each path, and in _prior its parent's purity."""
    generic = F.regexp_replace(F.col("path"), r"[0-9]+", "{n}")
    segments = F.array_remove(F.split(generic, "/"), "")
    pages = pages.withColumns({"_seg": F.when(F.size(segments) > DEPTH, F.concat(F.slice(segments, 1, DEPTH), F.array(F.lit("**")))).otherwise(segments), "template": F.lit("")})
    for level in range(DEPTH + 1):
        pages = pages.withColumn("_s", F.coalesce(F.get("_seg", F.lit(level)), F.lit("")))
        children = written(pages.groupBy("host", "template", "_s").agg(F.count("*").alias("n"), F.sum("labelled").alias("m"), F.sum("blocked").alias("k"), F.max("_prior").alias("prior")), "children")
        nodes = children.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("m").alias("all_m"), F.sum("k").alias("all_k"), F.count("*").alias("many"), F.max("prior").alias("up"))
        others = F.col("all_m") - F.col("m")
        rate, rest = F.try_divide(F.col("k"), F.col("m")), F.try_divide(F.col("all_k") - F.col("k"), others)
        pooled = F.try_divide(F.col("all_k"), F.col("all_m"))
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("m")) + F.try_divide(F.lit(1), others)))
        enough = (F.col("m") >= LEAST_LABELLED) & (others >= LEAST_LABELLED)
        same = F.coalesce(enough & (F.abs(rate - rest) <= ALIKE * error), F.lit(False))
        rare = (F.col("many") > MANY_CHILDREN) & (F.col("n") < RARE_SHARE * F.col("all_n"))
        name = F.when(F.col("_s") == "", "").when(same | rare, "/*").otherwise(F.concat(F.lit("/"), "_s"))
        purity = _smoothed(F.col("all_k"), F.col("all_m"), F.col("up"))
        named = written(children.join(nodes, ["host", "template"]).select("host", "template", "_s", name.alias("_name"), purity.alias("_purity")), "named")
        pages = pages.join(named, ["host", "template", "_s"])
        # A path that ended on an earlier level has its template already, and its labels count once.
        prior = F.when(F.size("_seg") >= level, F.col("_purity")).otherwise(F.col("_prior"))
        pages = pages.withColumns({"template": F.concat("template", "_name"), "_prior": prior}).drop("_s", "_name", "_purity")
    return pages.drop("_seg")


def judge(pages: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template, purity."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule_of(F.col("host"), F.col("path")), "_given": rule_of(F.col("host"), F.col("path"), 2)})
    rows = rows.withColumns({"labelled": F.when(F.col("_given").isNotNull(), 1).otherwise(0), "blocked": F.when(F.col("_given") == "block", 1).otherwise(0)})
    rows = rows.join(priors(rows), "host")
    rows = written(templates(rows), "templates")
    own = rows.groupBy("host", "template").agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("k"), F.max("_prior").alias("prior"))
    scored = written(own.select("host", "template", _smoothed(F.col("k"), F.col("m"), F.col("prior")).alias("purity")), "purity")
    out = rows.join(scored, ["host", "template"])
    verdict = F.coalesce("_given", F.when((F.col("host") != "") & F.col("_known") & (F.col("purity") >= REJECT), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
