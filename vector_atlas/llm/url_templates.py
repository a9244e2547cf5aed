"""URL filters with a tree of path templates.

Paths are reduced to shapes first (runs of digits and long hexadecimal runs become wildcards), so the
tree is built over distinct (host, shape) with counts. Then, branch by branch, the children of a node
that look like the others of the node are merged: a child stays a literal only if its share of blocked
labels or of paths that end there differs significantly from the pool of its siblings (chi-square with
the correction for small counts), however many there are. A stretch without branches is passed in one
step, so rounds count the branches on a path, not its segments. They go on until all segments are used
up. Each template's blocked share is
smoothed towards its parent's, up to the host's and the corpus's; templates above the threshold are
rejected.
Labels come from the rules, wherever one fits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vector_atlas.llm.tables import sized
from vector_atlas.session import materialise

#: Rules (host and path together) and their verdicts.
RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TreeConfig:
    critical: float = 3.84  # chi-square of one degree of freedom at 5 %
    smoothing: float = 4.0
    threshold: float = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        own, _, prefix = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + prefix))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """The path with variable runs as wildcards."""
    hexed = F.regexp_replace(path, r"(?<![0-9A-Za-z])[0-9a-f]{8,}(?![0-9A-Za-z])", "{h}")
    return F.regexp_replace(hexed, r"[0-9]+", "{n}")


def template_rates(shapes: DataFrame, cfg: TreeConfig = TreeConfig()) -> DataFrame:
    """``host, shape, template, rate``; ``shapes``: host, shape, n, blocked, labelled, one row per host and shape."""
    segments = F.filter(F.split("shape", "/"), lambda s: s != "")
    state = shapes.withColumns({"segments": segments, "prefix": F.lit(""), "at": F.lit(0)})
    top = state.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    base = ((top["b"] or 0) + 1) / ((top["l"] or 0) + 2)

    def smoothed(parent):
        return (F.col("blocked") + cfg.smoothing * parent) / (F.col("labelled") + cfg.smoothing)

    hosts = materialise(state.groupBy("host").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")), "hosts")
    state = materialise(state.join(hosts.select("host", smoothed(F.lit(base)).alias("rate")), "host"), "tree")
    done = []
    while True:
        # what all shapes of a node have in common is passed in one step: the common start of the smallest and the
        # largest of their rests, smoothed once per segment
        rest = F.slice("segments", F.col("at") + 1, F.size("segments") + 1)
        nodes = state.groupBy("host", "prefix").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"), F.sum("blocked").alias("nb"), F.sum("labelled").alias("nl"))
        shorter = F.least(F.size("lo"), F.size("hi"))
        same = F.transform(F.sequence(F.lit(0), shorter - 1), lambda i: F.get("lo", i) == F.get("hi", i))
        steps = F.when(shorter == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, shorter)).cast("int")
        nodes = nodes.withColumn("steps", steps).select("host", "prefix", "steps", F.array_join(F.slice("lo", 1, F.col("steps")), "/").alias("passed"), "nb", "nl")
        own = F.col("nb") / F.col("nl")
        shrunk = own + (F.col("rate") - own) * F.pow(cfg.smoothing / (F.col("nl") + cfg.smoothing), F.col("steps"))
        moved = state.join(materialise(nodes, "nodes"), ["host", "prefix"]).withColumns({
            "prefix": F.when(F.col("steps") > 0, F.concat("prefix", F.lit("/"), "passed")).otherwise(F.col("prefix")),
            "rate": F.when(F.col("nl") == 0, F.col("rate")).otherwise(shrunk), "at": F.col("at") + F.col("steps")})
        state = materialise(moved.drop("steps", "passed", "nb", "nl"), "level")
        done.append(state.where(F.size("segments") == F.col("at")).select("host", "shape", F.col("prefix").alias("template"), "rate"))
        state = state.where(F.size("segments") > F.col("at")).withColumn("segment", F.get("segments", F.col("at")))
        ends = F.sum(F.when(F.size("segments") == F.col("at") + 1, F.col("n")).otherwise(0))
        kids = state.groupBy("host", "prefix", "segment").agg(
            F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), ends.alias("ends"), F.first("rate").alias("rate"))
        kids = materialise(kids, "children")
        pool = materialise(kids.groupBy("host", "prefix").agg(
            F.count("*").alias("p_kids"), *[F.sum(c).alias("p_" + c) for c in ("n", "blocked", "labelled", "ends")]), "pools")
        if pool.isEmpty():
            return reduce(DataFrame.unionByName, done)

        def differs(part, whole):
            p = F.try_divide(F.col("p_" + part), F.col("p_" + whole))
            expected, spread = F.col(whole) * p, F.col(whole) * p * (1 - p)
            off = F.greatest(F.abs(F.col(part) - expected) - 0.5, F.lit(0.0))
            return F.coalesce(off * off > cfg.critical * spread, F.lit(False)) & (F.coalesce(spread, F.lit(0)) > 0)

        alike = ~differs("blocked", "labelled") & ~differs("ends", "n")
        name = F.when((F.col("p_kids") > 1) & alike, "*").otherwise(F.col("segment"))
        named = kids.join(pool, ["host", "prefix"]).select(*kids.columns, F.concat("prefix", F.lit("/"), name).alias("node"))
        rates = named.groupBy("host", "node").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.first("rate").alias("parent"))
        rates = materialise(rates.select("host", "node", smoothed(F.col("parent")).alias("node_rate")), "rates")
        names = materialise(named.select("host", "prefix", "segment", "node").join(rates, ["host", "node"]), "names")
        state = materialise(state.join(names, ["host", "prefix", "segment"]).withColumns(
            {"prefix": F.col("node"), "rate": F.col("node_rate"), "at": F.col("at") + 1}).drop("node", "node_rate", "segment"), "tree")


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, cfg: TreeConfig = TreeConfig()) -> DataFrame:
    """``pages`` plus ``host, path, rule, verdict, template, purity``.

    Where a rule fits, its verdict holds; else the url's template decides: ``purity`` is its smoothed
    share of blocked labels. Without any label the corpus counts as half blocked and half allowed, and
    a purity equal to the threshold is allowed. A null url has an empty host and path, like one without
    ``://``; rows that repeat a url are judged alike and count as often as they occur. Columns of ``pages``
    with the names of the new ones are replaced. An empty table gives no row.
    """
    host, path = parts(F.col(url_col))
    seen = pages.drop(*(c for c in ("rule", "verdict", "template", "purity", "rate") if c != url_col)).withColumns({"host": host, "path": path})
    seen = seen.withColumn("__rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("__shape", shape(F.col("path")))
    blocked = F.when(F.col("__rule.verdict") == "block", 1).otherwise(0)
    shapes = materialise(
        seen.groupBy("host", F.col("__shape").alias("shape")).agg(
            F.count("*").alias("n"), F.sum(blocked).alias("blocked"), F.count("__rule.verdict").alias("labelled")), "shapes")
    rates = materialise(template_rates(shapes, cfg).withColumnRenamed("shape", "__shape"), "templates")
    judged = seen.join(sized(rates), ["host", "__shape"])
    own = F.when(F.col("rate") > cfg.threshold, "block").otherwise("allow")
    return judged.withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce("__rule.verdict", own)}).withColumnRenamed("rate", "purity").drop("__rule", "__shape")
