"""URL filter by a path-template tree, in DataFrame functions only.

Fixed rules come first. Their verdicts label the pages they cover; the rest is judged by templates. A page's path is a
branch of its host's tree: segments that vary (with digits, or several unlabelled ones with a small share of their parent's
pages) become wildcards, sibling branches with statistically equal label rates are merged, and a template is rejected when
the smoothed share of blocked pages among its labelled ones is high. The tree goes down to the end of every path; a step that
all paths below a branch share, or that only one path has, neither varies nor merges and is passed over.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift.llm.common import cut

# Host, path and verdict of each rule.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@dataclass(frozen=True)
class UrlSpec:
    """Steps that every template shows (missing ones are empty), share of the parent's pages (one in ``rare``) below which an unlabelled segment is a variable, z
    up to which branches are merged, weight of the overall block rate in a template's purity, and the purity from which a
    template is rejected."""

    depth: int = 2
    rare: int = 50
    z: float = 1.96
    prior: float = 2.0
    purity: float = 0.8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule whose host is the page's or a parent of it and whose path begins the
    page's; null if none does."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _with_wildcards(shape: DataFrame, parent: list[str], segment: str, name: str, spec: UrlSpec) -> DataFrame:
    """Add ``name``: the segment, or '{*}' where it has no labelled page and a small share of its parent's pages.

    A single such segment does not vary and keeps its name.
    """
    own = shape.groupBy(*parent, segment).agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    whole = own.groupBy(*parent).agg(F.sum("_n").alias("_all"))
    # Stage results are handed over: what reads them more than once would plan and run all that lies before them again.
    rare = (F.col("_k") == 0) & (F.col("_n") * spec.rare < F.col("_all"))
    own = cut(own.join(whole, parent).select(*parent, segment, rare.alias("_rare")), "segments")
    several = own.where("_rare").groupBy(*parent).agg((F.count(F.lit(1)) > 1).alias("_several"))
    varies = F.col("_rare") & F.col("_several")
    named = own.join(several, parent, "left").select(*parent, segment, F.when(varies, F.lit("{*}")).otherwise(F.col(segment)).alias(name))
    return shape.join(named, [*parent, segment])


def _merged(branches: DataFrame, parent: list[str], branch: str, spec: UrlSpec) -> DataFrame:
    """Add ``m``: the branch, or the name of the group of similar siblings that it is merged into.

    ``branches`` has the parent's keys, the branch, n pages, k labelled and b blocked ones. Siblings with equal counts are
    pooled; pools in order of their block rate are tied to the one before where the two rates do not differ. What the
    ordering sees of a parent is one row for each pair of counts, not for each branch. Branches without labels stay.
    """
    pools = branches.where("k > 0").groupBy(*parent, "k", "b").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("k").alias("_k"), F.sum("b").alias("_b"), F.min(branch).alias("_first")
    )
    order = Window.partitionBy(*parent).orderBy(F.col("b") / F.col("k"), "k", "b")
    before_k, before_b = F.lag("_k").over(order), F.lag("_b").over(order)
    pooled = (F.col("_b") + before_b) / (F.col("_k") + before_k)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("_k") + 1 / before_k))
    differs = F.abs(F.col("_b") / F.col("_k") - before_b / before_k) > F.lit(spec.z) * spread
    number = F.sum(F.when(F.coalesce(differs, F.lit(True)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    groups = pools.withColumn("_g", number)
    sized = groups.groupBy(*parent, "_g").agg(F.sum("_c").alias("_size"), F.min("_first").alias("_name"))
    label = F.when(F.col("_size") > 1, F.concat(F.lit("*"), "_name")).alias("_m")
    named = groups.select(*parent, "k", "b", "_g").join(sized, [*parent, "_g"]).select(*parent, "k", "b", label)
    return branches.join(named, [*parent, "k", "b"], "left").select(*branches.columns, F.coalesce("_m", branch).alias("m"))


def _one_step(shape: DataFrame, spec: UrlSpec) -> DataFrame:
    """Add the name of the next step of every path to its ``_node``; a path that ends has the empty step."""
    parent = ["host", "_node"]
    shape = shape.withColumn("_step", F.coalesce(F.get("_s", F.col("_at")), F.lit("")))
    shape = cut(_with_wildcards(shape, parent, "_step", "_v", spec), "named")
    branches = cut(shape.groupBy(*parent, "_v").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("b").alias("b")), "branches")
    merged = _merged(branches, parent, "_v", spec).select(*parent, "_v", F.col("m").alias("_m"))
    joined = shape.join(merged, [*parent, "_v"])
    node = F.concat("_node", F.array("_m"))
    return cut(joined.select("host", "_s", "n", "k", "b", "_above_k", "_above_b", node.alias("_node"), (F.col("_at") + 1).alias("_at")), "shape")


def _named_to_the_end(tree: DataFrame, spec: UrlSpec) -> DataFrame:
    """Add ``_node``, the names of all steps, to every path of ``tree``, and to paths of more than ``spec.depth`` steps the
    labelled and blocked pages of the nearest branch above that has some, down to the ``spec.depth``-th step.

    After the first ``spec.depth`` steps, what all paths below a node share is added at once, so a round is needed for a
    branching only; the paths of a node without one are done.
    """
    shape = tree.withColumn("_node", F.array().cast("array<string>")).withColumn("_at", F.lit(0))
    long, none = F.size("_s") > spec.depth, F.lit(None).cast("bigint")
    shape = shape.withColumns({"_above_k": none, "_above_b": none})
    for _ in range(spec.depth):
        shape = _one_step(shape, spec)
    done = []
    while True:
        rest = F.slice("_s", F.col("_at") + 1, F.greatest(F.size("_s"), F.lit(1)))
        open_ = shape.withColumn("_rest", rest)
        # The first and the last in order share what all of them share.
        ends = open_.groupBy("host", "_node").agg(
            F.min("_rest").alias("_lo"), F.max("_rest").alias("_hi"), F.sum(F.when(long, F.col("k"))).alias("_ks"), F.sum(F.when(long, F.col("b"))).alias("_bs")
        )
        apart = F.array_position(F.zip_with("_lo", "_hi", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
        common = F.when(apart > 0, apart - 1).otherwise(F.size("_lo"))
        ends = ends.select("host", "_node", F.slice("_lo", F.lit(1), common).alias("_common"), (apart == 0).alias("_done"), "_ks", "_bs")
        node = F.concat("_node", "_common")
        at = (F.col("_at") + F.size("_common")).alias("_at")
        above = [F.when(long, F.when(F.col("_ks") > 0, F.col(f"_{c}s")).otherwise(F.col(f"_above_{c}"))).alias(f"_above_{c}") for c in "kb"]
        shape = cut(open_.join(ends, ["host", "_node"]).select("host", "_s", "n", "k", "b", *above, node.alias("_node"), at, "_done"), "ahead")
        done.append(shape.where("_done").drop("_at", "_done"))
        shape = shape.where("not _done").drop("_done")
        if shape.isEmpty():
            break
        shape = _one_step(shape, spec)
    return reduce(DataFrame.unionByName, done)


def judge(pages: DataFrame, spec: UrlSpec = UrlSpec(), id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    rule and its verdict come from the longest matching rule. Other pages are blocked when their template's purity
    reaches ``spec.purity``: ``(blocked + prior * base) / (labelled + prior)`` with the block rate of all labelled pages as
    base, which is also the purity of a template without labels. Beyond ``spec.depth`` steps a template without labels takes
    those of the nearest branch above it that has some. Null urls and urls without ``://`` have empty host and
    path and a template of their own host. Repeated rows are pages of their own; null ids stay. With no labelled page at
    all everything is allowed. An empty table gives an empty result.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hit = matching_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("_hit", hit).select("page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.col("_hit.verdict").alias("given"))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    base = base.withColumn("_s", F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), F.lit("{n}")).otherwise(s)))
    # Distinct paths with their counts stand for the pages: everything below moves one row for each of them.
    tree = base.groupBy("host", "_s").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("given").alias("k"),
        F.sum((F.col("given") == "block").cast("bigint")).alias("_b0"),
    )
    tree = cut(tree.withColumn("b", F.coalesce("_b0", F.lit(0))).drop("_b0"), "paths")
    shape = _named_to_the_end(tree, spec)
    overall = tree.agg(F.try_divide(F.sum("b"), F.sum("k")).alias("_base"))  # one row
    nodes = shape.groupBy("host", "_node").agg(F.sum("k").alias("_ks"), F.sum("b").alias("_bs")).join(F.broadcast(overall))
    shown = F.filter("_node", lambda m, i: (i < spec.depth) | (m != ""))
    judged = shape.join(nodes, ["host", "_node"]).select("host", "_s", "_base", F.concat_ws("/", "host", shown).alias("template"), *[
        F.coalesce(F.when(F.col("_ks") > 0, F.col(f"_{c}s")).otherwise(F.col(f"_above_{c}")), F.lit(0)).alias(c) for c in "kb"
    ])
    purity = F.coalesce((F.col("b") + F.lit(spec.prior) * F.col("_base")) / (F.col("k") + F.lit(spec.prior)), F.lit(0.0))
    # A template without labels, above it too, has no purity of its own and is not rejected.
    judged = judged.select("host", "_s", "template", purity.alias("purity"), (F.col("k") > 0).alias("_known"))
    # Many pages of one host may share a path; the join can be split on the pages' side.
    out = base.join(judged, ["host", "_s"], "left")
    learned = F.when(F.col("_known") & (F.col("purity") >= spec.purity), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", learned).alias("verdict"), "template", "purity")
