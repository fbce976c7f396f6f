"""URL filters: rules first, then a tree of path templates for each host.

Paths are cut into segments, however many.  Typed segments (numbers, long hexadecimal
strings) become wildcards at once.  Each node (host and template so far) keeps those segments
as literals that hold a fair share of its pages, and turns the others into ``*``, with a file
name's suffix where that holds a fair share, so a node has a bounded number of branches.  A node
with too few pages for any literal has wildcards only below it.

Branches of a node are merged, lower nodes first, where a chi-square test finds no difference
between their pages' distributions over the templates below them, nor between the labels of
their labelled pages, to which ``PRIOR_PAGES`` pages of the prior are added.  A template's
purity is its share of bad labels among its labelled pages, smoothed: each level adds
``PRIOR_PAGES`` pages of a purity halfway between the one above and the prior, so a template
with few labels leans towards its branch, and a host without any has the prior.  Pages of
templates at or above the limit are blocked.

A node small enough for a task (``PART_SEGMENTS``) goes to one with all that is below it, so
the number of jobs does not grow with the depth of paths; only larger nodes are cut level by
level, by aggregates and joins, and their branches compared by sums over the cells that two
branches share.  Both ways give the same templates.

Labels come with the pages; the registered query takes the rules' verdicts for labels, as
the corpus has no others for pages.  A host with a third of all pages needs no task of its own.

Defined results: a null URL, or one without ``://``, has empty host and path and fits no
rule; query and fragment never count; repeated URLs count as often as they occur.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import stash

#: Share and number of a node's pages that make a segment a literal.
LITERAL_SHARE, LITERAL_PAGES = 0.02, 3
#: Standard normal quantile up to which the test finds no difference (1 % of like branches stay apart).
ALIKE = 2.326
#: A node goes to one task if it has at most so many open segments, or so few distinct paths.
PART_SEGMENTS, PART_ROWS = 1_000_000, 64
#: Bad share of a host without labels, how many pages of the purity above a level adds, and the limit.
PRIOR, PRIOR_PAGES, LIMIT = 0.1, 10.0, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (rule, verdict): host, and path from the first slash on.
Rule = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty where the URL is null or has no ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_verdict(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits; null if none does."""
    fits = []
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        here = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits.append(F.when(here, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def typed_segments(path: Column) -> Column:
    """Segments of a path; numbers are ``{n}``, long hexadecimal strings ``{h}``."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f]{8,}\b", "{h}"), r"[0-9]+", "{n}"))


def _wild(segment: Column) -> Column:
    """``*``, with a file name's suffix; an empty segment stays."""
    return F.when(segment == "", segment).otherwise(F.regexp_replace(segment, r"^.*?(\.[a-z]{2,5})?$", "*$1"))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("labelled", "bad", "pages")]


def templates(urls: DataFrame) -> DataFrame:
    """host, segments (typed), template, purity and template_pages for every distinct (host, segments).

    ``urls``: host, segments, bad (1, 0 or null for no label).
    """
    label = [F.count("bad").alias("labelled"), F.sum(F.coalesce("bad", F.lit(0))).cast("long").alias("bad"), F.count(F.lit(1)).alias("pages")]
    tree = urls.groupBy("host", "segments").agg(*label).withColumn("wilds", F.transform("segments", _wild))
    tree, depth = cut_large(stash(tree.withColumn("t", F.array().cast("array<string>"))))
    is_open = F.size("segments") > F.size("t")
    parts = tree.where(is_open).groupBy("host", "t").applyInArrow(settle, _SETTLED)
    closed = tree.where(~is_open).select("host", "segments", "labelled", "bad", "pages", "t", F.array().cast("array<string>").alias("low"))
    rows = stash(closed.unionByName(parts))
    if depth:
        rows = rows.join(merge_large(rows.groupBy("host", "t", "low").agg(*_sums()), depth), ["host", "t", "low"])
    else:
        rows = rows.withColumnRenamed("low", "shape")
    purity = purities(rows.groupBy("host", "shape").agg(*_sums()))
    return rows.join(purity, ["host", "shape"]).select("host", "segments", F.concat(F.lit("/"), F.array_join("shape", "/")).alias("template"), "purity", "template_pages")


def _fair(own: Column, whole: Column) -> Column:
    return (own >= LITERAL_SHARE * whole) & (own >= LITERAL_PAGES)


def cut_large(tree: DataFrame) -> tuple[DataFrame, int]:
    """``tree`` with the segments of nodes too large for a task replaced in ``t``, and the number of levels cut."""
    level = 0
    while True:
        rows = tree.where((F.size("t") == level) & (F.size("segments") > level))
        large = rows.groupBy("host", "t").agg(F.sum("pages").alias("all"), F.count(F.lit(1)).alias("n"), F.sum(F.size("segments") - level).alias("weight"))
        large = stash(large.where((F.col("weight") > PART_SEGMENTS) & (F.col("n") > PART_ROWS) & (F.col("all") >= LITERAL_PAGES)).select("host", "t", "all"))
        if large.isEmpty():
            return tree, level
        s, w = F.get("segments", F.lit(level)), F.get("wilds", F.lit(level))
        both = F.explode(F.array(F.struct(s.alias("v"), F.lit(True).alias("literal")), F.struct(w.alias("v"), F.lit(False).alias("literal")))).alias("x")
        own = rows.select("host", "t", "pages", both).groupBy("host", "t", "x").agg(F.sum("pages").alias("own"))
        fair = own.join(large, ["host", "t"]).where(_fair(F.col("own"), F.col("all")))
        kept = fair.groupBy("host", "t").agg(*[F.collect_list(F.when(F.col("x.literal") == k, F.col("x.v"))).alias(name) for name, k in (("literals", True), ("suffixes", False))])
        kept = stash(large.select("host", "t").join(kept, ["host", "t"], "left").withColumn("large", F.lit(True)))
        has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
        shown = F.when((s == "") | has("literals", s), s).when(has("suffixes", w), w).otherwise("*")
        here = F.col("large") & (F.size("segments") > level)
        tree = stash(tree.join(kept, ["host", "t"], "left").withColumn("t", F.when(here, F.concat("t", F.array(shown))).otherwise(F.col("t"))).select(*tree.columns))
        level += 1


_SETTLED = "host string, segments array<string>, labelled long, bad long, pages long, t array<string>, low array<string>"


def settle(rows: pa.Table) -> pa.Table:
    """``low``: the template of each path of one node below that node, all levels at once."""
    segments, wilds, t = (rows.column(c).to_pylist() for c in ("segments", "wilds", "t"))
    labelled, bad, pages = (rows.column(c).to_pylist() for c in ("labelled", "bad", "pages"))
    start = len(t[0])
    shape = [list(x) for x in wilds]
    nodes: list[tuple[int, dict[str, list[int]]]] = []  # with pages enough, upper ones first
    live_to = [start] * len(segments)
    todo = [(start, list(range(len(segments))))]
    while todo:
        level, mine = todo.pop()
        mine = [i for i in mine if len(segments[i]) > level]
        whole = sum(pages[i] for i in mine)
        if whole < LITERAL_PAGES:
            continue
        least = max(LITERAL_PAGES, LITERAL_SHARE * whole)
        own, suffix = Counter(), Counter()
        for i in mine:
            own[segments[i][level]] += pages[i]
            suffix[wilds[i][level]] += pages[i]
        branches = defaultdict(list)
        for i in mine:
            s, w = segments[i][level], wilds[i][level]
            shape[i][level] = shown = s if s == "" or own[s] >= least else w if suffix[w] >= least else "*"
            branches[shown].append(i)
            live_to[i] = level + 1
        nodes.append((level, branches))
        todo += [(level + 1, x) for x in branches.values()]
    # Ends of templates as numbers: 0 is the empty one.
    ends: dict[tuple[str, int], int] = {("", 0): 1}
    end = [0] * len(segments)
    for i, x in enumerate(shape):
        for s in reversed(x[live_to[i]:]):
            end[i] = ends.setdefault((s, end[i]), len(ends) + 1)
    for level, branches in reversed(nodes):
        name = {b: b for b in branches}
        if len(branches) > 1:
            cells = {b: Counter() for b in branches}
            figures = []
            for b, mine in branches.items():
                for i in mine:
                    cells[b][end[i] if end[i] > 1 else 0] += pages[i]  # a closing slash is no template of its own
                figures.append((b, sum(pages[i] for i in mine), len(cells[b]), sum(bad[i] for i in mine), sum(labelled[i] - bad[i] for i in mine)))

            def shared(a: str, b: str) -> tuple[float, int]:
                both = cells[a].keys() & cells[b].keys()
                return sum(cells[a][c] * cells[b][c] / (cells[a][c] + cells[b][c]) for c in both), len(both)

            name = group_names(figures, shared)
        for b, mine in branches.items():
            for i in mine:
                shape[i][level] = name[b]
                end[i] = ends.setdefault((name[b], end[i]), len(ends) + 1)
    low = pa.array([x[start:] for x in shape], pa.list_(pa.string()))
    return rows.select(["host", "segments", "labelled", "bad", "pages", "t"]).append_column("low", low)


def merge_large(names: DataFrame, depth: int) -> DataFrame:
    """host, t, low, shape: the branches of nodes that were cut by Spark, merged from ``depth`` levels up.

    ``names``: one row a (host, t, low), with sums.
    """
    names = stash(names.withColumn("shape", F.concat("t", "low")))
    for level in range(depth - 1, -1, -1):
        deep = F.size("t") > level
        rest = lambda: F.slice("shape", F.lit(level + 2), F.greatest(F.size("shape") - level - 1, F.lit(0)))  # noqa: E731,B023
        keyed = names.withColumn("above", F.when(deep, F.slice("t", F.lit(1), F.lit(level)))).withColumn("branch", F.when(deep, F.get("t", F.lit(level))))
        cells = stash(keyed.where(deep).groupBy("host", "above", "branch", F.md5(F.array_join(rest(), "/")).alias("below")).agg(*_sums()))
        total = cells.groupBy("host", "above", "branch").agg(F.sum("pages").alias("n"), F.count(F.lit(1)).alias("cells"), F.sum("bad").alias("bad"), F.sum(F.col("labelled") - F.col("bad")).alias("good"))
        # A cell has one row a branch, of which a node has about a hundred at most.
        one, other = (cells.select("host", "above", "below", F.col("branch").alias(b), F.col("pages").alias(n)) for b, n in (("a", "x"), ("b", "y")))
        common = one.join(other, ["host", "above", "below"]).where(F.col("a") < F.col("b")).groupBy("host", "above", "a", "b")
        common = common.agg(F.sum(F.col("x") * F.col("y") / (F.col("x") + F.col("y"))).alias("product"), F.count(F.lit(1)).alias("both"))
        total = total.toDF(*total.columns)  # both sides read ``cells``: attributes of their own
        merged = total.groupBy("host", "above").cogroup(common.groupBy("host", "above")).applyInPandas(merge_branches, "host string, above array<string>, branch string, name string")
        renamed = F.concat(F.slice("shape", F.lit(1), F.lit(level)), F.array("name"), rest())
        names = keyed.join(merged, ["host", "above", "branch"], "left").withColumn("shape", F.when(F.col("name").isNotNull(), renamed).otherwise(F.col("shape")))
        names = stash(names.drop("above", "branch", "name"))
    return names.select("host", "t", "low", "shape")


def purities(whole: DataFrame) -> DataFrame:
    """host, shape, purity, template_pages of templates (host, shape, labelled, bad, pages).

    Purity is worked out from the host down along each template: at every level the branch's
    labelled pages, and PRIOR_PAGES pages halfway between the purity above and the prior.
    """
    path = F.transform(F.sequence(F.lit(0), F.size("shape")), lambda d: F.struct(d.alias("d"), F.md5(F.array_join(F.slice("shape", F.lit(1), d), "/")).alias("node")))
    marked = whole.where("labelled > 0")  # the others change no purity
    nodes = marked.select("host", "labelled", "bad", F.inline(path)).groupBy("host", "d", "node").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    path = whole.select("host", "shape", "pages", F.inline(path)).join(nodes, ["host", "d", "node"], "left")
    steps = path.groupBy("host", "shape").agg(F.max("pages").alias("template_pages"), F.array_sort(F.collect_list(F.struct("d", F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("b", F.lit(0)).alias("b")))).alias("x"))
    purity = F.aggregate("x", F.lit(PRIOR), lambda p, x: (x["b"] + (p + PRIOR) / 2 * PRIOR_PAGES) / (x["l"] + PRIOR_PAGES))
    return steps.select("host", "shape", purity.alias("purity"), "template_pages")


def alike(total: tuple[float, float], cells: tuple[int, int], product: float, both: int) -> bool:
    """Whether a chi-square test of homogeneity finds no difference between two rows of counts; one without counts is like any.

    ``total``, ``cells``: sums and numbers of the counts above 0; ``product``: sum of a b / (a + b) over
    the ``both`` cells in which both rows have counts.  The statistic is a function of these.
    """
    (a, b), df = total, sum(cells) - both - 1
    if df < 1 or not a or not b:
        return True
    value = (a + b) * (1 - product * (a + b) / (a * b))
    return value <= df * (1 - 2 / (9 * df) + ALIKE * (2 / (9 * df)) ** 0.5) ** 3  # Wilson and Hilferty's quantile


def group_names(figures: list[tuple[str, int, int, int, int]], shared: Callable[[str, str], tuple[float, int]]) -> dict[str, str]:
    """Names for a node's branches (branch, pages, cells, bad, good): a branch joins the first larger one that it is like."""
    groups: list[list[tuple]] = []
    for x in sorted(figures, key=lambda x: (-x[1], x[0])):
        bad, good = x[3] + PRIOR * PRIOR_PAGES, x[4] + (1 - PRIOR) * PRIOR_PAGES
        for g in groups:
            y = g[0]
            bad2, good2 = y[3] + PRIOR * PRIOR_PAGES, y[4] + (1 - PRIOR) * PRIOR_PAGES
            labels = bad * bad2 / (bad + bad2) + good * good2 / (good + good2)
            if alike((bad + good, bad2 + good2), (2, 2), labels, 2) and alike((y[1], x[1]), (y[2], x[2]), *shared(y[0], x[0])):
                g.append(x)
                break
        else:
            groups.append([x])
    return {x[0]: "|".join(sorted(x[0] for x in g)) for g in groups for x in g}


def merge_branches(total: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
    """:func:`group_names` for one node: a row a branch and a row a pair of branches that share a cell."""
    sums = {(a, b): (p, int(n)) for a, b, p, n in common[["a", "b", "product", "both"]].itertuples(index=False)}
    name = group_names(list(total[["branch", "n", "cells", "bad", "good"]].itertuples(index=False, name=None)), lambda a, b: sums.get((min(a, b), max(a, b)), (0.0, 0)))
    return pd.DataFrame([(total.host.iloc[0], total.above.iloc[0], b, n) for b, n in name.items()], columns=["host", "above", "branch", "name"])


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, template, purity for every page.

    The rules' verdicts are final, and they are the labels from which templates are judged.
    """
    host, path = host_and_path(F.col(url))
    seen = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    seen = seen.withColumn("fit", rule_verdict(F.col("host"), F.col("path"), rules)).withColumn("segments", typed_segments(F.col("path")))
    known = stash(templates(seen.select("host", "segments", (F.col("fit.verdict") == "block").cast("int").alias("bad"))))
    judged = seen.join(known, ["host", "segments"], "left")
    own = F.when(F.col("purity") >= LIMIT, "block").otherwise("allow")
    return judged.select(key, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"), "template", "purity")
