"""Page graphs: nodes and edges, strongly connected components by coloured reachability, and the graph of components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.staging import dropped, staged

#: Levels of nodes that one job takes off, and steps that colours go in one job.
LEVELS = 4


def build_graph(pages: DataFrame, links: DataFrame, members: DataFrame, templates: DataFrame | None = None, modules: DataFrame | None = None) -> DataFrame:
    """source, target, kind: edges whose ends exist (categories are pages of their own).

    Kinds: redirect, link, category, and transclusion: templates (page, template) and modules (page, module) that a page
    calls. Ends are prefixed titles; a page of another namespace than Main has its namespace before its title.
    """
    edges = pages.filter("is_redirect and redirect_target is not null").select(F.col("title").alias("source"), F.col("redirect_target").alias("target"), F.lit("redirect").alias("kind"))
    edges = edges.unionByName(links.select("source", "target", F.lit("link").alias("kind"))).unionByName(members.select("source", "target", F.lit("category").alias("kind")))
    for rows, name in ((templates, "template"), (modules, "module")):
        if rows is not None:
            edges = edges.unionByName(rows.select(F.col("page").alias("source"), F.col(name).alias("target"), F.lit("transclusion").alias("kind")))
    ends = pages.select("title").unionByName(pages.filter("namespace <> 'Main'").select(F.concat_ws(":", "namespace", "title").alias("title")))
    out = edges.distinct().join(ends.select(F.col("title").alias("source")), "source", "left_semi")
    known = ends.unionByName(members.select(F.col("target").alias("title"))).distinct()
    return out.join(known.select(F.col("title").alias("target")), "target", "left_semi").select("source", "target", "kind")


def filter_edges(edges: DataFrame, pages: DataFrame, namespaces: list[str] | None = None, kinds: list[str] | None = None, loops: bool = True) -> DataFrame:
    """Edges of the given kinds between pages of the given namespaces."""
    if kinds is not None:
        edges = edges.filter(F.col("kind").isin(kinds))
    if namespaces is not None:
        inside = pages.filter(F.col("namespace").isin(namespaces)).select("title")
        edges = edges.join(inside.withColumnRenamed("title", "source"), "source", "left_semi").join(inside.withColumnRenamed("title", "target"), "target", "left_semi").select(*edges.columns)
    return edges if loops else edges.filter("source <> target")


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges less those at nodes without an edge in or out, again and again; such nodes are components of their own."""
    left, n = edges, edges.count()
    while n:
        fewer = left
        for _ in range(LEVELS):
            fed = fewer.select(F.col("target").alias("source")).distinct()
            feeds = fewer.select(F.col("source").alias("target")).distinct()
            fewer = fewer.join(fed, "source", "left_semi").join(feeds, "target", "left_semi").select("source", "target")
        fewer = staged(fewer, "scc-edges")
        m = fewer.count()
        dropped(left)
        left = fewer
        if m == n:
            break
        n = m
    return left


def _coloured(edges: DataFrame, start: str = "source", end: str = "target") -> DataFrame:
    """node, colour: of all nodes that lead to it along start -> end, itself included, the one of the least hash.

    Colours go along edges, and from the node that a colour names to all that have it: what leads to that node leads to
    them. So long chains take few rounds.
    """
    colour = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    colour = staged(colour.withColumn("colour", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))), "scc-colour")
    while True:
        told = colour.withColumn("first", F.col("colour"))
        for _ in range(LEVELS):
            reach = edges.join(told.select(F.col("node").alias(start), "colour"), start).groupBy(F.col(end).alias("node")).agg(F.min("colour").alias("least"))
            told = told.join(reach, "node", "left").select("node", F.least("colour", F.coalesce("least", "colour")).alias("colour"), "first")
        far = told.select(F.col("node").alias("n"), F.col("colour").alias("further"))
        told = told.withColumn("n", F.col("colour.n")).join(far, "n").select("node", F.least("colour", "further").alias("colour"), "first")
        told = staged(told, "scc-colour")
        dropped(colour)
        colour = told.select("node", "colour")
        colour._staged_path = told._staged_path
        if not told.filter("colour <> first").head(1):
            return colour


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node), size, is_cyclic: strongly connected components of edges (source, target).

    Each round first drops, again and again, nodes without an edge in or out (components of their own). Then every node
    gets a colour forwards and, within that, one backwards: where both are the same node, it leads there and back, so
    these nodes are a component. Others go on with those that share both colours. As colours are hashes, what is left
    falls apart into many parts at once; rounds go on until no edge is left. All steps are grouped minima over edges,
    none of which holds a component in one task.
    """
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    loops = edges.filter("source = target").select(F.col("source").alias("node")).distinct()
    left = _trimmed(staged(edges.filter("source <> target").select("source", "target").distinct(), "scc-edges"))
    found = None
    while left.head(1):
        fore = _coloured(left)
        ends = lambda c, a, b: left.join(c.select(F.col("node").alias("source"), F.col("colour").alias(a)), "source").join(c.select(F.col("node").alias("target"), F.col("colour").alias(b)), "target")  # noqa: B023, E731
        within = staged(ends(fore, "a", "b").filter("a = b").select("source", "target"), "scc-within")
        back = _coloured(within, "target", "source")
        both = staged(fore.join(back.withColumnRenamed("colour", "back"), "node"), "scc-both")
        named = both.filter("colour = back").select("node", F.col("colour.n").alias("colour"))
        found = staged(named if found is None else found.unionByName(named), "scc-components")
        dropped(left)
        open_ = both.filter("colour <> back").select("node", F.struct("colour", "back").alias("colour"))
        left = within
        rest = staged(ends(open_, "a", "b").filter("a = b").select("source", "target"), "scc-edges")
        dropped(within, fore, back)
        left = _trimmed(rest)
    if found is None:
        out = nodes.withColumn("component", F.col("node"))
    else:
        least = found.groupBy("colour").agg(F.min("node").alias("component"))
        out = nodes.join(found.join(least, "colour").select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    size = out.groupBy("component").agg(F.count("*").alias("size"))
    out = out.join(size, "component").join(loops.withColumn("loop", F.lit(True)), "node", "left")
    return out.select("node", "component", "size", (F.col("loop").isNotNull() | (F.col("size") > 1)).alias("is_cyclic"))


def cycle_issues(edges: DataFrame) -> DataFrame:
    """title, rule, severity, line, evidence: pages in a cycle of redirects, categories or transclusions (source, target, kind)."""
    out = None
    for kind, rule in (("redirect", "graph.redirect_loop"), ("category", "graph.category_cycle"), ("transclusion", "graph.transclusion_cycle")):
        found = components(edges.filter(F.col("kind") == kind)).filter("size > 1")
        severity = "error" if kind == "redirect" else "warning"
        told = found.select(F.col("node").alias("title"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(1).alias("line"), F.concat(F.lit("component_size="), "size").alias("evidence"))
        out = told if out is None else out.unionByName(told)
    return out


def condensation(edges: DataFrame, found: DataFrame) -> DataFrame:
    """component, size, n_in, n_out: how many other components each is reached from and leads to."""
    of = found.select("node", "component")
    between = edges.join(of.select(F.col("node").alias("source"), F.col("component").alias("a")), "source").join(of.select(F.col("node").alias("target"), F.col("component").alias("b")), "target").filter("a <> b").select("a", "b").distinct()
    out = found.select("component", "size").distinct()
    out = out.join(between.groupBy(F.col("b").alias("component")).agg(F.count("*").alias("n_in")), "component", "left").join(between.groupBy(F.col("a").alias("component")).agg(F.count("*").alias("n_out")), "component", "left")
    zero = F.lit(0).cast("long")
    return out.select("component", "size", F.coalesce("n_in", zero).alias("n_in"), F.coalesce("n_out", zero).alias("n_out"))
