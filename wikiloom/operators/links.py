"""Queries on the page index: links, redirects, categories, validation, suggestions and bounded listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.staging import small


def index_stats(pages: DataFrame) -> DataFrame:
    """namespace, pages, redirects, bytes."""
    return pages.groupBy("namespace").agg(F.count("*").alias("pages"), F.count_if("is_redirect").alias("redirects"), F.sum("bytes").alias("bytes"))


def articles(pages: DataFrame) -> DataFrame:
    return pages.filter((F.col("namespace") == "Main") & ~F.col("is_redirect"))


def outgoing(links: DataFrame) -> DataFrame:
    return links.groupBy("source").agg(F.count("*").alias("n_links"), F.min("target").alias("first_target"), F.max("target").alias("last_target"))


def backlinks(links: DataFrame) -> DataFrame:
    """target, source: distinct."""
    return links.select("target", "source").distinct()


def resolve_aliases(titles: DataFrame, aliases: DataFrame, hops: int = 6) -> DataFrame:
    """title, resolved, hops: along alias -> canonical until there is none, a title comes again, or `hops` are made.

    Aliases are followed among themselves, their paths at most `hops` long; the titles are joined once.
    """
    step = aliases.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    go = F.col("canonical").isNotNull() & ~F.array_contains("path", F.col("canonical"))
    now = step.select(F.col("alias").alias("title"), F.col("alias").alias("at"), F.array("alias").alias("path"))
    for _ in range(hops):
        moved = now.join(step, F.col("at") == F.col("alias"), "left")
        now = moved.select("title", F.when(go, F.col("canonical")).otherwise(F.col("at")).alias("at"), F.when(go, F.array_append("path", F.col("canonical"))).otherwise(F.col("path")).alias("path"))
    told = titles.select("title").join(now, "title", "left")
    return told.select("title", F.coalesce("at", "title").alias("resolved"), F.coalesce(F.size("path") - 1, F.lit(0)).cast("long").alias("hops"))


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Articles that no other article links to."""
    main = articles(pages)
    from_articles = links.join(main.select(F.col("title").alias("source")), "source", "left_semi").filter("source <> target").select("target").distinct()
    return main.join(from_articles, main["title"] == from_articles["target"], "left_anti").select("title")


def broken_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """source, target: links and redirects to titles without a page."""
    made = links.select("source", "target").unionByName(pages.filter("is_redirect and redirect_target is not null").select(F.col("title").alias("source"), F.col("redirect_target").alias("target")))
    return made.join(pages.select(F.col("title").alias("target")), "target", "left_anti").select("source", "target").distinct()


def double_redirects(pages: DataFrame) -> DataFrame:
    """title, first_target, final_target."""
    r = pages.filter("is_redirect").select("title", "redirect_target")
    again = r.select(F.col("title").alias("first_target"), F.col("redirect_target").alias("final_target"))
    return r.join(again, r["redirect_target"] == again["first_target"]).select("title", "first_target", "final_target")


def uncategorized(pages: DataFrame, members: DataFrame) -> DataFrame:
    return articles(pages).join(members.select(F.col("source").alias("title")), "title", "left_anti").select("title")


def empty_categories(categories: DataFrame, members: DataFrame) -> DataFrame:
    return categories.select("title").join(members.select(F.col("target").alias("title")), "title", "left_anti")


def validation(pages: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """kind, title, detail of every problem."""
    none = F.lit("").alias("detail")
    return (
        broken_links(pages, links).select(F.lit("broken_link").alias("kind"), F.col("source").alias("title"), F.col("target").alias("detail"))
        .unionByName(double_redirects(pages).select(F.lit("double_redirect").alias("kind"), "title", F.concat_ws(" > ", "first_target", "final_target").alias("detail")))
        .unionByName(uncategorized(pages, members).select(F.lit("uncategorized").alias("kind"), "title", none))
        .unionByName(orphans(pages, links).select(F.lit("orphan").alias("kind"), "title", none))
    )


def first_per_group(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group; Spark limits each task's rows before they are shuffled."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", at).filter(F.col("place") <= most)


def verified(problems: DataFrame, live: DataFrame) -> DataFrame:
    """kind, title, detail, status: what the live wiki (title, exists, is_redirect) says of the title that is missing."""
    asked = F.when(F.col("kind") == "broken_link", F.col("detail")).otherwise(F.col("title"))
    told = problems.withColumn("asked", asked).join(live.select(F.col("title").alias("asked"), F.col("is_redirect").alias("live_redirect"), F.lit(True).alias("exists")), "asked", "left")
    status = (
        F.when((F.col("kind") == "broken_link") & F.col("exists"), "local_only")
        .when(F.col("exists").isNull() & (F.col("kind") != "broken_link"), "missing_live")
        .when(F.col("live_redirect"), "redirect_live")
        .otherwise("confirmed")
    )
    return told.select("kind", "title", "detail", status.alias("status"))


def within_budget(rows: DataFrame, keys: list[str], order: list[Column], tokens: str, budget: int, most: int) -> DataFrame:
    """Rows in order until the budget would be passed or `most` are taken; the first is always taken."""
    w = Window.partitionBy(*keys).orderBy(*order)
    told = rows.withColumn("place", F.row_number().over(w)).withColumn("total", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return told.filter(((F.col("place") == 1) | (F.col("total") <= budget)) & (F.col("place") <= most))


def suggestions(sources: DataFrame, links: DataFrame, most: int, evidence: int = 4) -> DataFrame:
    """group, target, n_sources, place, evidence: what the given pages (group, source) link to, by how many of a group's
    pages do, with the first `evidence` sources. A hub's sources are counted and ranked in their tasks, never gathered."""
    pairs = links.join(sources, "source").select("group", "target", "source").distinct()
    ranked = first_per_group(pairs.groupBy("group", "target").agg(F.count("*").alias("n_sources")), ["group"], [F.desc("n_sources"), F.asc("target")], most)
    few = first_per_group(pairs, ["group", "target"], [F.asc("source")], evidence).groupBy("group", "target").agg(F.array_join(F.array_sort(F.collect_list("source")), "; ").alias("evidence"))
    return ranked.join(few, ["group", "target"])


def prefix_category(titles: DataFrame, mapping: DataFrame, default: str = "misc") -> DataFrame:
    """title, category of the longest prefix (mapping: prefix, category) that the title begins with.

    Titles are dealt to their beginnings of the lengths that prefixes have, so the match is a hash join; of equal prefixes
    the greatest category counts.
    """
    lengths = [r[0] for r in mapping.select(F.char_length("prefix")).distinct().collect()]  # as many as prefixes have lengths
    begins = F.explode(F.array(*[F.left("title", F.lit(n)) for n in sorted(lengths)]) if lengths else F.array().cast("array<string>"))
    best = mapping.groupBy("prefix").agg(F.max("category").alias("category"))
    hits = titles.select("title").distinct().select("title", begins.alias("prefix")).join(small(best), "prefix")
    best = hits.groupBy("title").agg(F.max_by("category", F.struct(F.char_length("prefix"), "prefix")).alias("category"))
    return titles.join(best, "title", "left").withColumn("category", F.coalesce("category", F.lit(default)))


def page_summaries(pages: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """title, summary: of the first section, else the first chunk, else empty."""
    s = sections.filter("summary <> ''").groupBy("title").agg(F.min_by("summary", "place").alias("a"))
    c = chunks.groupBy("title").agg(F.min_by("summary", "place").alias("b"))
    return pages.select("title").join(s, "title", "left").join(c, "title", "left").select("title", F.coalesce("a", "b", F.lit("")).alias("summary"))


def context(pages: DataFrame, links: DataFrame, members: DataFrame, invocations: DataFrame) -> DataFrame:
    """One row per article: what it links to, what links to it, its categories and templates, in numbers and first names.

    Each side is summed by page before the join, so a page that all others link to adds one row.
    """
    out = articles(pages).select("title")
    for rows, key, other, name in ((links, "source", "target", "links"), (links, "target", "source", "backlinks"), (members, "source", "target", "categories"), (invocations, "page", "template", "templates")):
        side = rows.groupBy(F.col(key).alias("title")).agg(F.count_distinct(other).alias(f"n_{name}"), F.min(other).alias(f"first_{name}"))
        out = out.join(side, "title", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long")))
    return out


def same_index(before: DataFrame, now: DataFrame) -> DataFrame:
    """unchanged (whether all paths and hashes agree), added, removed, changed: in numbers."""
    both = before.select("path", F.col("hash").alias("old")).join(now.select("path", F.col("hash").alias("new")), "path", "full")
    n = both.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old") != F.col("new")).alias("changed"))
    return n.withColumn("unchanged", (F.col("added") + F.col("removed") + F.col("changed")) == 0)


def page_by_title(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """query, and the page of that title (query, text), whatever the case of its letters; the first by title where several are."""
    found = asked.select("query", F.lower("text").alias("key")).join(pages.withColumn("key", F.lower("title")), "key").drop("key")
    return first_per_group(found, ["query"], [F.asc("title")], 1).drop("place")


def without_pages(tables: dict[str, DataFrame], gone: DataFrame, key: dict[str, str]) -> dict[str, DataFrame]:
    """Each table without the rows whose key column names a page of gone (title): a delete that goes through all tables."""
    return {name: t.join(gone.select(F.col("title").alias(key[name])), key[name], "left_anti").select(*t.columns) if name in key else t for name, t in tables.items()}


def readiness(counts: dict[str, DataFrame], artifacts: DataFrame, needed: list[str]) -> DataFrame:
    """One row: status (ready, degraded, empty), missing (needed artifacts that aren't there) and empty tables, comma-joined."""
    n = None
    for name, t in counts.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        n = one if n is None else n.unionByName(one)
    bare = n.agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.col("table")))), ",").alias("empty"))
    have = artifacts.filter(F.col("kind").isin(needed)).agg(F.collect_set("kind").alias("have"))
    told = bare.crossJoin(have).withColumn("missing", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, needed)), "have")), ","))
    status = F.when(F.col("total") == 0, "empty").when((F.col("missing") != "") | (F.col("empty") != ""), "degraded").otherwise("ready")
    return told.select(status.alias("status"), "missing", "empty")
