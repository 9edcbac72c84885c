"""What is known about a topic before it is written: assessments, stubs, headings of comparable pages, ledgers, push plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.operators.links import first_per_group
from wikiloom.operators.markup import sections, template_calls, wikilinks
from wikiloom.operators.search import title_like


def topic_assessment(asked: DataFrame, pages: DataFrame, backlinks: DataFrame, most: int = 8) -> DataFrame:
    """query, exists, hits (titles that contain it, `most` at most, joined), n_backlinks of the page of that title: for asked
    (query, text)."""
    exact = asked.select("query", F.lower("text").alias("key")).join(pages.select("title", F.lower("title").alias("key")), "key").groupBy("query").agg(F.min("title").alias("title"))
    near = title_like(asked, pages, most).groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x.title), "; ").alias("hits"))
    n = exact.join(backlinks.select(F.col("target").alias("title"), "source"), "title").groupBy("query").agg(F.count_distinct("source").alias("n"))
    told = asked.select("query").join(exact, "query", "left").join(near, "query", "left").join(n, "query", "left")
    return told.select("query", F.col("title").isNotNull().alias("exists"), F.coalesce("hits", F.lit("")).alias("hits"), F.coalesce("n", F.lit(0).cast("long")).alias("n_backlinks"))


def stub_links(stubs: DataFrame, pages: DataFrame) -> DataFrame:
    """title, existing, missing (links of a stub to pages there are and there aren't, sorted, joined): categories left out."""
    each = wikilinks(stubs).filter("not is_category").select(F.col("source").alias("title"), "target").join(pages.select(F.col("title").alias("target"), F.lit(True).alias("there")), "target", "left")
    pick = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("target")))), "; ")
    return each.groupBy("title").agg(pick(F.col("there")).alias("existing"), pick(F.col("there").isNull()).alias("missing"))


def stub_templates(stubs: DataFrame) -> DataFrame:
    """title, template, keys: all arguments that a stub gives a template, over its calls."""
    each = template_calls(stubs).select(F.col("page").alias("title"), "template", F.explode_outer("keys").alias("key"))
    return each.groupBy("title", "template").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))


def comparable_headings(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """query, ord, place, heading: level-2 headings of pages (title, text) that are asked for (query, ord, title), in order."""
    heads = sections(pages.join(asked.select("title").distinct(), "title", "left_semi")).filter("level = 2 and heading is not null")
    return asked.join(heads.select("title", "place", "heading"), "title").select("query", "ord", "place", "heading")


def local_state(asked: DataFrame) -> DataFrame:
    """asked (query, exists, is_redirect, words, n_backlinks) with state: missing or wanted, redirect, stub or article."""
    state = F.when(~F.col("exists") & (F.col("n_backlinks") > 0), "wanted").when(~F.col("exists"), "missing").when(F.col("is_redirect"), "redirect").when(F.col("words") < 150, "stub").otherwise("article")
    return asked.withColumn("state", state)


def push_plan(changes: DataFrame, delete: bool = False) -> DataFrame:
    """ord, key, path, action, reason: what a push would do with changes (key, change, path, conflict): creations first, then
    edits, then deletions, which rest unless asked for; conflicts are skipped."""
    order = F.when(F.col("change") == "new", 0).when(F.col("change") == "modified", 1).otherwise(2)
    barred = (F.col("change") == "deleted") & F.lit(not delete)
    action = F.when(F.col("conflict") | barred, "skip").when(F.col("change") == "new", "create").when(F.col("change") == "modified", "edit").otherwise("delete")
    reason = F.when(F.col("conflict"), "conflict").when(barred, "deletions not asked for").otherwise("")
    return changes.select(order.alias("ord"), "key", "path", action.alias("action"), reason.alias("reason"))


def latest_items(records: DataFrame) -> DataFrame:
    """The last record (id, at, status, ...) of each item: records are only ever appended."""
    rest = [c for c in records.columns if c not in ("id", "at")]
    return records.groupBy("id").agg(F.max(F.struct("at", *rest)).alias("r")).select("id", "r.*")


def ledger_audit(briefs: DataFrame, items: DataFrame, needed: list[str]) -> DataFrame:
    """status, briefs, open_items: briefs (brief, and columns that must be filled) are complete or incomplete; items (brief,
    status) count while they are open."""
    filled = F.lit(True)
    for c in needed:
        filled = filled & (F.coalesce(F.trim(c), F.lit("")) != "")
    n = items.filter("status = 'open'").groupBy("brief").agg(F.count("*").alias("n"))
    told = briefs.withColumn("status", F.when(filled, "complete").otherwise("incomplete")).select("brief", "status").join(n, "brief", "left")
    return told.groupBy("status").agg(F.count("*").alias("briefs"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("open_items"))


def token_totals(parts: dict[str, DataFrame], most: int) -> DataFrame:
    """part, rows, tokens, kept_tokens: of each part (query, rank, tokens) of a pack, and of what stays when lists are cut to `most`."""
    out = None
    for name, rows in parts.items():
        one = rows.groupBy("query").agg(F.count("*").alias("rows"), F.sum("tokens").cast("long").alias("tokens"), F.coalesce(F.sum(F.when(F.col("rank") <= most, F.col("tokens"))), F.lit(0)).cast("long").alias("kept_tokens")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def best_headings(headings: DataFrame, most: int) -> DataFrame:
    """query, heading, n: headings that most of a query's comparable pages have."""
    n = headings.groupBy("query", F.lower("heading").alias("heading")).agg(F.count_distinct("ord").alias("n"))
    return first_per_group(n, ["query"], [F.desc("n"), F.asc("heading")], most).drop("place")
