"""The contract index: templates and modules as nodes, what implements what as edges, plans of what an author should see."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.functions.text import ascii_lower, normal_spaces, token_estimate
from wikiloom.operators.links import first_per_group
from wikiloom.operators.search import containing

# What a term adds in the first field that holds it, and why.
FIELDS = {"title": ("title_match", 150), "category": ("category_match", 90), "summary": ("summary_match", 70), "parameters": ("parameter_match", 48), "functions": ("function_match", 48), "terms": ("term_profile_match", 24)}
# Lanes with the kind of contract that they hold and what they add, and what they give where nothing else is found.
LANES = {"stub_template": ("template", 520), "comparable_template": ("template", 260), "baseline_template": ("template", 80), "module_pattern": ("module", 220)}
FALLBACK = {"comparable_template": ("pack_template", 120), "baseline_template": ("pack_template", 120), "module_pattern": ("pack_module", 110)}
MOST_USE = 60
# How many parameters, functions, modules and examples a node shows by purpose.
VIEWS = {"index": (16, 12, 8, 0), "author": (32, 20, 12, 6), "implementation": (64, 40, 24, 10)}
SUMMARY_CHARS = 420
_LIST = "array<string>"


def contract_title(c: Column) -> Column:
    return normal_spaces(F.translate(c, "_", " "))


def contract_key(kind: str, title: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), contract_title(title))


def _words(*parts: Column) -> Column:
    """Texts and lists as one text."""
    return normal_spaces(F.concat_ws(" ", *parts))


def _first(rows: DataFrame, key: str, value: str, most: int, name: str) -> DataFrame:
    """key and its first `most` distinct values in order; ranked before they are gathered, so a row holds no more."""
    ranked = first_per_group(rows.select(key, value).distinct(), [key], [F.asc(value)], most)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))


def edges(catalog: DataFrame) -> DataFrame:
    """source, source_title, target, target_title, relation: each template (title, modules) with each module that implements it."""
    each = catalog.select("title", F.explode("modules").alias("m")).withColumn("module", contract_title(F.col("m"))).filter("module <> ''")
    return each.select(
        contract_key("template", F.col("title")).alias("source"), F.col("title").alias("source_title"), contract_key("module", F.col("module")).alias("target"), F.col("module").alias("target_title"), F.lit("implemented_by").alias("relation")
    ).distinct()


def nodes(catalog: DataFrame, module_uses: DataFrame, most: int = 12) -> DataFrame:
    """contract, kind, title, category, summary, uses, pages, parameters, functions, modules, examples, terms.

    catalog: title, category, summary, uses, pages, parameters, modules, examples, more (aliases, documentation, tags).
    module_uses: page, module, function, a row per call. Modules are those that templates name; titles of pages and templates
    beside a module are its first `most`, its counts are over all.
    """
    plain = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: ascii_lower(normal_spaces(F.translate(x, "_", " ")))), lambda x: x != "")))
    t = catalog.select(
        contract_key("template", F.col("title")).alias("contract"), F.lit("template").alias("kind"), "title", "category", F.coalesce("summary", F.lit("")).alias("summary"), F.col("uses").cast("long").alias("uses"), F.col("pages").cast("long").alias("pages"),
        plain(F.col("parameters")).alias("parameters"), F.array().cast(_LIST).alias("functions"), "modules", "examples", "more",
    )
    t = t.withColumn("terms", _words(F.col("title"), F.col("category"), F.col("summary"), F.col("more"), F.col("modules"), F.col("parameters"), F.col("examples"))).drop("more")
    named = edges(catalog).select(F.col("target_title").alias("title"), F.col("source_title").alias("template"))
    calls = module_uses.select(contract_title(F.col("module")).alias("module"), "function", "page").withColumn("at", ascii_lower(F.col("module")))
    used = calls.groupBy("at").agg(F.count("*").alias("uses"), F.count_distinct("page").alias("pages"), F.array_sort(F.collect_set("function")).alias("functions"))
    m = named.select("title").distinct().withColumn("at", ascii_lower(F.col("title"))).join(used, "at", "left").join(_first(calls, "at", "page", most, "examples"), "at", "left").join(_first(named, "title", "template", most, "templates"), "title", "left")
    none = F.array().cast(_LIST)
    lists = {c: F.coalesce(F.col(c), none) for c in ("functions", "examples", "templates")}
    m = m.withColumns(lists).select(
        contract_key("module", F.col("title")).alias("contract"), F.lit("module").alias("kind"), "title", F.lit("module").alias("category"), F.lit("").alias("summary"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("pages", F.lit(0)).alias("pages"),
        none.alias("parameters"), "functions", none.alias("modules"), "examples", _words(F.col("title"), F.col("functions"), F.col("examples"), F.col("templates")).alias("terms"),
    )
    return t.unionByName(m)


def view(index: DataFrame, purpose: str = "author") -> DataFrame:
    """The nodes as they are shown: lists and summary cut for the purpose, and tokens, what that costs."""
    cut = {c: F.slice(c, 1, n) for c, n in zip(("parameters", "functions", "modules", "examples"), VIEWS[purpose], strict=True)}
    shown = index.withColumns(cut).withColumn("summary", F.left(normal_spaces(F.col("summary")), F.lit(SUMMARY_CHARS)))
    parts = [F.col(c) for c in ("title", "category", "summary")] + [F.array_join(c, " ") for c in ("parameters", "functions", "modules", "examples")]
    return shown.withColumn("tokens", F.greatest(token_estimate(F.concat_ws(" ", *parts)), F.lit(1)).cast("long"))


def candidates(terms: DataFrame, lanes: DataFrame, index: DataFrame) -> DataFrame:
    """query, contract, score, uses, reasons (name and weight, by weight), matched (terms).

    terms: query, term. lanes: query, lane, title, uses. A term counts once in a contract, in the first of FIELDS that holds
    it; a lane once, where the contract is of its kind; use adds up to MOST_USE. Queries that nothing scores get what
    their lanes name, whether the index has it or not.
    """
    asked = terms.select("query", ascii_lower(normal_spaces(F.col("term"))).alias("term")).filter("term <> ''").distinct()
    low = index.select("contract", *(ascii_lower(F.array_join(c, " ") if c in ("parameters", "functions") else F.col(c)).alias(c) for c in FIELDS))
    near = containing(low, F.concat_ws("\n", *FIELDS), asked, F.col("term"))
    hit = F.coalesce(*(F.when(F.contains(f, F.col("term")), F.struct(F.lit(name).alias("reason"), F.lit(weight).alias("weight"))) for f, (name, weight) in FIELDS.items()))
    by_text = near.select("query", "contract", hit.alias("hit"), "term").filter("hit is not null").select("query", "contract", "hit.*", "term").distinct()
    weights = F.create_map(*(F.lit(x) for lane, (_, w) in LANES.items() for x in (lane, w)))
    kinds = F.create_map(*(F.lit(x) for lane, (kind, _) in LANES.items() for x in (lane, kind)))
    told = lanes.withColumn("contract", F.concat(F.try_element_at(kinds, F.col("lane")), F.lit(":"), contract_title(F.col("title"))))
    by_lane = told.select("query", "contract", F.col("lane").alias("reason"), F.try_element_at(weights, F.col("lane")).alias("weight"), F.lit(None).cast("string").alias("term")).distinct()
    scored = by_text.unionByName(by_lane.join(index.select("contract"), "contract", "left_semi").select(*by_text.columns))
    summed = scored.groupBy("query", "contract").agg(
        F.sum("weight").alias("score"), F.collect_list(F.struct((-F.col("weight")).alias("down"), "reason")).alias("why"), F.array_sort(F.collect_set("term")).alias("matched")
    )
    found = summed.join(index.select("contract", "uses"), "contract")
    gives = F.create_map(*(F.lit(x) for lane, (_, w) in FALLBACK.items() for x in (lane, w)))
    name = F.create_map(*(F.lit(x) for lane, (n, _) in FALLBACK.items() for x in (lane, n)))
    rest = told.filter(F.col("lane").isin(*FALLBACK)).join(found.select("query").distinct(), "query", "left_anti")
    rest = rest.groupBy("query", "contract").agg(F.max(F.struct(F.try_element_at(gives, F.col("lane")).alias("weight"), F.try_element_at(name, F.col("lane")).alias("reason"))).alias("best"), F.max("uses").cast("long").alias("uses"))
    rest = rest.select("query", "contract", F.col("best.weight").cast("long").alias("score"), "uses", F.array(F.struct((-F.col("best.weight")).alias("down"), "best.reason")).alias("why"), F.array().cast(_LIST).alias("matched"))
    both = found.select("query", "contract", "score", "uses", "why", "matched").unionByName(rest)
    reasons = F.transform(F.array_sort("why"), lambda x: F.concat(x.reason, F.lit(":"), (-x.down).cast("string")))
    return both.select("query", "contract", (F.col("score") + F.least(F.coalesce("uses", F.lit(0)), F.lit(MOST_USE))).cast("long").alias("score"), F.coalesce("uses", F.lit(0)).alias("uses"), reasons.alias("reasons"), "matched")


def plan(found: DataFrame, shown: DataFrame, limit: int = 16, budget: int = 900, most: int = 4096) -> DataFrame:
    """query, place, contract, score, tokens, chosen, reason: a query's best `most` candidates in order of score, use and name.

    Each is chosen until `limit` are; one that would pass the budget is left out and the next tried, but the first always
    stays. Contracts that the index doesn't have cost the tokens of their names.
    """
    best = first_per_group(found, ["query"], [F.desc("score"), F.desc("uses"), F.asc("contract")], most).join(shown.select("contract", F.col("tokens").alias("cost")), "contract", "left")
    title = F.regexp_replace("contract", r"\A[a-z]+:", "")
    best = best.select("query", "place", "contract", "score", F.coalesce("cost", F.greatest(token_estimate(title), F.lit(1))).cast("long").alias("tokens"))

    def take(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        used, n, chosen, reason = 0, 0, [], []
        for tokens in g["tokens"].tolist():
            fits = n < limit and (n == 0 or used + tokens <= budget)
            chosen.append(fits)
            reason.append("" if fits else "limit" if n >= limit else "budget")
            used, n = used + tokens * fits, n + fits
        return g.assign(chosen=chosen, reason=reason)

    kinds = dict(best.dtypes)
    return best.groupBy("query").applyInPandas(take, f"query {kinds['query']}, place int, contract string, score long, tokens long, chosen boolean, reason string")


def touched(planned: DataFrame, linked: DataFrame) -> DataFrame:
    """query, source, target, relation: edges of which either end was chosen."""
    chosen = planned.filter("chosen").select("query", "contract")
    ends = [linked.join(chosen.withColumnRenamed("contract", end), end).select("query", "source", "target", "relation") for end in ("source", "target")]
    return ends[0].unionByName(ends[1]).distinct()


def expanded(planned: DataFrame, linked: DataFrame, hops: int = 2) -> DataFrame:
    """query, contract, hops: what is reached from chosen contracts along edges, either way, within `hops`; by the fewest."""
    reached = planned.filter("chosen").select("query", "contract").distinct().withColumn("hops", F.lit(0))
    both = linked.select("source", "target").unionByName(linked.select(F.col("target").alias("source"), F.col("source").alias("target")))
    for _ in range(hops):
        more = reached.join(both, F.col("contract") == F.col("source")).select("query", F.col("target").alias("contract"), (F.col("hops") + 1).alias("hops"))
        reached = reached.unionByName(more).groupBy("query", "contract").agg(F.min("hops").alias("hops"))
    return reached


def report(terms: DataFrame, found: DataFrame, planned: DataFrame, linked: DataFrame) -> DataFrame:
    """query, chosen, omitted, tokens, edges, matched, missing (terms that no chosen contract holds), warning."""
    asked = terms.select("query", ascii_lower(normal_spaces(F.col("term"))).alias("term")).filter("term <> ''").distinct()
    held = planned.filter("chosen").join(found.select("query", "contract", F.explode("matched").alias("term")), ["query", "contract"]).select("query", "term").distinct().withColumn("have", F.lit(True))
    by_term = asked.join(held, ["query", "term"], "left").groupBy("query").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("have"), F.col("term")))), ",").alias("matched"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("have").isNull(), F.col("term")))), ",").alias("missing")
    )
    sums = planned.groupBy("query").agg(F.count_if("chosen").alias("chosen"), F.count_if(~F.col("chosen")).alias("omitted"), F.sum(F.when(F.col("chosen"), F.col("tokens"))).alias("tokens"))
    met = touched(planned, linked).groupBy("query").agg(F.count("*").alias("edges"))
    told = terms.select("query").distinct()
    for side in (by_term, sums, met):
        told = told.join(side, "query", "left")
    zero = F.lit(0).cast("long")
    told = told.select("query", *(F.coalesce(c, zero).alias(c) for c in ("chosen", "omitted", "tokens", "edges")), *(F.coalesce(c, F.lit("")).alias(c) for c in ("matched", "missing")))
    return told.withColumn("warning", F.when(F.col("chosen") == 0, "nothing matched").when(F.col("missing") != "", "terms missing").when(F.col("omitted") > 0, "contracts omitted").otherwise(""))
