"""Retrieval of passages for many queries at once: rank decay, reranking, interleaving, selection under a token budget."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.functions.text import ascii_lower, has_words, is_noise, leading_prose, lexical_terms, low_signal, normal_spaces, query_terms, summary, token_estimate, variant_language, words
from wikiloom.operators.search import identifier_search, ranked, tokens, top
from wikiloom.staging import small, staged

# Base, step and floor of page weights by lane, and by how much base and floor fall for each further term.
LANES = {"profile": (220, 18, 40, 14, 20), "authority": (200, 16, 36, 12, 18), "identifier": (240, 20, 48, 16, 24)}
# Score of a passage by where the query stands.
TITLE_EXACT, TITLE_PART, HEADING, TEXT = 220, 140, 90, 120
TERM_FIRST, TERM_STEP, TERM_LEAST, COVERAGE, ALL_TERMS = 36, 4, 8, 28, 60
#: Candidates of a query, and the similarity from which a passage says what a chosen one says.
CANDIDATES, SAME = 512, 0.86


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 96) -> DataFrame:
    """row, place, text, tokens: paragraphs (parted by empty lines) packed greedily to `size` words, longer ones cut.

    A fold over a text's paragraphs keeps the open chunk; nothing leaves the row.
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), r"(?:\r?\n[ \t]*){2,}"), words), lambda p: F.size(p) > 0)
    # long paragraphs first become pieces of `size` words, short ones stay whole
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda k: F.struct(F.slice(p, k * size + 1, F.lit(size)).alias("w"), (F.size(p) > size).alias("cut")))))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(s, p):
        full = (F.size(s.open) > 0) & ((F.size(s.open) + F.size(p.w) > size) | p.cut)
        done = F.when(full, F.array_append(s.done, s.open)).otherwise(s.done)
        kept = F.when(full, F.array().cast("array<string>")).otherwise(s.open)
        return F.struct(F.when(p.cut, F.array_append(done, p.w)).otherwise(done).alias("done"), F.when(p.cut, F.array().cast("array<string>")).otherwise(F.concat(kept, p.w)).alias("open"))

    folded = F.aggregate(pieces, start, step, lambda s: F.when(F.size(s.open) > 0, F.array_append(s.done, s.open)).otherwise(s.done))
    each = docs.select(F.col(id_col).alias("row"), F.posexplode_outer(folded).alias("place", "w")).filter("w is not null")
    text = F.array_join("w", " ")
    return each.select("row", "place", text.alias("text"), token_estimate(text).alias("tokens"))


def decayed(hits: DataFrame, lane: str) -> DataFrame:
    """query, page, weight: of hits (query, term_no, page, rank from 0), summed over a query's terms."""
    base, step, floor, base_fall, floor_fall = LANES[lane]
    high, low = F.lit(base) - F.col("term_no") * base_fall, F.greatest(F.lit(floor) - F.col("term_no") * floor_fall, F.lit(1))
    return hits.select("query", "page", F.greatest(high - F.col("rank") * step, low).cast("long").alias("weight")).groupBy("query", "page").agg(F.sum("weight").alias("weight"))


def reranked(candidates: DataFrame, queries: DataFrame, terms: DataFrame, weights: DataFrame) -> DataFrame:
    """candidates (query, page, place, title, heading, text, tokens) with a score; equal passages count once.

    queries (query, text) and terms (query, term, ord) are broadcast where they are small; weights (query, page, weight) are joined.
    """
    once = candidates.dropDuplicates(["query", "title", "heading", "text"])
    q, t, h, x = (ascii_lower(F.col(c)) for c in ("q", "title", "heading", "text"))
    asked = once.join(small(queries.select("query", F.col("text").alias("q"))), "query")
    fixed = F.when(t == q, TITLE_EXACT).when(F.contains(t, q), TITLE_PART).otherwise(0) + F.coalesce(F.when(F.contains(h, q), HEADING), F.lit(0)) + F.when(F.contains(x, q), TEXT).otherwise(0)
    # the terms of a query are few: one array per query instead of a row per term and passage
    lists = terms.groupBy("query").agg(F.array_sort(F.collect_set(F.struct("ord", F.col("term").alias("t")))).alias("terms"))
    told = asked.withColumn("fixed", fixed).join(small(lists), "query", "left")
    all_text = F.concat_ws(" ", t, h, x)
    hit = F.filter("terms", lambda z: F.contains(F.col("all_text"), ascii_lower(z.t)))
    told = told.withColumn("all_text", all_text).withColumn("hit", F.coalesce(hit, F.array().cast("array<struct<ord:int,t:string>>")))
    by_term = F.aggregate("hit", F.lit(0).cast("long"), lambda s, z: s + F.greatest(F.lit(TERM_FIRST) - TERM_STEP * z.ord, F.lit(TERM_LEAST)) + COVERAGE)
    whole = F.when((F.size("terms") > 0) & (F.size("hit") == F.size("terms")), ALL_TERMS).otherwise(0)
    brevity = F.when(F.col("tokens") <= 48, 12).when(F.col("tokens") <= 96, 6).otherwise(0)
    scored = told.join(weights, ["query", "page"], "left").withColumn("score", (F.col("fixed") + by_term + whole + brevity + F.coalesce("weight", F.lit(0))).cast("long"))
    return scored.select("query", "page", "place", "title", "heading", "text", "tokens", "score")


def interleaved(scored: DataFrame, max_pages: int, most: int = CANDIDATES) -> DataFrame:
    """The best `most` passages of each query in turn by page: the first of each page, then the second of each; with `turn`.

    Pages come in the order of their best passage, `max_pages` at most.
    """
    order = [F.desc("score"), F.asc("title"), F.asc_nulls_first("heading"), F.asc("text"), F.asc("place")]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= most)
    paged = ranked.withColumn("within", F.row_number().over(Window.partitionBy("query", "page").orderBy("rank"))).withColumn("first", F.min("rank").over(Window.partitionBy("query", "page")))
    numbered = paged.withColumn("page_no", F.dense_rank().over(Window.partitionBy("query").orderBy("first"))).filter(F.col("page_no") <= max_pages)
    return numbered.withColumn("turn", F.row_number().over(Window.partitionBy("query").orderBy("within", "page_no"))).drop("within", "first", "page_no")


def selected(ordered: DataFrame, limit: int, budget: int, per_page: int, same: float = SAME) -> DataFrame:
    """query, page, place, score, tokens, chosen (from 1): greedily in the order of `turn`.

    A passage is skipped when its page has enough, it says what a chosen one says, or it doesn't fit the budget; the
    first is always taken. Each query's passages (CANDIDATES at most) are one group; queries are spread over tasks.
    """
    rows = ordered.select("query", "page", "place", "score", "tokens", "turn", lexical_terms(F.col("text")).alias("terms"))

    def choose(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups:
            pages: dict = {}
            taken, kept, used = [], [], 0
            for r in g.sort_values("turn").itertuples(index=False):
                terms = set(r.terms)
                if len(taken) >= limit:
                    break
                if pages.get(r.page, 0) >= per_page or (taken and used + r.tokens > budget):
                    continue
                if any(terms == k or (terms and k and len(terms & k) / len(terms | k) >= same) for k in kept):
                    continue
                taken.append((r.query, r.page, r.place, r.score, r.tokens, len(taken) + 1))
                kept.append(terms)
                used += r.tokens
                pages[r.page] = pages.get(r.page, 0) + 1
            yield pd.DataFrame(taken, columns=["query", "page", "place", "score", "tokens", "chosen"])

    kinds = dict(rows.dtypes)
    return rows.groupBy("query").applyInPandas(lambda g: next(choose(iter([g]))), f"query {kinds['query']}, page {kinds['page']}, place {kinds['place']}, score long, tokens long, chosen int")


def for_audience(passages: DataFrame, authoring: bool = True) -> DataFrame:
    """passages (title, namespace, heading, text, tokens, ...) fit to be shown: prose of articles that are no translations, under
    headings that hold prose. For authoring, what passages begin with (calls, files, categories) is cut away."""
    kept = passages.filter((F.col("namespace") == "Main") & variant_language(F.col("title")).isNull() & ~is_noise(F.col("text")) & ~low_signal(F.col("heading")))
    if not authoring:
        return kept
    low = ascii_lower(F.col("text"))
    kept = kept.filter(~low.contains("{{reflist") & ~low.startswith("[[category:") & ~low.startswith("{{see also|"))
    # a filter on what a generator makes isn't pushed below it, so the prose is cut once
    prose = kept.withColumn("prose", F.explode_outer(F.array(leading_prose(F.col("text"))))).filter(has_words(F.col("prose"), 5))
    return prose.withColumn("text", F.col("prose")).drop("prose").withColumn("tokens", token_estimate(F.col("text")))


def page_profiles(pages: DataFrame, lists: list[DataFrame]) -> DataFrame:
    """page, text: what a page (page, title, summary) is about: title, summary and the terms of lists (page, term), each once
    whatever its case, with what stands behind a colon as a term of its own."""
    own = pages.select("page", F.explode(F.array("title", "summary")).alias("term"))
    for rows in lists:
        own = own.unionByName(rows.select("page", "term"))
    after = F.when(F.col("term").contains(":"), F.regexp_replace("term", r"\A[^:]*:", ""))
    terms = own.select("page", F.explode(F.array("term", after)).alias("term")).select("page", normal_spaces(F.col("term")).alias("term")).filter("term <> ''")
    once = terms.groupBy("page", ascii_lower(F.col("term")).alias("key")).agg(F.min("term").alias("term"))
    return once.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("term")), "\n").alias("text"))


def template_scores(wanted: DataFrame, invocations: DataFrame) -> DataFrame:
    """query, page, score: pages by the templates (query, template, keys) that they also call (template, page, keys), more
    for arguments in common."""
    both = F.size(F.array_intersect("want", "keys"))
    told = invocations.join(small(wanted.select("query", "template", F.col("keys").alias("want"))), "template")
    score = F.lit(72) + 18 * both + F.when((F.size("want") > 0) & (both >= F.least(F.size("want"), F.lit(3))), 24).otherwise(0)
    return told.groupBy("query", "page").agg(F.sum(score).cast("long").alias("score"))


def related_weights(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """query, page, weight: weights (query, page, weight) held within 1 and 240; seeds (query, page) that have none get 160."""
    bounded = found.select("query", "page", F.least(F.greatest("weight", F.lit(1)), F.lit(240)).cast("long").alias("weight"))
    return bounded.unionByName(seeds.select("query", "page").distinct().join(bounded, ["query", "page"], "left_anti").withColumn("weight", F.lit(160).cast("long")))


def _lane(terms: DataFrame, rows: DataFrame, lane: str, most: int) -> DataFrame:
    """query, page, weight: for each term of a query the best pages by BM25 over rows (page, text), decayed by rank."""
    asked = terms.select(F.struct("query", "term_no").alias("query"), F.explode(F.array_distinct(tokens(F.col("term")))).alias("term"))
    best = ranked(asked, rows, "page", {"text": 1.0}, most)
    return decayed(best.select("query.query", "query.term_no", F.col("row").alias("page"), (F.col("rank") - 1).alias("rank")), lane)


def related_pages(queries: DataFrame, profiles: DataFrame | None, authorities: DataFrame | None, identifiers: DataFrame | None, most: int = 12) -> DataFrame:
    """query, page, weight: pages that a query (query, text), or one of the terms it is expanded to, leads to by their profiles
    (page, text), the authorities that they cite (page, text) and their identifiers (page, value)."""
    terms = queries.select("query", F.posexplode(query_terms(F.col("text"))).alias("term_no", "term"))
    lanes = []
    if profiles is not None:
        lanes.append(_lane(terms, profiles, "profile", most))
    if authorities is not None:
        lanes.append(_lane(terms, authorities.groupBy("page").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text")), "authority", most))
    if identifiers is not None:
        asked = terms.select(F.struct("query", "term_no").alias("query"), F.col("term").alias("text"))
        hits = identifier_search(asked, identifiers, most)
        lanes.append(decayed(hits.select("query.query", "query.term_no", "page", (F.col("rank") - 1).alias("rank")), "identifier"))
    every = reduce(DataFrame.unionByName, lanes)
    summed = every.groupBy("query", "page").agg(F.sum("weight").cast("long").alias("weight"))
    return top(summed.withColumnRenamed("weight", "score"), most, tie="page").select("query", "page", F.col("score").alias("weight"))


def retrieve(
    queries: DataFrame, passages: DataFrame, profiles: DataFrame | None = None, authorities: DataFrame | None = None, identifiers: DataFrame | None = None,
    limit: int = 6, budget: int = 400, max_pages: int = 4, per_page: int = 2, per_query: int = 40, authoring: bool = True,
) -> DataFrame:
    """Passages for each query (query, text) across pages (page, title, namespace, heading, place, text, tokens), within a budget.

    BM25 over the passages gives candidates, for the query and each term it is expanded to; pages related by profile,
    authority or identifier get weights, and their first two passages join the candidates. What isn't fit to be shown goes;
    the rest is reranked, interleaved by page and chosen. Passages and their postings are made once.
    """
    held = staged(for_audience(passages, authoring), "passages")
    terms = queries.select("query", F.posexplode(query_terms(F.col("text"))).alias("term_no", "term"))
    asked = terms.select(F.struct("query", "term_no").alias("query"), F.explode(F.array_distinct(tokens(F.col("term")))).alias("term"))
    scored = ranked(asked, held.withColumn("key", F.struct("page", "place")), "key", {"text": 1.0}, per_query)
    found = scored.select("query.query", F.col("row.page").alias("page"), F.col("row.place").alias("place")).distinct()
    if profiles is None and authorities is None and identifiers is None:
        profiles = held.groupBy("page").agg(F.min_by(summary(F.col("text")), "place").alias("text"))
    weights = staged(related_pages(queries, profiles, authorities, identifiers), "weights")
    # related pages and wanted passages are bounded by the queries; where they are few, the passages stay where they lie
    near = held.select("page", "place").join(small(weights.select("page").distinct()), "page")
    first = near.withColumn("nth", F.row_number().over(Window.partitionBy("page").orderBy("place"))).filter("nth <= 2")
    seeds = weights.select("query", "page").join(first.select("page", "place"), "page")
    wanted = staged(found.unionByName(seeds.select("query", "page", "place")).distinct(), "wanted")
    told = held.join(small(wanted), ["page", "place"])
    ords = terms.select("query", F.col("term_no").alias("ord"), "term")
    return selected(interleaved(reranked(told, queries, ords, weights), max_pages), limit, budget, per_page)
