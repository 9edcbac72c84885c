"""Rules that guides state in Markdown, as a table, and what they meet in articles: by exact name, by word, by part of a domain."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.functions.text import ascii_lower, normal_spaces
from wikiloom.operators.links import first_per_group
from wikiloom.staging import small

# Headings and lines under which guides keep their rules.
INFOBOXES = "## 6. Infobox selection"
UNRELIABLE = ["### Never cite:", "## VI. Unreliable sources"]
BANNED = "**Never use:**"
WATCHED = "**Watch list — use sparingly or not at all:**"
PLACEHOLDERS = ["### No placeholder content", "### No system artifacts"]
# What a guide says in so many words, and the setting that it makes.
SETTINGS = {
    "short_description": ["{{SHORTDESC:"], "article_quality_banner": ["{{Article quality|unverified}}"], "references_section": ["== References =="], "references_template": ["{{Reflist}}"],
    "sentence_case": ["Sentence case"], "wikitext_only": ["raw MediaWiki wikitext"], "forbid_markdown": ["Never output Markdown"], "straight_quotes": ["Straight quotes only"],
    "blank_archives": ["archive fields blank", "Leave ALL archive fields blank"],
}


def guide_lines(guides: DataFrame) -> DataFrame:
    """doc, line, text (trimmed), raw, section (the last line that begins with #), banned (below BANNED, up to the next ###),
    watched (below WATCHED, up to the next #), fenced (within ``` or such a line)."""
    each = guides.select("doc", F.posexplode(F.split("text", r"\r\n|\n")).alias("at", "raw")).select("doc", (F.col("at") + 1).alias("line"), "raw", F.trim("raw").alias("text"))
    w = Window.partitionBy("doc").orderBy("line")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    fence = F.startswith("text", F.lit("```"))
    each = each.withColumn("fenced", fence | (F.coalesce(F.count_if(fence).over(before), F.lit(0)) % 2 == 1))
    last = lambda test, value=None: F.last(F.when(test, F.col("text") if value is None else value), True).over(upto)
    heading = F.startswith("text", F.lit("#"))
    mark = lambda name, ends: F.coalesce(last((F.col("text") == name) | ends, F.col("text") == name), F.lit(False))
    return each.select("doc", "line", "raw", "text", "fenced", last(heading).alias("section"), mark(BANNED, F.startswith("text", F.lit("### "))).alias("banned"), mark(WATCHED, heading).alias("watched"))


def guide_rules(guides: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """doc, kind, key, value, line: each rule once a guide (by kind and key, in either case), where it first stands; of `kinds`
    alone, if given.

    citation_template: family, template. infobox: kind of subject, template. unreliable_source: what to look for (within
    parentheses, else the words before the dash), label. banned_phrase, watch_term, placeholder: the words. setting: its name.
    """
    rows = guide_lines(guides)
    item = F.startswith("text", F.lit("- "))
    own = normal_spaces(F.regexp_replace("text", "^(- )+", ""))
    label = normal_spaces(F.substring_index(own, "—", 1))
    inner = F.regexp_extract(own, r"\(([^)]*)\)", 1)
    name = normal_spaces(F.translate(F.regexp_extract("text", r"\A\{\{(Cite [^|]*)\|", 1), "_", " "))
    cells = F.split(F.regexp_replace("text", r"\A\|+|\|+\z", ""), r"\|")
    titled = normal_spaces(F.translate(F.regexp_extract(F.get(cells, 1), r"\{\{(.*?)\}\}", 1), "_", " "))
    template = F.when(titled.startswith("Template:"), titled).otherwise(F.concat(F.lit("Template:"), titled))
    subject = normal_spaces(F.regexp_replace(F.get(cells, 0), r"\A`+|`+\z", ""))

    def told(test: Column, kind: str, key: Column, value: Column, of: DataFrame = rows) -> DataFrame:
        return of.filter(test).select("doc", F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"), "line")

    words = lambda pattern: rows.withColumn("word", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).withColumn("word", normal_spaces(F.col("word")))
    terms = rows.filter(F.col("watched") & item).withColumn("word", F.explode(F.split(own, ","))).withColumn("word", normal_spaces(F.col("word")))
    word = F.col("word")
    parts = {
        "citation_template": lambda kind: [told(name != "", kind, ascii_lower(F.regexp_replace(name, r"\ACite ", "")), F.concat(F.lit("Template:"), name))],
        "infobox": lambda kind: [told((F.col("section") == INFOBOXES) & F.startswith("text", F.lit("|")) & ~F.contains("text", F.lit("Subject type")) & ~subject.startswith("---") & (titled != ""), kind, subject, template)],
        "unreliable_source": lambda kind: [told(F.col("section").isin(UNRELIABLE) & item & (label != ""), kind, F.when(inner != "", normal_spaces(inner)).otherwise(ascii_lower(label)), label)],
        "banned_phrase": lambda kind: [told(F.col("banned") & item & (word != ""), kind, word, word, words(r'"([^"]*)"'))],
        "watch_term": lambda kind: [told(word != "", kind, word, word, terms)],
        "placeholder": lambda kind: [told(F.col("section").isin(PLACEHOLDERS) & (word != ""), kind, word, word, words("`([^`]*)`"))],
        "setting": lambda kind: [told(reduce(or_, (F.contains("raw", F.lit(s)) for s in signs)), kind, F.lit(setting), F.lit("true")) for setting, signs in SETTINGS.items()],
    }
    every = reduce(DataFrame.unionByName, (p for kind, made in parts.items() if kinds is None or kind in kinds for p in made(kind)))
    first = every.groupBy("doc", "kind", ascii_lower(F.col("key")).alias("k")).agg(F.min(F.struct("line", "key", "value")).alias("x"))
    return first.select("doc", "kind", "x.key", "x.value", "x.line")


def extension_contracts(guides: DataFrame) -> DataFrame:
    """doc, line, kind, name, provider, syntax, body_required, attributes, example: lines `Contract: key=value; ...` outside
    fences, each with the fenced block that follows it before the next contract or ## heading; without kind or name none."""
    rows = guide_lines(guides)
    w = Window.partitionBy("doc").orderBy("line")
    starts = ~F.col("fenced") & F.startswith("text", F.lit("Contract:"))
    ends = starts | (~F.col("fenced") & F.startswith("text", F.lit("## ")))
    fence = F.startswith("text", F.lit("```"))
    rows = rows.withColumns({"starts": starts, "group": F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "fences": F.count_if(fence).over(w.rowsBetween(Window.unboundedPreceding, 0)), "fence": fence})
    at = Window.partitionBy("doc", "group")
    rows = rows.withColumns({"heads": F.max("starts").over(at), "opened": F.min(F.when(F.col("fence"), F.col("fences"))).over(at)})
    block = rows.filter(F.col("heads") & F.col("fenced") & ~F.col("fence") & (F.col("fences") == F.col("opened")))
    # the lines of a guide's own block
    body = block.groupBy("doc", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x.raw), "\n").alias("example"))
    pairs = F.split(F.regexp_replace("text", r"\AContract:", ""), ";")
    value = lambda key: F.trim(F.regexp_replace(F.coalesce(F.get(F.filter(pairs, lambda p: F.trim(F.substring_index(p, "=", 1)) == key), -1 + F.size(F.filter(pairs, lambda p: F.trim(F.substring_index(p, "=", 1)) == key))), F.lit("")), r"\A[^=]*=", ""))
    said = rows.filter("starts").select("doc", "group", "line", *(value(k).alias(k) for k in ("kind", "name", "provider", "syntax")), (value("body") == "required").alias("body_required"), F.filter(F.transform(F.split(value("attributes"), ","), lambda x: F.trim(x)), lambda x: x != "").alias("attributes"))
    told = said.filter("kind <> '' and name <> ''").join(body, ["doc", "group"], "left")
    return told.select("doc", "line", "kind", "name", "provider", "syntax", "body_required", "attributes", F.coalesce(F.regexp_replace("example", r"\s+\z", ""), F.lit("")).alias("example"))


def _tokens(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+"), "")


def phrase_uses(texts: DataFrame, rules: DataFrame, kinds: tuple[str, ...] = ("banned_phrase", "watch_term", "placeholder")) -> DataFrame:
    """title, kind, key, n: how often a text (title, text) holds the words of a rule, in their order, in either case.

    Rules are looked up by their first word; what comes so is held against all words. A text's words are dealt out, never
    texts times rules.
    """
    index = rules.filter(F.col("kind").isin(*kinds)).select("kind", "key", _tokens(F.col("key")).alias("asked")).filter("size(asked) > 0").distinct().withColumn("word", F.get("asked", 0))
    held = texts.select("title", _tokens(F.col("text")).alias("have"))
    each = held.select("title", "have", F.posexplode("have").alias("at", "word"))
    return each.join(small(index), "word").filter(F.slice("have", F.col("at") + 1, F.size("asked")) == F.col("asked")).groupBy("title", "kind", "key").agg(F.count("*").alias("n"))


def source_uses(refs: DataFrame, rules: DataFrame) -> DataFrame:
    """page, place, domain, key, label, match: citations (page, place, domain) of unreliable sources: `exact` for the domain
    itself, `below` for what stands below it. A domain meets rules by hash on its endings, of which it has a handful."""
    index = rules.filter("kind = 'unreliable_source'").select(ascii_lower(F.regexp_replace("key", r"\A(?:https?://)?(?:www\.)?", "")).alias("end"), "key", F.col("value").alias("label")).distinct()
    labels = F.split("domain", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = refs.filter("domain <> ''").select("page", "place", "domain", F.explode_outer(ends).alias("end"))  # outer: without an inferred filter, that makes the endings anew
    return each.join(small(index), "end").select("page", "place", "domain", "key", "label", F.when(F.col("end") == F.col("domain"), "exact").otherwise("below").alias("match"))


def template_surface(used: DataFrame, rules: DataFrame, kind: str, most: int = 6) -> DataFrame:
    """template, subject, source, pages, examples: templates in use (page, template) and those that rules of `kind` name.

    source: both, comparables (in use alone) or profile (named alone); subject: the rule's kind of subject or family, the first
    by name; pages is the number of all pages, examples the first `most`. Titles meet in either case of A-Z.
    """
    pages = used.select("page", "template", ascii_lower(F.col("template")).alias("k")).distinct()
    n = pages.groupBy("k").agg(F.count_distinct("page").alias("pages"), F.min("template").alias("t"))
    first = first_per_group(pages.select("k", "page").distinct(), ["k"], [F.asc("page")], most).groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("page")), "; ").alias("examples"))
    named = rules.filter(F.col("kind") == kind).groupBy(ascii_lower(F.col("value")).alias("k")).agg(F.min("value").alias("rule"), F.min("key").alias("subject"))
    told = n.join(first, "k").join(named, "k", "full")
    source = F.when(F.col("t").isNull(), "profile").when(F.col("rule").isNull(), "comparables").otherwise("both")
    return told.select(F.coalesce("t", "rule").alias("template"), "subject", source.alias("source"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("examples", F.lit("")).alias("examples"))


def subject_hints(used: DataFrame, rules: DataFrame, most: int = 6) -> DataFrame:
    """subject, templates, pages, examples: kinds of subjects whose infobox is in use, with the pages that support them."""
    named = rules.filter("kind = 'infobox'").select(F.col("key").alias("subject"), ascii_lower(F.col("value")).alias("k")).distinct()
    met = used.select("page", "template", ascii_lower(F.col("template")).alias("k")).distinct().join(small(named), "k")
    n = met.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set("template")), "; ").alias("templates"), F.count_distinct("page").alias("pages"))
    first = first_per_group(met.select("subject", "page").distinct(), ["subject"], [F.asc("page")], most).groupBy("subject").agg(F.array_join(F.array_sort(F.collect_list("page")), "; ").alias("examples"))
    return n.join(first, "subject").select("subject", "templates", "pages", "examples")
