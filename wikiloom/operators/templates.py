"""Templates and modules as a surface for authors: implementation pages, parameters, exports, usage and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.functions.text import ascii_lower, canonical_title, normal_spaces, parameter_key
from wikiloom.operators.links import first_per_group

# Roles of the pages that make up a template, in the order in which they are shown.
ROLES = ["template", "documentation", "module", "dependency"]

_DATA = "struct<description:string,format:string,params:map<string,struct<description:string,type:string,required:boolean,suggested:boolean,deprecated:string,default:string,aliases:array<string>>>>"


def _block(text: str, tag: str):
    return F.regexp_extract(text, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def template_data(pages: DataFrame, id_col: str = "title", text_col: str = "text") -> DataFrame:
    """template, key, required, suggested, type, default, aliases (sorted): the parameters that a <templatedata> block declares."""
    data = F.from_json(_block(text_col, "templatedata"), _DATA)
    each = pages.select(F.col(id_col).alias("template"), data.alias("d")).select("template", F.explode(F.map_entries("d.params")).alias("p"))
    x = F.col("p.value")
    aliases = F.array_sort(F.array_distinct(F.transform(F.coalesce(x.aliases, F.array().cast("array<string>")), parameter_key)))
    return each.select("template", parameter_key(F.col("p.key")).alias("key"), F.coalesce(x.required, F.lit(False)).alias("required"), F.coalesce(x.suggested, F.lit(False)).alias("suggested"), F.coalesce(x.type, F.lit("")).alias("type"), F.coalesce(x.default, F.lit("")).alias("default"), aliases.alias("aliases"))


def source_parameters(pages: DataFrame, id_col: str = "title", text_col: str = "text") -> DataFrame:
    """template, key: what a template's source reads as {{{key}}}, each once whatever its case."""
    names = F.transform(F.regexp_extract_all(text_col, F.lit(r"\{\{\{([^{}|]+)"), F.lit(1)), parameter_key)
    return pages.select(F.col(id_col).alias("template"), F.explode(F.array_distinct(names)).alias("key")).filter("key <> ''")


def module_references(pages: DataFrame, id_col: str = "title", text_col: str = "text") -> DataFrame:
    """title, module: modules that a page's source names, by #invoke, require or mw.loadData."""
    invoked = F.transform(F.regexp_extract_all(text_col, F.lit(r"(?i)\{\{\s*#invoke:\s*([^|{}]+)"), F.lit(1)), lambda m: F.concat(F.lit("Module:"), normal_spaces(F.regexp_replace(m, r"(?i)\A\s*module:", ""))))
    loaded = F.transform(F.regexp_extract_all(text_col, F.lit(r"""(?i)\b(?:require|loadData|loadJsonData)\s*\(?\s*["'](module:[^"']+)["']"""), F.lit(1)), canonical_title)
    return pages.select(F.col(id_col).alias("title"), F.explode(F.array_distinct(F.concat(invoked, loaded))).alias("module"))


def exported_functions(modules: DataFrame, id_col: str = "title", text_col: str = "text") -> DataFrame:
    """module, function: what a Lua module returns: functions of the table that its last `return` names, or of that table itself.

    Comments are cut away first.
    """
    bare = F.regexp_replace(F.regexp_replace(text_col, r"(?s)--\[(=*)\[.*?\]\1\]", ""), r"--[^\n]*", "")
    rows = modules.select(F.col(id_col).alias("module"), bare.alias("t")).withColumn("table", F.regexp_extract("t", r"(?s).*\breturn\s+([A-Za-z_]\w*)\s*;?\s*\z", 1))
    declared = F.regexp_extract_all("t", F.lit(r"\bfunction\s+(\w+[.:]\w+)\s*\("), F.lit(1))
    assigned = F.regexp_extract_all("t", F.lit(r"(?m)\b(\w+\.\w+)\s*=\s*function\b"), F.lit(1))
    named = F.transform(F.filter(F.concat(declared, assigned), lambda x: F.regexp_extract(x, r"\A(\w+)", 1) == F.col("table")), lambda x: F.regexp_extract(x, r"(\w+)\z", 1))
    literal = F.regexp_extract("t", r"(?s)\breturn\s*\{(.*)\}\s*\z", 1)
    keys = F.regexp_extract_all(literal, F.lit(r"(?m)(?:^|[,{\n])\s*(\w+)\s*=\s*(?:function\b|\w)"), F.lit(1))
    return rows.select("module", F.explode(F.array_sort(F.array_distinct(F.concat(named, F.when(F.col("table") == "", keys).otherwise(F.slice(keys, 1, 0)))))).alias("function"))


def implementation_pages(used: DataFrame, pages: DataFrame, module_refs: DataFrame) -> DataFrame:
    """template, page, role: of templates (template) the pages that there are: themselves, /doc, the modules they name and
    the modules that these name (module_refs: title, module)."""
    t = used.select("template").distinct()
    doc = t.select("template", F.concat("template", F.lit("/doc")).alias("page"), F.lit("documentation").alias("role"))
    own = t.select("template", F.col("template").alias("page"), F.lit("template").alias("role"))
    first = t.join(module_refs.withColumnRenamed("title", "template"), "template").select("template", F.col("module").alias("page"))
    second = first.join(module_refs.select(F.col("title").alias("page"), "module"), "page").select("template", F.col("module").alias("page"))
    every = own.unionByName(doc).unionByName(first.withColumn("role", F.lit("module"))).unionByName(second.withColumn("role", F.lit("dependency")))
    order = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    found = every.join(pages.select(F.col("title").alias("page")), "page", "left_semi")
    best = found.groupBy("template", "page").agg(F.min(F.struct(order.alias("ord"), "role")).alias("r"))
    return best.select("template", "page", "r.role", F.col("r.ord").cast("int").alias("ord"))


def module_usage(calls: DataFrame, most_functions: int = 8, most_examples: int = 4) -> DataFrame:
    """module, uses, pages, functions ("name:count" of the most used), examples (shortest calls) of calls (page, module,
    function, raw, tokens)."""
    total = calls.groupBy("module").agg(F.count("*").alias("uses"), F.count_distinct("page").alias("pages"))
    n = first_per_group(calls.groupBy("module", "function").agg(F.count("*").alias("n")), ["module"], [F.desc("n"), F.asc("function")], most_functions)
    functions = n.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "function", "n"))), lambda x: F.concat_ws(":", x.function, x.n)), ",").alias("functions"))
    best = first_per_group(calls.select("module", "page", "raw", "tokens"), ["module"], [F.asc("tokens"), F.asc("page"), F.asc("raw")], most_examples)
    examples = best.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "raw"))), lambda x: x.raw), "; ").alias("examples"))
    return total.join(functions, "module").join(examples, "module")


def template_module_edges(refs: DataFrame) -> DataFrame:
    """template, module: distinct, of templates only (refs: title, module)."""
    return refs.filter(ascii_lower(F.col("title")).startswith("template:")).select(F.col("title").alias("template"), "module").distinct()


def module_patterns(usage: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """module, uses, pages, templates, rank: modules that are used or that templates name, the most used first."""
    named = edges.groupBy("module").agg(F.count_distinct("template").alias("templates"))
    both = usage.select("module", "uses", "pages").join(named, "module", "full")
    zero = F.lit(0).cast("long")
    told = both.select("module", *[F.coalesce(c, zero).alias(c) for c in ("uses", "pages", "templates")], F.lit(1).alias("all"))
    return first_per_group(told, ["all"], [F.desc("uses"), F.desc("templates"), F.asc("module")], most).select("module", "uses", "pages", "templates", F.col("place").alias("rank"))


def catalog_lookup(asked: DataFrame, titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """query, title: the first entry, by title, of which the title or an alias (alias, title) is what is asked (query, text)."""
    names = titles.select("title", F.lower("title").alias("key")).unionByName(aliases.select("title", F.lower("alias").alias("key")))
    return asked.select("query", F.lower(canonical_title(F.col("text"))).alias("key")).join(names, "key").groupBy("query").agg(F.min("title").alias("title"))


def usage_of(invocations: DataFrame, asked: DataFrame) -> DataFrame:
    """invocations (template, page, keys) of the asked templates (template), whatever the case of their letters."""
    return invocations.join(asked.select(F.lower("template").alias("key")).distinct(), F.lower("template") == F.col("key"), "left_semi")


def template_reference(summary: DataFrame, implementation: DataFrame, aliases: DataFrame, sections: DataFrame, most: int = 4) -> DataFrame:
    """One row per template of summary (of usage_summary()): its aliases, implementation pages by role, and the first sections
    of its documentation (title, place, heading)."""
    other = aliases.groupBy(F.col("title").alias("template")).agg(F.array_join(F.array_sort(F.collect_set("alias")), "; ").alias("aliases"))
    made = implementation.groupBy("template").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "page", "role"))), lambda x: F.concat_ws("=", x.role, x.page)), "; ").alias("implementation"))
    heads = sections.filter("heading is not null").join(implementation.filter("role = 'documentation'").select("template", F.col("page").alias("title")), "title")
    shown = first_per_group(heads.select("template", "place", "heading").withColumnRenamed("place", "at"), ["template"], [F.asc("at")], most)
    told = shown.groupBy("template").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "heading"))), lambda x: x.heading), "; ").alias("sections"))
    return summary.join(other, "template", "left").join(made, "template", "left").join(told, "template", "left").fillna("", ["aliases", "implementation", "sections"])
