"""Wikitext: sections, links, template calls, references, media, and lint rules as issue rows. Built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.functions.text import ascii_lower, canonical_title, namespace_of, normal_spaces, summary, template_title, token_estimate
from wikiloom.operators.artifacts import artifacts, indexed, masked, rows_of

# Fragments that mark unfinished text.
PLACEHOLDERS = ["TODO", "TBD", "FIXME", "Lorem ipsum", "INSERT ", "PLACEHOLDER"]


def _bundle(pages: DataFrame, kind: str, id_col: str, text_col: str) -> DataFrame:
    """The rows of one kind: out of a bundle of artifacts, which has no texts, or of the texts."""
    return rows_of(pages if text_col not in pages.columns else artifacts(pages, id_col, text_col, (kind,)), kind)


def sections(pages: DataFrame, id_col: str = "title", text_col: str = "text") -> DataFrame:
    """title, place, level, heading (null and level 1 for the lead), body, summary, tokens; empty bodies are dropped.

    Headings split the text within its row: every heading line is marked, and the parts between marks are the sections.
    """
    told = _bundle(pages, "sections", id_col, text_col)
    return told.select("title", "place", "level", "heading", "body", summary(F.col("body")).alias("summary"), token_estimate(F.col("body")).alias("tokens"))


def wikilinks(pages: DataFrame, id_col: str = "title", text_col: str = "text") -> DataFrame:
    """source, target, namespace, is_category: distinct; fragments are cut, addresses and parameters left out, a leading colon
    makes a category a plain link."""
    return _bundle(pages, "links", id_col, text_col).select(F.col("title").alias("source"), "target", "namespace", "is_category").distinct()


def calls(pages: DataFrame, id_col: str = "title", text_col: str = "text") -> DataFrame:
    """page, ord, name, given (arguments, each key and value), raw: every {{ }} of a page, innermost first, however deep."""
    return _bundle(pages, "calls", id_col, text_col).select(F.col("title").alias("page"), F.col("place").alias("ord"), "name", "given", "raw")


def keys_of(given: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(given, lambda g: g.key)))


def template_calls(pages: DataFrame, id_col: str = "title", text_col: str = "text") -> DataFrame:
    """page, ord, template, keys (sorted, `$n` for unnamed), given, raw, tokens; parser functions are left out."""
    told = calls(pages, id_col, text_col).select("page", "ord", template_title(F.col("name")).alias("template"), keys_of(F.col("given")).alias("keys"), "given", "raw", token_estimate(F.concat(F.lit("{{"), "raw", F.lit("}}"))).alias("tokens"))
    return told.filter("template is not null")


def module_calls(pages: DataFrame, id_col: str = "title", text_col: str = "text") -> DataFrame:
    """page, module, function, keys, raw, tokens: #invoke calls, each (module, function, keys) once a page, its first call."""
    told = calls(pages, id_col, text_col).filter(ascii_lower(F.col("name")).startswith("#invoke:"))
    module = normal_spaces(F.regexp_replace(F.regexp_replace("name", r"(?i)\A#invoke:", ""), r"(?i)\A\s*module:", ""))
    first = F.get(F.filter("given", lambda g: g.key == "$1"), 0)
    # the first unnamed argument is the function; the unnamed ones behind it are numbered from 1
    rest = F.transform(F.filter("given", lambda g: g.key != "$1"), lambda g: F.when(g.key.rlike(r"\A\$\d+\z"), F.concat(F.lit("$"), (F.substring(g.key, 2, 9).cast("int") - 1).cast("string"))).otherwise(g.key))
    told = told.select("page", "ord", F.concat(F.lit("Module:"), module).alias("module"), normal_spaces(first.value).alias("function"), F.array_sort(F.array_distinct(rest)).alias("keys"), F.concat(F.lit("{{"), "raw", F.lit("}}")).alias("raw"))
    told = told.filter("function is not null and function <> ''").groupBy("page", ascii_lower(F.col("module")).alias("m"), ascii_lower(F.col("function")).alias("f"), "keys").agg(F.min(F.struct("ord", "module", "function", "raw")).alias("x"))
    return told.select("page", "x.module", "x.function", "keys", "x.raw", token_estimate(F.col("x.raw")).alias("tokens"))


def media(pages: DataFrame, id_col: str = "title", text_col: str = "text") -> DataFrame:
    """page, file, kind, caption: inline images and gallery lines; the caption is the last part that is no option."""
    return _bundle(pages, "media", id_col, text_col).select(F.col("title").alias("page"), "file", "kind", "caption")


_LINE_ISSUE = "array<struct<rule:string,severity:string,line:int,evidence:string>>"
_PAIR = r"<ref\b[^>/]*>(?:(?!</ref>).)*</ref>|<ref\b[^>]*/>"
_PLACEHOLDER = "|".join(rf"\b{p.strip()}\b" for p in PLACEHOLDERS)


def _issue(test: Column, rule: str, severity: str, line: Column, evidence: Column) -> Column:
    return F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), line.cast("int").alias("line"), evidence.alias("evidence")))


def _several(found: Column, rule: str, severity: str, line: Column) -> Column:
    return F.transform(found, lambda x: _issue(F.lit(True), rule, severity, line, x))


def _heading(t: Column) -> Column:
    return F.regexp_extract(t, r"^(={2,6})\s*(.*?)\s*(={2,6})\s*$", 2)


def _line_issues(t: Column, line: Column) -> Column:
    left, right = F.char_length(F.regexp_extract(t, r"^(=+)", 1)), F.char_length(F.regexp_extract(t, r"(=+)\s*$", 1))
    low = ascii_lower(t)
    one = [
        _issue(t.rlike(r"^#{2,6}\s+\S"), "structure.markdown_heading", "error", line, t),
        _issue((left >= 2) & (left != right), "structure.malformed_heading", "error", line, t),
        _issue(t.rlike("[‘’“”]"), "style.curly_quotes", "info", line, F.regexp_extract(t, "([‘’“”])", 1)),
        _issue(t.rlike(_PLACEHOLDER), "style.placeholder_fragment", "warning", line, F.regexp_extract(t, _PLACEHOLDER, 0)),
        _issue(low.contains("{{citation needed") | low.contains("{{cn}}"), "profile.no_citation_needed", "warning", line, t),
    ]
    clusters = F.regexp_extract_all(t, F.lit(rf"(?is)((?:{_PAIR})(?:\s*(?:{_PAIR}))*[.,;:!?])"), F.lit(1))
    return F.concat(F.array(*one), _several(clusters, "citation.after_punctuation", "warning", line))


def _balance(t: Column, opening: str, closing: str) -> Column:
    cut = lambda x: F.char_length(t) - F.char_length(F.replace(t, F.lit(x), F.lit("")))
    return ((cut(opening) - cut(closing)) / 2).cast("int")


def top_lines(lines: Column) -> Column:
    """The first eight lines that aren't blank."""
    return F.slice(F.filter(lines, lambda x: F.trim(x) != ""), 1, 8)


def has_banner(lines: Column, banner: str) -> Column:
    return F.exists(top_lines(lines), lambda x: F.ltrim(x).startswith("{{" + banner + "|"))


def _text_issues(t: Column, lines: Column, banner: str | None, tags: list[str] | None, invoke: bool, short: bool) -> Column:
    first, cited = F.lit(1), t.rlike(r"(?i)<ref\b")
    described = t.rlike(r"(?i)\{\{\s*short description|\{\{\s*shortdesc:")
    one = [
        _issue(_balance(t, o, c) != 0, "wikitext.unbalanced", "error", first, F.concat(F.lit(f"{name}: "), _balance(t, o, c).cast("string"))) for o, c, name in (("{{", "}}", "templates"), ("[[", "]]", "links"))
    ]
    one += [
        _issue(cited & ~t.rlike(r"(?i)<references\b|\{\{\s*reflist"), "structure.require_reflist", "error", first, F.lit("")),
        _issue(cited & ~t.rlike(r"(?im)^==+\s*references\s*==+"), "structure.require_references_section", "error", first, F.lit("")),
        _issue(~described, "structure.require_short_description", "warning", first, F.lit("")),
        _issue(t.rlike(r"(?is)<gallery\b[^>/]*>(?:(?!</gallery>).)*</gallery>") & (F.size(F.filter(F.regexp_extract_all(t, F.lit(r"(?is)<gallery\b[^>/]*>((?:(?!</gallery>).)*)</gallery>"), F.lit(1)), lambda b: ~b.rlike(r"(?m)^\s*[^\s|<][^|\n]*\.\w+"))) > 0), "extension.gallery_empty", "warning", first, F.lit("<gallery>")),
    ]
    blocks = F.regexp_extract_all(t, F.lit(r"(?is)<tabber\b[^>/]*>((?:(?!</tabber>).)*)</tabber>"), F.lit(1))
    one.append(_issue(F.size(F.filter(blocks, lambda b: ~b.rlike(r"(?m)^\s*\|-\|"))) > 0, "extension.tabber_missing_separator", "error", first, F.lit("<tabber>")))
    one.append(_issue(F.size(F.filter(blocks, lambda b: b.rlike(r"(?m)^\s*\|-\|\s*(=|$)"))) > 0, "extension.tabber_empty_label", "error", first, F.lit("|-|")))
    styles = F.regexp_extract_all(t, F.lit(r"(?i)(<templatestyles\b[^>]*>)"), F.lit(1))
    several = [_several(F.filter(styles, lambda x: ~x.rlike(r"""(?i)\bsrc\s*=\s*["']?[^\s"'/>]""")), "asset.templatestyles_missing_src", "error", first)]
    if banner:
        one.append(_issue(~has_banner(lines, banner), "structure.require_article_quality_banner", "warning", first, F.lit("")))
    if not short:
        one.append(_issue(described, "capability.short_description_unsupported", "warning", first, F.lit("")))
    if not invoke:
        one.append(_issue(t.rlike(r"(?i)\{\{\s*#invoke:"), "capability.scribunto_unsupported", "error", first, F.regexp_extract(t, r"(?i)(\{\{\s*#invoke:[^{}]*)", 1)))
    if tags is not None:
        used = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"(?i)<([a-z][a-z0-9]*)\b"), F.lit(1)), ascii_lower)))
        several.append(_several(F.transform(F.filter(used, lambda x: ~x.isin(tags)), lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "capability.unsupported_extension_tag", "warning", first))
    return F.concat(F.array(*one), *several)


def proper_words(titles: DataFrame, phrases: list[str] | None = None) -> DataFrame:
    """word: capitalised words of phrases, and those of titles (title) behind the first, which is capitalised anyway."""
    words = F.split(normal_spaces(F.col("title")), " ")
    found = titles.select(F.explode(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).alias("word"))
    more = titles.sparkSession.createDataFrame([(w,) for p in phrases or [] for w in p.split()], "word string")
    return found.unionByName(more).select(F.regexp_replace("word", r"[^\p{L}\p{N}]", "").alias("word")).filter(F.col("word").rlike(r"^\p{Lu}")).distinct()


def lint(
    pages: DataFrame, templates: DataFrame | None = None, titles: DataFrame | None = None, modules: DataFrame | None = None, assets: DataFrame | None = None, proper: DataFrame | None = None,
    banner: str | None = None, tags: list[str] | None = None, invoke: bool = True, short_description: bool = True, id_col: str = "title", text_col: str = "text",
) -> DataFrame:
    """title, rule, severity, line, evidence: issues of the line rules, of whole texts, and of what doesn't exist.

    One pass over each text makes the issues of all rules that need nothing else. Rules about what exists are joins with a
    bundle of artifacts, which a second pass writes, and rest where their table isn't given: templates (template, and keys where its parameters are known), titles (title),
    modules (module, functions), assets (title), proper (word: what headings may capitalise). banner: a template that
    articles begin with; tags: those the wiki has; invoke and short_description: whether it has these.
    """
    rows = pages.select(F.col(id_col).alias("title"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"lines": F.split("text", r"\r?\n"), "masked": masked(F.col("text"))})
    named = F.transform("lines", lambda t, i: F.struct(F.nullif(ascii_lower(_heading(t)), F.lit("")).alias("name"), (i + 1).alias("line")))
    # headings in order of their names: one that stands behind its like comes again
    rows = rows.withColumn("heads", F.array_sort(F.filter(named, lambda x: x["name"].isNotNull())))
    again = F.transform("heads", lambda x, i: _issue(F.get(F.col("heads"), i - 1)["name"] == x["name"], "structure.duplicate_heading", "warning", x.line, x["name"]))
    by_line = F.flatten(F.transform("lines", lambda t, i: _line_issues(t, i + 1)))
    every = F.concat(by_line, again, _text_issues(F.col("masked"), F.col("lines"), banner, tags, invoke, short_description)).cast(_LINE_ISSUE)
    out = rows.select("title", F.explode(F.array_compact(every)).alias("x")).select("title", "x.*")
    bundle = indexed(pages, id_col, text_col, ("sections", "links", "calls")) if templates is not None or modules is not None or titles is not None else None

    def add(rows: DataFrame, rule: str, severity: str, evidence: Column, line: Column | None = None) -> None:
        nonlocal out
        out = out.unionByName(rows.select("title", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (F.lit(1) if line is None else line).cast("int").alias("line"), evidence.alias("evidence")))

    if templates is not None:
        used = template_calls(bundle).select(F.col("page").alias("title"), "template", "keys")
        add(used.select("title", "template").distinct().join(templates.select("template"), "template", "left_anti"), "template.unavailable", "error", F.col("template"))
        if "keys" in templates.columns:
            unknown = F.array_except("keys", "known")
            told = used.join(templates.select("template", F.col("keys").alias("known")), "template").withColumn("unknown", unknown).filter("size(unknown) > 0 and known is not null").select("title", "template", "unknown").distinct()
            add(told, "template.unknown_parameter", "warning", F.concat("template", F.lit(" unknown_parameters="), F.array_join("unknown", ", ")))
    if modules is not None:
        called = module_calls(bundle).select(F.col("page").alias("title"), "module", "function").distinct()
        add(called.select("title", "module").distinct().join(modules.select("module"), "module", "left_anti"), "module.unavailable", "error", F.col("module"))
        lost = called.join(modules.select("module", "functions"), "module").filter(~F.array_contains("functions", F.col("function")))
        add(lost, "module.unavailable_function", "error", F.concat("module", F.lit(" function="), "function"))
    if assets is not None:
        src = F.explode(F.array_distinct(F.regexp_extract_all(masked(F.col(text_col)), F.lit(r"""(?i)<templatestyles\b[^>]*?\bsrc\s*=\s*["']?([^"'>]+?)["']?\s*/?>"""), F.lit(1))))
        named = pages.select(F.col(id_col).alias("title"), src.alias("src")).withColumn("t", canonical_title(F.col("src")))
        named = named.withColumn("asset", F.when(namespace_of(F.col("t")) == "Main", F.concat(F.lit("Template:"), "t")).otherwise(F.col("t")))
        add(named.join(assets.select(F.lower("title").alias("key")), F.lower("asset") == F.col("key"), "left_anti"), "asset.templatestyles_unavailable_source", "error", F.col("asset"))
    if titles is not None:
        see = sections(bundle).filter("lower(heading) = 'see also'").select("title", F.col("body").alias("text"))
        red = wikilinks(see).select(F.col("source").alias("title"), "target").join(titles.select(F.col("title").alias("target")), "target", "left_anti")
        add(red, "integration.red_link_in_see_also", "warning", F.col("target"))
    if proper is not None:
        heads = pages.select(F.col(id_col).alias("title"), F.posexplode(F.split(text_col, r"\r?\n")).alias("at", "t")).select("title", "at", _heading(F.col("t")).alias("heading")).filter(F.col("heading").rlike(r"\s\p{Lu}\p{Ll}"))
        words = heads.withColumn("word", F.explode(F.split("heading", r"\s+"))).filter(F.col("word").rlike(r"^\p{Lu}\p{Ll}+$") & ~F.startswith("heading", F.col("word")))
        wrong = words.join(proper, "word", "left_anti").select("title", "at", "heading").distinct()
        add(wrong, "style.sentence_case_heading", "warning", F.col("heading"), F.col("at") + 1)
    return out


def lint_counts(issues: DataFrame) -> DataFrame:
    """title, errors, warnings, notes."""
    return issues.groupBy("title").agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "notes"))])
