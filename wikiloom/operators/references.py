"""Citations: every <ref> with its source, authority, identifiers and signals; all within the page's row, by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.functions.text import (
    ascii_lower, call_arguments, call_parts, canonical_title, domain, domain_kind, first_url, flat_excerpt, identifier, inner_calls, normal_spaces, normal_url, summary, template_title, token_estimate,
)
from wikiloom.operators.artifacts import artifacts, rows_of

# Arguments that hold a citation's parts, in the order in which they are tried.
TITLES = ["title", "chapter", "entry", "article", "script-title"]
CONTAINERS = ["website", "work", "journal", "newspaper", "magazine", "periodical", "encyclopedia", "publisher", "publication"]
DATES = ["date", "year", "publication-date", "access-date"]
QUOTES = ["quote", "quotation"]
URLS = ["url", "chapter-url", "article-url", "archive-url", "archiveurl"]
ARCHIVES = ["archive-url", "archiveurl"]
IDENTIFIERS = ["doi", "isbn", "issn", "oclc", "pmid", "pmcid", "arxiv", "jstor", "id"]
# Source types by what a template's name contains, first match first.
TYPES = [("journal", "journal"), ("book", "book"), ("news", "news"), ("video", "video"), ("tweet", "social"), ("social", "social"), ("wiki", "wiki"), ("sfn", "short-footnote"), ("harv", "short-footnote"), ("web", "web")]
#: Types of which the site stands for the container.
SITES = ["web", "news", "social", "video", "wiki"]

def _first(*options: Column) -> Column:
    """The first that is neither null nor empty; else the empty string."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def _value(key: str) -> Column:
    """The argument of that name, the last where it comes twice; null where there is none."""
    return F.try_element_at("given", F.lit(key))


def _flat(key: str) -> Column:
    return F.try_element_at("flat", F.lit(key))


def _argument(names: list[str]) -> Column:
    """The first of the named arguments that isn't empty, in prose."""
    return _first(*[_flat(n) for n in names])


def _sorted_set(*flags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*flags))))


def tags(pages: DataFrame, id_col: str = "title", text_col: str = "text") -> DataFrame:
    """page, place, heading (of the section; null in the lead), wikitext, name, group, body: one row per <ref>.

    pages: texts, or a bundle of artifacts, which has none.
    """
    bundle = artifacts(pages, id_col, text_col, ("refs",)) if text_col in pages.columns else pages
    each = rows_of(bundle, "refs").select(F.col("title").alias("page"), "place", "heading", "wikitext")
    head = F.regexp_extract("wikitext", r"(?is)\A<ref\b([^>]*?)/?>", 1)
    body = F.regexp_extract("wikitext", r"(?is)\A<ref\b[^>]*?>(.*)</ref\s*>\z", 1)

    def attribute(name: str) -> Column:
        quoted = F.regexp_extract(head, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'/>]+))""", 1)
        return F.nullif(normal_spaces(_first(quoted, *(F.regexp_extract(head, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'/>]+))""", k) for k in (2, 3)))), F.lit(""))

    return each.select("page", "place", "heading", "wikitext", attribute("name").alias("name"), attribute("group").alias("group"), F.when(F.col("wikitext").rlike(r"/>\z"), "").otherwise(body).alias("body"))


def references(pages: DataFrame, id_col: str = "title", text_col: str = "text", first_party: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Attributes of every citation, all or those of `columns`, for which alone texts are worked through; first_party: domains
    (and what ends with them) that are the wiki's own.

    The primary template of a citation is the least by kind (citations, short footnotes, notes, others) and title.
    """
    rows = tags(pages, id_col, text_col).withColumn("parts", F.transform(inner_calls(F.col("body")), call_parts))
    named = F.transform("parts", lambda p: F.struct(template_title(F.trim(F.get(p, 0))).alias("title"), call_arguments(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).alias("given")))
    rows = rows.withColumn("templates", F.filter(named, lambda t: t.title.isNotNull())).drop("parts")

    def kind(t: Column) -> Column:
        low = ascii_lower(t.title)
        return F.when(low.contains("cite ") | low.contains("citation"), 0).when(low.contains("sfn") | low.contains("harv"), 1).when(low.contains("ref") | low.contains("note"), 2).otherwise(3)

    best = F.get(F.array_sort(F.transform("templates", lambda t: F.struct(kind(t).alias("kind"), t.title.alias("title"), t.given.alias("given")))), 0)
    rows = rows.withColumn("best", best).withColumn("template", F.col("best.title")).withColumn("given", F.coalesce("best.given", F.array().cast("array<struct<key:string,value:string>>"))).drop("best")
    rows = rows.withColumn("given", F.map_from_entries(F.filter("given", lambda g, i: ~F.exists(F.slice("given", i + 2, F.size("given")), lambda h: h.key == g.key))))
    rows = rows.withColumn("flat", F.transform_values("given", lambda k, v: flat_excerpt(v)))  # apart, as few columns need it
    links = F.filter(F.regexp_extract_all("body", F.lit(r"\[\[([^\[\]|#\r\n]+)"), F.lit(1)), lambda x: F.trim(x) != "")
    rows = rows.withColumn("links", F.array_distinct(F.transform(links, lambda x: canonical_title(F.regexp_replace(F.trim(x), r"\A:", "")))))

    author = _first(_argument(["author", "authors"]), _named_author("last"), _named_author("last1"), _argument(["editor"]))
    urls = F.array_compact(F.array(*[normal_url(_value(n)) for n in URLS], normal_url(first_url(F.col("body")))))
    rows = rows.select(
        "page", "place", "heading", "name", "group", "wikitext", "body", "template", "templates", "links", "given", "flat",
        _first(_argument(TITLES), _argument(["$1"]), F.coalesce(F.get("links", 0), F.lit(""))).alias("ref_title"), _argument(CONTAINERS).alias("named_container"), author.alias("author"), _argument(DATES).alias("date"),
        (_argument(QUOTES) != "").alias("has_quote"), F.array_sort(F.array_distinct(urls)).alias("urls"), F.nullif(_first(*[normal_spaces(_value(n)) for n in ARCHIVES]), F.lit("")).alias("archive"),
    )
    rows = rows.withColumn("url", F.coalesce(F.get("urls", 0), F.lit(""))).withColumn("domain", _first(domain(F.col("url")), domain(F.col("archive"))))
    low, source = ascii_lower(F.coalesce("template", F.lit(""))), None
    for part, name in TYPES:
        source = F.when(low.contains(part), name) if source is None else source.when(low.contains(part), name)
    host = domain_kind(F.col("domain"))
    source = source.when(host.isin("video", "social", "wiki"), host).when(F.size("urls") > 0, "web").when(F.trim("body") == "", "note").otherwise("other")
    rows = rows.withColumn("source_type", source)
    rows = rows.withColumn("container", F.when((F.col("named_container") == "") & F.col("source_type").isin(SITES), F.col("domain")).otherwise(F.col("named_container")))
    own = F.lit(False)
    for site in first_party or []:
        own = own | F.col("domain").endswith(site)
    rows = rows.withColumn("origin", F.when(own, "first-party").when(F.col("source_type") == "wiki", "wiki").when(F.col("domain") == "", "unknown").otherwise("external"))
    rows = rows.withColumn("source_family", F.when(F.col("origin") == "first-party", F.concat(F.lit("first-party-"), "source_type")).otherwise(F.col("source_type")))
    lanes = [("domain", F.col("domain")), ("container", F.col("container")), ("author", F.col("author")), ("template", F.col("template")), ("named-reference", F.col("name")), ("source-type", F.col("source_type"))]
    authority = F.coalesce(*[F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, v in lanes])
    rows = rows.withColumn("a", authority).withColumn("authority_kind", F.col("a.kind")).withColumn("authority", F.col("a.value")).drop("a")
    rows = rows.withColumn("family", F.coalesce("template", F.when(F.col("group").isNotNull() | (F.col("source_type") == "note"), "note").when(F.col("source_type") == "web", "bare-url").otherwise("<ref>")))
    site = F.when(F.col("origin") == "first-party", F.concat(F.lit("first-party "), "source_type")).otherwise(F.col("source_type"))
    profile = F.when((F.col("domain") != "") & F.col("source_type").isin(SITES), F.concat(site, F.lit(" / "), "domain")).when(F.col("authority_kind").isin("container", "author"), F.concat(site, F.lit(" / "), "authority"))
    rows = rows.withColumn("profile", profile.when(F.col("family") != "<ref>", F.concat("source_type", F.lit(" / "), "family")).otherwise(F.col("source_type")))
    present = [(k, _value(k)) for k in IDENTIFIERS]
    rows = rows.withColumn("id_keys", _sorted_set(*[F.when(normal_spaces(v) != "", k) for k, v in present], F.when(F.size("urls") > 0, "url"), F.when(F.col("archive").isNotNull(), "archive-url")))
    plain = [(k, F.when(F.lit(k == "id"), _flat(k)).otherwise(identifier(F.lit(k), _flat(k)))) for k, _ in present]
    rows = rows.withColumn("ids", _sorted_set(*[F.when(v != "", F.concat(F.lit(f"{k}:"), v)) for k, v in plain]))
    held = F.col("template").isNotNull()
    flags = [
        (held, "citation-template"), (F.col("ref_title") != "", "has-title"), (F.col("container") != "", "has-container"), (F.col("author") != "", "has-author"), (F.col("domain") != "", "has-domain"), (F.col("date") != "", "has-date"),
        (F.size("id_keys") > 0, "has-identifier"), (F.col("archive").isNotNull(), "has-archive"), (F.col("has_quote"), "has-quote"), (F.size("links") > 0, "has-links"), (F.col("name").isNotNull(), "named-reference"),
        (F.col("group").isNotNull(), "grouped-reference"), (F.trim("body") == "", "reused-reference"), (~held & (F.col("domain") != ""), "bare-url"), (F.col("origin") == "first-party", "first-party"),
    ]
    more = F.array(F.concat(F.lit("source-family:"), "source_family"), F.concat(F.lit("authority:"), "authority_kind"), F.when(F.col("source_type").isin("social", "video", "wiki"), F.concat(F.lit("source-type:"), "source_type")))
    signals = F.concat(F.array(*[F.when(c, n) for c, n in flags]), more, F.transform("id_keys", lambda k: F.concat(F.lit("identifier:"), k)), F.transform("ids", lambda e: F.concat(F.lit("identifier-entry:"), F.substring_index(e, ":", 1))))
    rows = rows.withColumn("signals", F.array_sort(F.array_distinct(F.array_compact(signals))))
    named_hint = F.concat(F.lit("Named reference "), "name")
    titled = F.when(F.col("container") != "", F.concat("ref_title", F.lit(" ("), "container", F.lit(")"))).otherwise(F.col("ref_title"))
    held_by = F.when(F.col("author") != "", F.concat("container", F.lit(" ("), "author", F.lit(")"))).otherwise(F.col("container"))
    hint = F.when(F.col("ref_title") != "", titled).when(F.col("container") != "", held_by)
    text = _first(flat_excerpt(F.col("body")), hint, F.col("author"), F.col("domain"), F.col("authority"), F.array_join(F.transform("templates", lambda t: t.title), ", "), named_hint, F.lit("<ref>"))
    rows = rows.select(
        "page", "place", "heading", "name", "group", "profile", "family", "template", "source_type", "origin", "source_family", "authority_kind", "authority", "ref_title", "container", "author", "domain", "date", "url", "id_keys", "ids", "urls", "signals",
        summary(text).alias("summary"), "wikitext", "body", F.array_sort(F.array_distinct(F.transform("templates", lambda t: t.title))).alias("templates"), "links", token_estimate(F.col("wikitext")).alias("tokens"),
    )
    return _settled(rows.select(*columns) if columns else rows)


def _settled(rows: DataFrame) -> DataFrame:
    """rows behind a generator of one row each, under which no filter is pushed: there, a filter on a column would hold its whole
    derivation, each step as often as later ones name it. Nor are columns pruned there: rows has those that are needed."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def _named_author(key: str) -> Column:
    """Last and first name, as `Last, First`."""
    last, first = _argument([key]), _argument(["first", "first1"])
    return F.when(last == "", "").when(first == "", last).otherwise(F.concat(last, F.lit(", "), first))


def authorities(refs: DataFrame) -> DataFrame:
    """page, place, authority_key, authority_kind, authority, text (what it is searched by): one row per citation."""
    spaced = normal_spaces(F.col("authority"))
    key = F.when(spaced == "", F.col("authority_kind")).otherwise(F.concat("authority_kind", F.lit(":"), ascii_lower(spaced)))
    every = F.concat(F.array("authority", "ref_title", "container", "author", "domain", "source_family", "source_type", "origin", "summary"), "ids", "templates", "links")
    words = F.array_sort(F.array_distinct(F.filter(F.transform(every, normal_spaces), lambda x: x.isNotNull() & (x != ""))))
    return refs.select("page", "place", key.alias("authority_key"), "authority_kind", "authority", F.array_join(words, "\n").alias("text"))


def identifiers(refs: DataFrame) -> DataFrame:
    """page, place, key, value: one row per identifier of a citation."""
    return refs.select("page", "place", F.explode("ids").alias("e")).select("page", "place", F.substring_index("e", ":", 1).alias("key"), F.regexp_replace("e", r"\A[^:]*:", "").alias("value"))
