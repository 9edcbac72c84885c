"""All extractions of a page in one pass over its text: one wide row a page, one array of structs for each kind.

Written as Parquet, a bundle is read by column: who asks for links reads the links alone. Steps that several extractions
share (masking, parting at headings, finding calls) are columns of their own, so that each text is worked through once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.functions.text import _once, call_arguments, call_parts, canonical_title, inner_calls, namespace_of, normal_spaces, without_comments
from wikiloom.staging import staged

KINDS = ("sections", "links", "calls", "media", "refs")
# Regions whose text isn't markup.
IGNORED = "nowiki|pre|source|code|syntaxhighlight|templatedata"

_MARK = "\u0001"
_HEADING = r"^={2,6}[ \t]*[^=\r\n](?:[^\r\n]*?[^=\r\n])??[ \t]*={2,6}[ \t]*\r?$"
_REF = r"<[rR][eE][fF](?:\s[^>]*)?/>|<[rR][eE][fF](?:\s[^>]*?)?>(?s:.*?)</[rR][eE][fF]\s*>"
_OPTION = r"(?i)\A\s*(thumb|thumbnail|frame|frameless|border|left|right|center|none|upright.*|\d+(x\d+)?px|x\d+px|alt=.*|link=.*|class=.*|page=.*|lang=.*)\s*\z"


def masked(text: Column) -> Column:
    """text without comments and ignored regions."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), rf"(?is)<({IGNORED})\b[^>/]*>.*?</\1>", "")


def _all(text: str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))


def _sections() -> Column:
    """Parts come as lead, heading, body, heading, body ...; sections without a body are dropped."""

    def one(i: Column) -> Column:
        head = F.when(i > 0, F.get("parts", 2 * i - 1))
        body = F.trim(F.regexp_replace(F.get("parts", 2 * i), r"\A\s+|\s+\z", ""))
        heading = F.nullif(normal_spaces(F.regexp_replace(head, r"\A=+", "")), F.lit(""))
        return F.struct(i.alias("place"), F.coalesce(F.char_length(F.regexp_extract(head, r"\A(=+)", 1)), F.lit(1)).alias("level"), heading.alias("heading"), body.alias("body"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / 2).cast("int")), one), lambda s: s.body != "")


def _links() -> Column:
    """Distinct; fragments are cut, addresses and parameters left out, a leading colon makes a category a plain link."""
    bare = F.transform("found_links", lambda r: F.struct(F.startswith(F.trim(r), F.lit(":")).alias("colon"), F.trim(F.regexp_replace(F.regexp_replace(F.trim(r), r"\A:", ""), r"#.*", "")).alias("t")))
    kept = F.filter(bare, lambda x: (x.t != "") & ~x.t.rlike(r"(?i)\A[a-z]+://|[{}<>%]|\$\d"))
    named = F.transform(kept, lambda x: F.struct(canonical_title(x.t).alias("target"), x.colon.alias("colon")))
    return F.array_distinct(
        F.transform(named, lambda x: _once(namespace_of(x.target), lambda ns: F.struct(x.target.alias("target"), ns.alias("namespace"), ((ns == "Category") & ~x.colon).alias("is_category"))))
    )


def _calls() -> Column:
    """Every {{ }}, innermost first, however deep: its name, and its arguments as keys and values."""

    def one(raw: Column) -> Column:
        return _once(call_parts(raw), lambda p: F.struct(F.trim(F.get(p, 0)).alias("name"), call_arguments(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).alias("given"), raw.alias("raw")))

    return F.transform("found_calls", one)


def _media() -> Column:
    """Inline images and gallery lines; the caption is the last part that is no option."""

    def one(kind: str):
        def told(p: Column) -> Column:
            said = F.filter(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: ~x.rlike(_OPTION))
            file = F.when(F.get(p, 0).rlike("(?i)^\\s*(file|image):"), F.get(p, 0)).otherwise(F.concat(F.lit("File:"), F.get(p, 0)))
            return F.struct(canonical_title(file).alias("file"), F.lit(kind).alias("kind"), F.coalesce(F.trim(_once(said, lambda s: F.get(s, F.size(s) - 1))), F.lit("")).alias("caption"))

        return lambda raw: _once(F.split(raw, r"\|"), told)

    lines = F.filter(F.flatten(F.transform("found_galleries", lambda b: F.split(b, r"\r?\n"))), lambda x: F.trim(x) != "")
    return F.concat(F.transform("found_files", one("inline")), F.transform(lines, one("gallery")))


def _refs() -> Column:
    """Each <ref> with the heading in force (null in the lead), in one walk along headings and tags."""
    none = F.struct(F.lit(None).cast("string").alias("heading"), F.array().cast("array<struct<heading:string,wikitext:string>>").alias("refs"))

    def step(s: Column, x: Column) -> Column:
        title = x.startswith("=")
        name = normal_spaces(F.regexp_replace(x, r"\A=+|=+\s*\z", ""))
        return F.struct(F.when(title, name).otherwise(s.heading).alias("heading"), F.when(title, s.refs).otherwise(F.array_append(s.refs, F.struct(s.heading.alias("heading"), x.alias("wikitext")))).alias("refs"))

    return F.aggregate("found_refs", none, step, lambda s: s.refs)


def artifacts(pages: DataFrame, id_col: str = "title", text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """title and an array column for each of `kinds`; null texts have null arrays, empty texts empty ones.

    sections: place, level (1 for the lead), heading (null for the lead), body. links: target, namespace, is_category.
    calls: name, given, raw. media: file, kind, caption. refs: heading, wikitext.
    """
    rows = pages.select(F.col(id_col).alias("title"), F.col(text_col).alias("text"))
    if {"links", "calls", "media"} & set(kinds):
        rows = rows.withColumn("masked", masked(F.col("text")))
    found = {}
    if "sections" in kinds:
        marked = F.regexp_replace(F.translate("text", _MARK, ""), r"(?m)^(={2,6})[ \t]*([^=\r\n](?:[^\r\n]*?[^=\r\n])??)[ \t]*\1[ \t]*\r?$", f"{_MARK}$1 $2{_MARK}")
        found["parts"] = F.split(marked, _MARK)
    if "links" in kinds:
        found["found_links"] = _all("masked", r"\[\[([^\[\]|\r\n]+)(?:\|[^\[\]]*)?\]\]")
    if "calls" in kinds:
        found["found_calls"] = inner_calls(F.col("masked"))
    if "media" in kinds:
        found["found_files"] = _all("masked", r"(?i)\[\[\s*((?:file|image):[^\[\]]+)\]\]")
        found["found_galleries"] = _all("masked", r"(?is)<gallery\b[^>]*>(.*?)</gallery>")
    if "refs" in kinds:
        found["found_refs"] = F.regexp_extract_all(without_comments(F.col("text")), F.lit(f"(?m)({_HEADING}|{_REF})"), F.lit(1))
    made = {"sections": _sections, "links": _links, "calls": _calls, "media": _media, "refs": _refs}
    return rows.withColumns(found).select("title", *(made[k]().alias(k) for k in KINDS if k in kinds))


def indexed(pages: DataFrame, id_col: str = "title", text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The bundle written to the shared folder, from one scan of the pages; each use reads its own column of it."""
    return staged(artifacts(pages, id_col, text_col, kinds), "artifacts")


def rows_of(bundle: DataFrame, kind: str) -> DataFrame:
    """title, place (in the page) and the fields of one kind, a row each.

    The outer generator, as for the other Spark infers a filter on the array's size, under which the extraction is made anew.
    """
    each = bundle.select("title", F.posexplode_outer(kind).alias("at", "x")).filter("at is not null")
    return each.select("title", *([] if kind == "sections" else [F.col("at").alias("place")]), "x.*")


def counts(bundle: DataFrame) -> DataFrame:
    """title and how many of each kind a page has."""
    kinds = [k for k in KINDS if k in bundle.columns]
    return bundle.select("title", *(F.coalesce(F.size(k), F.lit(0)).cast("long").alias(k) for k in kinds))
