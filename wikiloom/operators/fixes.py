"""Safe fixes as edits: places in a text (code points from 0, end exclusive) and what is to stand there."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.functions.text import ascii_lower, normal_spaces

# Common headings as articles write them; other cases of the same words are mended.
HEADINGS = ["See also", "External links", "Further reading", "Early life", "Early life and education", "Personal life", "Notable works", "Notable work"]
_MARK = "\u0001"
_HEADING = r"(?m)^(?:={2,6})[ \t]*(?:[^=\r\n](?:[^\r\n]*?[^=\r\n])??)[ \t]*={2,6}[ \t]*$"
_REF = r"(?:<ref\b[^>/]*>(?:(?!</ref>).)*</ref>|<ref\b[^>]*/>)"
_CLUSTER = rf"(?is){_REF}(?:\s*{_REF})*[.,;:!?]"
_EDIT = "array<struct<start:int,end:int,replacement:string,rule:string>>"


def spans(text: str, *patterns: str) -> list[Column]:
    """For each pattern an array (start, end, match) of its matches in the column named `text`; to be columns of their own.

    Matches are fenced in, the text is parted at the fences, and the parts' lengths are added up. The fence is U+0001; where a
    text holds that itself, U+0004 stands for it in the matches.
    """
    none = F.array(F.lit(0))
    out = []
    for pattern in patterns:
        parts = F.split(F.regexp_replace(F.translate(text, _MARK, "\u0004"), f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)

        def told(p: Column) -> Column:
            ends = F.aggregate(p, none, lambda s, x: F.array_append(s, F.element_at(s, -1) + F.char_length(x)))
            rows = F.transform(F.array(F.struct(p.alias("p"), ends.alias("e"))), lambda x: F.transform(F.sequence(F.lit(1), F.size(x.p) - 1, F.lit(2)), lambda i: F.struct(F.get(x.e, i).alias("start"), F.get(x.e, i + 1).alias("end"), F.get(x.p, i).alias("match"))))
            return F.when(F.size(p) > 1, F.get(rows, 0)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))

        out.append(F.get(F.transform(F.array(parts), told), 0))
    return out


def _edits(name: str, rule: str, replacement) -> Column:
    return F.transform(name, lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), replacement(m.match).alias("replacement"), F.lit(rule).alias("rule")))


def edited(pages: DataFrame, id_col: str = "title", text_col: str = "text", banner: str | None = None, reflist: str | None = "Reflist") -> DataFrame:
    """title, text and edits, an array of (start, end, replacement, rule) in order of place: all found in one pass.

    Curly quotes become straight, Markdown headings wiki headings, headings of HEADINGS take their usual case (one # alone is an item of a list), punctuation goes
    before the citations that it follows, a References section without `reflist` gets it behind its heading, and an article
    without `banner` (`Name|` of a template, looked for in the first eight lines that aren't blank) gets `banner|unverified`
    below its short description, else before its first line. Null texts have no edits.
    """
    rows = pages.select(F.col(id_col).alias("title"), F.col(text_col).alias("text"))
    patterns = {"quotes": "[‘’“”]", "markdown": r"(?m)^#{2,6}[ \t]+\S[^\r\n]*$", "headings": _HEADING, "clusters": _CLUSTER, "first": r"(?m)^[^\r\n]*\S[^\r\n]*$"}
    found = rows.withColumns(dict(zip(patterns, spans("text", *patterns.values()), strict=True)))

    def markdown(x: Column) -> Column:
        bar = F.repeat(F.lit("="), F.char_length(F.regexp_extract(x, r"^(#+)", 1)))
        return F.concat(bar, F.lit(" "), F.trim(F.regexp_replace(x, r"^#+", "")), F.lit(" "), bar)

    name = lambda x: normal_spaces(F.regexp_replace(x, r"^=+|=+[ \t]*$", ""))
    usual = F.create_map(*[F.lit(x) for h in HEADINGS for x in (h.lower(), h)])
    cased = F.filter("headings", lambda m: F.coalesce(F.try_element_at(usual, ascii_lower(name(m.match))) != name(m.match), F.lit(False)))
    bars = lambda x: F.regexp_extract(x, r"^(=+)", 1)
    found = found.withColumn("cased", cased)
    every = [
        _edits("quotes", "style.curly_quotes", lambda x: F.when(x.isin("‘", "’"), "'").otherwise('"')),
        _edits("markdown", "structure.markdown_heading", markdown),
        _edits("cased", "style.sentence_case_heading", lambda x: F.concat(bars(x), F.lit(" "), F.try_element_at(usual, ascii_lower(name(x))), F.lit(" "), bars(x))),
        _edits("clusters", "citation.after_punctuation", lambda x: F.concat(F.right(x, F.lit(1)), F.substring(x, 1, F.char_length(x) - 1))),
    ]
    if reflist:
        # the section goes to the next heading of its level or above, or to the end
        heading = F.filter("headings", lambda m: ascii_lower(name(m.match)) == "references")
        found = found.withColumn("cited", F.get(heading, 0))
        level = F.char_length(bars(F.col("cited.match")))
        after = F.get(F.filter("headings", lambda m: (m.start > F.col("cited.start")) & (F.char_length(bars(m.match)) <= level)), 0)
        found = found.withColumn("after", F.coalesce(after.start, F.char_length("text")))
        body = F.substring(F.col("text"), F.col("cited.end") + 1, F.col("after") - F.col("cited.end"))
        lacking = F.col("cited").isNotNull() & ~F.coalesce(body.rlike(rf"(?i)\{{\{{\s*{reflist}\s*[|}}]"), F.lit(False))
        line_end = F.substring(F.col("text"), F.col("cited.end") + 1, F.lit(2))
        skip = F.when(line_end.startswith("\r\n"), 2).when(line_end.startswith("\n"), 1).otherwise(0)
        put = F.concat(F.when(skip == 0, "\n").otherwise(""), F.lit("{{" + reflist + "}}\n"))
        every.append(F.when(lacking, F.array(F.struct((F.col("cited.end") + skip).alias("start"), (F.col("cited.end") + skip).alias("end"), put.alias("replacement"), F.lit("structure.require_reflist").alias("rule")))))
    if banner:
        top = F.slice("first", 1, 8)
        short = F.get(F.filter(top, lambda m: m.match.rlike(r"(?i)\{\{\s*short description|\{\{\s*shortdesc:")), 0)
        has = F.exists(top, lambda m: F.ltrim(m.match).startswith("{{" + banner + "|"))
        text = "{{" + banner + "|unverified}}"
        at = F.coalesce(short.end, F.get(top, 0).start, F.lit(0))
        put = F.when(short.isNotNull(), F.lit("\n" + text)).otherwise(F.lit(text + "\n"))
        every.append(F.when(~has, F.array(F.struct(at.alias("start"), at.alias("end"), put.alias("replacement"), F.lit("structure.require_article_quality_banner").alias("rule")))))
    none = F.array().cast(_EDIT)
    return found.select("title", "text", F.array_sort(F.concat(*(F.coalesce(e.cast(_EDIT), none) for e in every))).alias("edits"))


def edit_rows(found: DataFrame) -> DataFrame:
    """title, start, end, replacement, rule: an edit a row. Of an inner explode Spark would infer a filter on the edits' number
    and push it below the steps that find them, which then ran twice."""
    return found.select("title", F.explode_outer("edits").alias("e")).filter("e is not null").select("title", "e.*")


def gathered(pages: DataFrame, edits: DataFrame, id_col: str = "title", text_col: str = "text") -> DataFrame:
    """title, text and edits of edits given as rows (title, start, end, replacement, rule), which meet their pages by title."""
    by = edits.groupBy("title").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "replacement", "rule"))).alias("edits"))
    rows = pages.select(F.col(id_col).alias("title"), F.col(text_col).alias("text")).join(by, "title", "left")
    return rows.select("title", "text", F.coalesce("edits", F.array().cast(_EDIT)).alias("edits"))


def applied(found: DataFrame) -> DataFrame:
    """title, text, fixed, n_edits, status: each page's edits applied in one walk along its text, or none of them.

    status is `applied`; `unchanged` without edits; `invalid` where an edit ends before it starts or past the text's end;
    `overlap` where one starts before another ends. Texts of the latter two stay as they are. Several edits may insert at one
    place, in order of their texts. Null texts stay null.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, said = [], []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                edits = sorted((e["start"], e["end"], e["replacement"] or "") for e in edits)
                status, out, at = ("applied" if edits else "unchanged"), [], 0
                for start, end, replacement in edits:
                    if text is None or start > end or start < 0 or end > len(text):
                        status = "invalid"
                        break
                    if start < at:
                        status = "overlap"
                        break
                    out += [text[at:start], replacement]
                    at = end
                if status == "applied":
                    text = "".join([*out, text[at:]])
                texts.append(text)
                said.append((len(edits), status))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([s == "applied" for _, s in said]), pa.array([n for n, _ in said], pa.int32()), pa.array([s for _, s in said], pa.string())],
                ["title", "text", "fixed", "n_edits", "status"],
            )

    kind = found.schema["title"].dataType.simpleString()
    slim = found.select("title", "text", F.transform("edits", lambda e: F.struct(e.start.alias("start"), e.end.alias("end"), e.replacement.alias("replacement"))).alias("edits"))
    return slim.mapInArrow(walk, f"title {kind}, text string, fixed boolean, n_edits int, status string")
