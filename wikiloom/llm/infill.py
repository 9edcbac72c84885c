"""Fill-in-middle transformation (operator 11): units cut and arranged by built-in column functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
LINES = r"[^\n]*\n|[^\n]+"


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _joined(units: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(units, start, size), "")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINES, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """One row per document: id, text, n (units), form, prefix, middle, suffix, output.

    The text is cut into units (matches of `unit`, which must cover it). Four numbers from the sha256 of `seed:id` choose
    two cuts, whether the text is rearranged (`rate` in 100) and how (`spm` in 100 of these begin with the suffix): so every run
    and every machine gives the same. form is `psm`, `spm`, or `plain` with the text as output, where it is empty, holds a
    mark, or isn't chosen; prefix, middle and suffix are null then. Null text counts as empty, a null id as the empty string.
    Repeated rows give repeated results, an empty table none; further columns of docs, whatever their names, are ignored.
    Map-only, in the JVM: no shuffle, no Python.
    """
    p, s, m = marks
    text = F.coalesce(F.col(text_col), F.lit(""))
    drawn = docs.select(
        F.col(id_col), text.alias("text"), F.regexp_extract_all(text, F.lit(unit), 0).alias("units"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256).alias("digest"),
    )
    n = F.size("units")
    one, two = (_draw(F.col("digest"), k) % (n + 1) for k in (0, 1))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (_draw(F.col("digest"), 2) % 100 >= rate), "plain").when(_draw(F.col("digest"), 3) % 100 < spm, "spm").otherwise("psm")
    cut = drawn.select(id_col, "text", "units", n.cast("long").alias("n"), form.alias("form"), F.least(one, two).cast("int").alias("low"), F.greatest(one, two).cast("int").alias("high"))
    whole = F.col("form") == "plain"
    parts = {"prefix": (F.lit(1), F.col("low")), "middle": (F.col("low") + 1, F.col("high") - F.col("low")), "suffix": (F.col("high") + 1, F.col("n").cast("int") - F.col("high"))}
    split = cut.select(id_col, "text", "n", "form", *(F.when(~whole, _joined(F.col("units"), *at)).alias(name) for name, at in parts.items()))
    psm, spm_form = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"), F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    return split.withColumn("output", F.when(whole, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_form))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text, from an output and its form alone: texts that hold a mark are never rearranged, so the marks part it."""
    quoted = "|".join(rf"\Q{x}\E" for x in marks)
    parts = F.split(output, quoted, -1)  # what stands before the first mark is empty
    first, second = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(first, parts[3], second))
