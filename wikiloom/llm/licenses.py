"""License scans (operator 2): passages against licence templates by Dice over word bigrams, candidates pruned by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wikiloom.llm.common import ascii_lower, stage

# Licence notices as their licences or common practice word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_AS_IS = "IN NO EVENT SHALL THE {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. ' + _AS_IS.format("COPYRIGHT HOLDER OR CONTRIBUTORS")
_GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
# Whole licence bodies, and notices of several lines, that are looked for in windows of words only.
BODIES = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("GPL-2.0", _GNU.format("program", ";", "General Public", "2")),
    ("LGPL-2.1", _GNU.format("library", ";", "Lesser General Public", "2.1")),
    ("LGPL-3.0", _GNU.format("program", ":", "Lesser General Public", "3")),
    ("AGPL-3.0", _GNU.format("program", ":", "Affero General Public", "3")),
]
#: Dice coefficient from which a passage is a licence notice; template bigrams up to which they are broadcast.
DICE, BROADCAST_BIGRAMS = 0.8, 500_000


def normal_words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, everything but ASCII letters, digits and non-ASCII characters parts them."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def _grams(w: Column) -> Column:
    """The distinct hashes of a word array's bigrams; a single word is one gram."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.slice(w, i, 2)))
    return F.when(F.size(w) > 1, F.array_distinct(pairs)).when(F.size(w) == 1, F.array(F.xxhash64(F.slice(w, 1, 1)))).otherwise(F.array().cast("array<bigint>"))


def templates(spark: SparkSession) -> DataFrame:
    """license, notice, whole (looked for in windows only)."""
    return spark.createDataFrame([(*t, False) for t in TEMPLATES] + [(*t, True) for t in BODIES], "license string, notice string, whole boolean")


def _windows(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, dice: float) -> DataFrame:
    """id, mark, from, to (places of bigrams in the whole text), license, both, dice: runs of words, across lines, that
    reach the coefficient with a template. Of windows that start alike, or end alike, the most similar one is left.

    A window that reaches it holds dice / (2 - dice) of the template's bigrams, so only texts that hold so many anywhere
    are looked at by place. Windows begin at a bigram of the template and are as long as its size allows.
    """
    longer = (2 - dice) / dice
    w = F.flatten(F.transform(F.split(text_col, r"[\r\n]+", -1), normal_words))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.xxhash64(F.slice("w", i, 2)))
    # made inside the generator, as for lines
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), w.alias("w")).filter("size(w) > 1")
    placed = rows.select("id", "mark", F.posexplode(pairs).alias("at", "gram"))
    side = known.filter("n_words > 1").select("license", "notice", "n_there", (F.floor(F.col("n_there") * longer) + F.col("n_words") - 1 - F.col("n_there")).alias("most"), F.explode("grams").alias("gram"))
    small = side.count() <= BROADCAST_BIGRAMS
    side = F.broadcast(side) if small else side
    hits = placed.join(side, "gram").groupBy("id", "mark", "notice", "license", "n_there", "most").agg(F.count_distinct("gram").alias("n"))
    hopeful = stage(hits.filter(F.col("n") >= F.col("n_there") / longer).drop("n"), "licence-texts")
    there = hopeful.select(F.col("id").alias("i"), F.col("mark").alias("m")).distinct()
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))
    # joined before any text is taken apart
    few = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col)).join(there, same, "left_semi").dropDuplicates(["id", "mark"])
    chosen = few.select("id", "mark", w.alias("w")).select("id", "mark", F.posexplode(pairs).alias("at", "gram"))
    seen = chosen.withColumn("before", F.coalesce(F.lag("at").over(Window.partitionBy("id", "mark", "gram").orderBy("at")), F.lit(-1)))
    asked = hopeful.withColumnsRenamed({"id": "i", "mark": "m"})
    told = seen.join(asked, same).join(side.select(F.col("notice").alias("t"), F.col("gram").alias("g"), F.lit(True).alias("hit")), (F.col("notice") == F.col("t")) & (F.col("gram") == F.col("g")), "left")
    laid = told.groupBy("id", "mark", "notice", "license", "n_there", "most").agg(F.sort_array(F.collect_list(F.struct("at", "before", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("all"))

    def best_end(first: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            here = s.here + F.when(x.before < first.at, 1).otherwise(0)
            both = s.both + F.when((x.before < first.at) & x.hit, 1).otherwise(0)
            score = 2 * both / (here + F.col("n_there"))
            better = x.hit & (score > s.dice)
            return F.struct(here.alias("here"), both.alias("both"), F.when(better, score).otherwise(s.dice).alias("dice"), F.when(better, x["at"]).otherwise(s.to).alias("to"), F.when(better, both).otherwise(s.most).alias("most"))

        none = F.struct(F.lit(0).alias("here"), F.lit(0).alias("both"), F.lit(0.0).alias("dice"), F.lit(-1).alias("to"), F.lit(0).alias("most"))
        return F.aggregate(F.slice("all", first["at"] + 1, F.col("most").cast("int")), none, step, lambda s: F.struct(first["at"].alias("from"), s.to.alias("to"), s.most.alias("both"), s.dice.alias("dice")))

    got = laid.select("id", "mark", "notice", "license", F.explode(F.transform(F.filter("all", lambda x: x.hit), best_end)).alias("x")).filter(F.col("x.dice") >= dice)
    return got.groupBy("id", "mark", "notice", "license", "x.to").agg(F.max(F.struct("x.dice", "x.from", "x.both")).alias("y")).select("id", "mark", "y.from", "to", "license", "y.both", "y.dice")


def license_scan(docs: DataFrame, notices: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", dice: float = DICE) -> DataFrame:
    """One row per document and licence found: id, mark (hash of the text), license, passages (how many), dice (the best).
    A passage counts for the licence that it is most like.

    Passages are lines, and windows of words across lines where these share more with a template (wrapped notices, notices
    within prose, whole licence bodies); they don't overlap. Lines are compared with each template whose number of
    distinct bigrams allows the coefficient to be reached: 2 * common / (a + b) >= dice needs dice / (2 - dice) <= a / b <=
    (2 - dice) / dice, so most lines are dropped before their bigrams are dealt out. Templates of one word fit lines only. Null and empty texts, and lines without words, match nothing. Repeated rows count as one
    document with that id and text; null ids are kept. Templates with a null name or without words are left out.
    """
    notices = templates(docs.sparkSession) if notices is None else notices
    whole = F.col("whole") if "whole" in notices.columns else F.lit(False)
    known = notices.filter("license is not null").select("license", normal_words(F.col("notice")).alias("w"), whole.alias("whole")).filter("size(w) > 0").distinct()
    known = stage(known.select("license", "whole", F.size("w").alias("n_words"), _grams(F.col("w")).alias("grams")).withColumn("n_there", F.size("grams")).withColumn("notice", F.xxhash64("license", "grams")).dropDuplicates(["notice"]), "licence-templates")
    lone = known.filter("not whole")
    sizes = sorted(r[0] for r in lone.select("n_there").distinct().collect())  # as many as templates have lengths
    # sizes of passages that some template allows, as few ranges
    ranges: list[list[float]] = []
    for n in sizes:
        low, high = n * dice / (2 - dice), n * (2 - dice) / dice
        if ranges and low <= ranges[-1][1] + 1:
            ranges[-1][1] = max(high, ranges[-1][1])
        else:
            ranges.append([low, high])
    # made inside the generator, so that the filters behind it read results and don't work them out again
    lined = F.transform(F.split(text_col, r"[\r\n]+", -1), normal_words)
    made = F.transform(lined, lambda w: F.struct(F.size(w).alias("n_words"), _grams(w).alias("grams")))
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.posexplode_outer(made).alias("line", "x")).select("id", "mark", "line", "x.n_words", "x.grams")
    fits = F.lit(False)
    for low, high in ranges:
        fits = fits | F.size("grams").between(low, high)
    each = lines.filter(fits).select("id", "mark", "line", "n_words", F.size("grams").alias("n_here"), F.explode_outer("grams").alias("gram"))
    side = lone.select("license", "notice", "n_there", F.explode("grams").alias("gram"))
    side = F.broadcast(side) if side.count() <= BROADCAST_BIGRAMS else side
    near = each.join(side, "gram").filter(F.col("n_here").between(F.col("n_there") * dice / (2 - dice), F.col("n_there") * (2 - dice) / dice))
    common = near.groupBy("id", "mark", "line", "n_words", "notice", "license", "n_here", "n_there").agg(F.count_distinct("gram").alias("both"))
    scored = common.withColumn("dice", 2 * F.col("both") / (F.col("n_here") + F.col("n_there"))).filter(F.col("dice") >= dice)
    # a line is what it is most like; equally like licences all stay
    best = scored.groupBy("id", "mark", "line", "n_words").agg(F.max("dice").alias("dice"), F.max_by("both", "dice").cast("int").alias("both"), F.collect_set(F.struct("dice", "license")).alias("all"))
    best = stage(best.select("id", "mark", "line", "n_words", "dice", "both", F.transform(F.filter("all", lambda x: x.dice == F.col("dice")), lambda x: x.license).alias("licenses")), "licence-lines")
    # where lines stand in the whole text, by bigrams: for the few that are notices
    some = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("m"), F.col(text_col)).join(best.select("id", "mark").distinct(), F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left_semi").dropDuplicates(["i", "m"])
    starts = some.select("i", "m", F.transform(lined, F.size).alias("n"))
    at = F.aggregate(F.slice("n", 1, F.col("line")), F.lit(0), lambda a, x: a + x)
    alone = best.join(starts, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))).select("id", "mark", "both", F.lit(1).alias("alone"), "dice", at.alias("from"), (at + F.greatest(F.col("n_words") - 2, F.lit(0))).alias("to"), "licenses")
    spans = _windows(docs, known, id_col, text_col, dice).groupBy("id", "mark", "from", "to").agg(F.max("dice").alias("dice"), F.max_by("both", "dice").cast("int").alias("both"), F.collect_set(F.struct("dice", "license")).alias("all"))
    spans = spans.select("id", "mark", "both", F.lit(0).alias("alone"), "dice", "from", "to", F.transform(F.filter("all", lambda x: x.dice == F.col("dice")), lambda x: x.license).alias("licenses"))
    # what shares the most bigrams with a template takes its place first, whole lines before windows; what overlaps it goes
    ranked = alone.unionByName(spans).groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("both", "alone", "dice", "from", "to", "licenses")), asc=False).alias("all"))
    kind = ranked.schema["all"].dataType.simpleString()
    taken = F.aggregate("all", F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda y: (y["from"] <= x.to) & (x["from"] <= y.to)), kept).otherwise(F.concat(kept, F.array(x))))
    named = ranked.select("id", "mark", F.explode(taken).alias("x")).select("id", "mark", "x.from", "x.dice", F.explode("x.licenses").alias("license"))
    return named.groupBy("id", "mark", "license").agg(F.count_distinct("from").alias("passages"), F.max("dice").alias("dice")).withColumnRenamed("id", id_col)


def license_report(docs: DataFrame, notices: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", dice: float = DICE) -> DataFrame:
    """One row per document: id, n_licenses, licenses (sorted, comma-joined), n_passages, best (rounded to six places; 0 if none)."""
    found = license_scan(docs, notices, id_col, text_col, dice).groupBy(F.col(id_col).alias("i"), "mark").agg(
        F.count("*").alias("n_licenses"), F.array_join(F.array_sort(F.collect_list("license")), ",").alias("licenses"), F.sum("passages").alias("n_passages"), F.max("dice").alias("best")
    )
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("fp") == F.col("mark")), "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_licenses", zero).alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_passages", zero).alias("n_passages"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"))
