"""What queries shuffle and repeat: it is to grow with the rows, not with rows times queries."""

import glob
import os
import random

import pytest

from wikiloom import registry
from wikiloom.functions import text as T
from wikiloom.operators import fixes, page_passages, search


def stages(spark):
    jvm = spark.sparkContext._jvm
    found = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}


def shuffled(spark, f):
    """Records and bytes that f shuffles."""
    before = stages(spark)
    f()
    new = [s for k, s in stages(spark).items() if k not in before]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new)


def size(sf, *tables):
    return sum(os.path.getsize(x) for t in tables for x in (glob.glob(f"{sf}/{t}.parquet/*.parquet") or [f"{sf}/{t}.parquet"]))


def run(spark, sf, name):
    return lambda: registry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name,most", [("e12_contract_tokens", 4), ("e3_bm25", 4), ("j1_docs_search", 4), ("e2_phrase_match", 0.5), ("f11_retrieval", 15)])
def test_searches_shuffle_texts_once(spark, sf, name, most):
    """At this size most of what f11_retrieval shuffles are the passages that its queries rerank."""
    assert shuffled(spark, run(spark, sf, name))[1] < most * size(sf, "documents", "conversations")


@pytest.mark.parametrize("name,most", [("e2_prefix_match", 4), ("e5_pages_by_hits", 12)])
def test_shared_beginnings_make_no_pairs(spark, sf, name, most):
    """All parts and all queries share the word `brand`."""
    rows = spark.read.parquet(f"{sf}/part.parquet")
    asked = rows.selectExpr("substr(p_type, 1, 4)", "p_brand").distinct().count()
    assert shuffled(spark, run(spark, sf, name))[0] < most * rows.count() + 12 * asked


def test_best_rows_against_plain_python(spark):
    """Ties by use and by row, equal queries, terms that no row holds, null and empty texts, two fields."""
    import math

    r = random.Random(7)
    rows = [(k, " ".join(r.choice("abcdef") for _ in range(r.randrange(1, 6))), r.choice(["A b", "", None])) for k in range(60)] + [(60, None, None), (61, " ", ""), (62, "Ä ä", None)]
    asked = {1: ["a", "b"], 2: ["b", "a"], 3: ["f"], 4: ["zz"], 5: ["ä", "zz", "c"]}
    uses = {k: k % 3 for k in range(50)}
    words = lambda x: (x or "").lower().split()
    held = {k: [(w, 1.0) for w in words(t)] + [(w, 2.5) for w in words(u)] for k, t, u in rows}
    held = {k: x for k, x in held.items() if x}
    mean, want = sum(map(len, held.values())) / len(held), set()
    for q, terms in asked.items():
        scores = {}
        for t in set(terms):
            df = sum(any(w == t for w, _ in x) for x in held.values())
            for k, x in held.items():
                tf = sum(f for w, f in x if w == t)
                if tf:
                    part = math.log((len(held) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
                    scores[k] = (scores.get(k, (0, 0))[0] + part, scores.get(k, (0, 0))[1] + 1)
        order = sorted(scores, key=lambda k: (-round(scores[k][0], 6), -uses.get(k, 0), k))
        want |= {(q, k, i + 1, scores[k][1]) for i, k in enumerate(order[:7])}
    got = search.ranked(spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query int, term string"), spark.createDataFrame(rows, "k int, t string, u string"), "k", {"t": 1.0, "u": 2.5}, 7, uses=spark.createDataFrame(list(uses.items()), "row int, uses int")).collect()
    assert {(x["query"], x.row, x["rank"], x.n_terms) for x in got} == want


def test_phrases_and_beginnings_where_rows_lie(spark):
    rows = search.said(spark.createDataFrame([(1, "Alpha beta, gamma"), (2, "beta alpha"), (2, "gamut"), (3, None), (4, ""), (None, "alpha Beta")], "id int, t string"), "id", search.F.col("t"))
    asked = [(1, "alpha", 0), (1, "beta", 1), (2, "al", 0), (2, "gam", 1), (3, "none", 0), (3, "alpha", 1), (4, "beta", 0), (4, "beta", 1)]
    asked = spark.createDataFrame(asked, "query int, term string, ord int")
    assert {(r["query"], r.row) for r in search.with_phrase(asked, rows).collect()} == {(1, 1), (1, None)}
    assert sorted((r["query"], r.row or 0) for r in search.with_prefixes(asked, rows).collect()) == [(1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (4, 0), (4, 1), (4, 2)]
    assert search.with_prefixes(asked.limit(0), rows).count() == search.with_phrase(asked.limit(0), rows).count() == 0


def test_edits_are_found_once(spark):
    found = fixes.edited(spark.createDataFrame([("A", "“x”"), ("B", None)], "title string, text string"), banner="Quality")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("regexp_replace")
    assert plan(fixes.edit_rows(found)) <= plan(found)
    assert sorted((r.title, r.start) for r in fixes.edit_rows(found).collect()) == [("A", 0), ("A", 0), ("A", 2), ("B", 0)]


def test_passages_of_an_index_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def cut(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(k % 7, k, f"word{k % 3} here", 3) for k in range(70)], "page int, place int, text string, tokens int")
    page_passages.write_index(rows.repartitionByRange("page").mapInArrow(cut, rows.schema), str(tmp_path / "index"), clustered=True)
    assert made.value == 70
    assert [r.place for r in page_passages.of_page(spark, str(tmp_path / "index"), 4, "Word1", 3, 80).orderBy("chosen").collect()] == [4, 25, 46]


def test_words_are_read_no_further_than_needed(spark):
    """Passages that say nothing, against plain counts of words and letters."""
    texts = ["", "a b c d e", "abcdefghij", "one two 3 -- four", "one two three four</ref>", "one two three four five</ref>", "a|b c}}</ref>", "{{[[||==]]}} ab cd", "#REDIRECT [[All the words that follow]]", "ñandú corre muy lejos hoy", "one\u00a0two\tthree words here x", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.is_noise(T.F.col("t")).alias("noise"), T.wordlike(T.F.col("t")).alias("n"), T.lexical_terms(T.F.col("t")).alias("terms")).orderBy("k").collect()
    assert [r.noise for r in got] == [True, True, True, False, True, False, True, True, True, False, False, True]
    assert [r.n for r in got] == [0, 5, 1, 4, 4, 5, 2, 2, 6, 5, 6, None]
    assert got[9].terms == ["and", "corre", "hoy", "lejos", "muy"] and got[10].terms == ["here", "one", "three", "two", "words"] and got[11].terms is None
