"""Functions, extraction, selection, sync and streaming on small cases."""

from pyspark.sql import functions as F

from wikiloom.functions import text as T
from wikiloom.operators import authoring, docs, graph, links, markup, references, retrieve, search, sync, usage, web
from wikiloom.streaming import pull


def values(spark, f, *inputs):
    rows = [(i, x) for i, x in enumerate(inputs)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_titles(spark):
    assert values(spark, T.canonical_title, "image:a_b", "Main page", "category: X ", "Foo:bar", "É:x") == ["File:a b", "Main page", "Category:X", "Foo:bar", "É:x"]
    assert values(spark, T.title_key, "order 1", "template:foo bar", None) == ["Order 1", "Template:Foo bar", None]
    assert values(spark, T.variant_language, "X/pt-br", "X/ko", "API:Edit/qqq", "X/doc", "X/bar", "X", "Page/PT-BR", "X/zh-12", "X/zh-1a", "/ko", "X/Y/ko ") == ["pt-br", "ko", "qqq", None, None, None, "pt-br", None, "zh-1a", None, "ko"]
    assert values(spark, T.template_title, "cite_web", ":Template:Foo", "#if:x", "User:X", " ") == ["Template:cite web", "Template:Foo", None, None, None]


def test_text(spark):
    assert values(spark, T.normal_spaces, "a  b\n", None) == ["a b", None]
    assert values(spark, T.ascii_lower, "ÉA", "AB") == ["Éa", "ab"]
    assert len(set(values(spark, T.sync_hash, "a\nb", "a\r\nb", "a\nb\n"))) == 1
    assert values(spark, T.redirect_target, "#redirect [[Category:Bar]]", "text #REDIRECT [[x]]") == ["Category:Bar", None]
    assert values(spark, T.count_words, "", " a  b ") == [0, 2]
    assert values(spark, lambda c: T.snippet(c, F.lit("NEEDLE"), 3, 3), "aaaa needle bbbb", "none") == ["...aa needle bb...", "none"]
    assert values(spark, lambda c: T.identifier(F.lit("doi"), c), "https://doi.org/10.1/AB c") == ["10.1/abc"]
    assert values(spark, T.domain, "https://www.Site.org:80/x", "no") == ["site.org", None]
    assert values(spark, T.query_terms, "Template:Foo foo barbaz") == [["Template:Foo foo barbaz", "Foo foo barbaz", "Template:Foo", "barbaz"]]


def test_times(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z", "2024-01-01T00:00:30Z"), ("2024-01-01T00:00:00Z", "2024-01-01T00:00:31Z"), ("?", "2024-01-01T00:00:31Z")], "a string, b string")
    assert [r[0] for r in rows.select(T.times_match(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_wikitext(spark):
    text = "Lead {{A|x|k=[[p|q]]|{{B}}}} [[T#f|l]] [[:Category:C]] [[Category:D]] <nowiki>[[no]]</nowiki> <!-- [[no]] -->\n== H ==\nbody<ref name='r'/>\n=== Sub ===\nmore {{#if:x}} {{#invoke:M|f|1}}"
    pages = spark.createDataFrame([("P", text), ("N", None), ("E", "")], "title string, text string")
    assert [(r.heading, r.level) for r in markup.sections(pages).orderBy("place").collect()] == [(None, 1), ("H", 2), ("Sub", 3)]
    assert {(r.target, r.is_category) for r in markup.wikilinks(pages).collect()} == {("T", False), ("Category:C", False), ("Category:D", True), ("p", False)}
    assert {(r.template, tuple(r["keys"])) for r in markup.template_calls(pages).collect()} == {("Template:B", ()), ("Template:A", ("$1", "$2", "k"))}
    assert [(r.module, r.function) for r in markup.module_calls(pages).collect()] == [("Module:M", "f")]
    assert [(r["name"], r.body, r.heading) for r in references.tags(pages).collect()] == [("r", "", "H")]


def test_web_text(spark):
    html = "<html lang='en'><head><title>A &amp; B</title><meta property='og:description' content='d'></head><body><nav>no</nav><article><h1>A</h1><p>one&nbsp;two<script>x</script></p><p>three <b>four</b></p></article></body>"
    pages = spark.createDataFrame([(1, "https://www.x.org/a/b?c", html), (2, "http://y.org", ""), (3, None, None)], "page_id int, url string, html string")
    got = {r.page_id: r for r in web.page_text(pages).collect()}
    assert got[1].text == "A\none two\nthree four" and got[1].quality == "poor" and got[2].text == ""
    told = {r.page_id: r for r in web.metadata(pages).collect()}
    assert (told[1].title, told[1].description, told[1].domain) == ("A & B", "d", "x.org")
    edges = spark.createDataFrame([("http://a.org/1", "http://a.org/2"), ("http://a.org/2", "http://a.org/1"), ("http://a.org/2", "http://b.org/3")], "source string, target string")
    seeds = spark.createDataFrame([("http://a.org/1",)], "url string")
    assert {(r.url, r.depth) for r in web.crawl_frontier(seeds, edges, 3).collect()} == {("http://a.org/1", 0), ("http://a.org/2", 1)}


def test_chunks_pack_paragraphs(spark):
    text = "\n\n".join(" ".join(["w"] * n) for n in (40, 50, 10, 200, 5))
    got = retrieve.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")).orderBy("place").collect()
    assert [len(r.text.split()) for r in got] == [90, 10, 96, 96, 8, 5]


def test_selection_skips_and_stops(spark):
    rows = [(1, "p", 0, 9, 100, 1, "alpha beta gamma"), (1, "p", 1, 8, 500, 2, "too long here"), (1, "q", 0, 7, 50, 3, "alpha beta gamma"), (1, "q", 1, 6, 50, 4, "other words now"), (1, "p", 2, 5, 50, 5, "last one standing")]
    got = retrieve.selected(spark.createDataFrame(rows, "query int, page string, place int, score long, tokens long, turn int, text string"), 5, 200, 2).orderBy("chosen").collect()
    assert [(r.page, r.place) for r in got] == [("p", 0), ("q", 1), ("p", 2)]


def test_tiers_and_phrases(spark):
    posts = search.postings(spark.createDataFrame([(1, "new york city"), (2, "york new")], "doc_id int, text string"), "doc_id", {"text": 1.0})
    asked = spark.createDataFrame([(0, "new", 0), (0, "york", 1)], "query int, term string, ord int")
    assert [r["row"] for r in search.match_phrase(asked, posts).collect()] == [1]
    assert sorted(r["row"] for r in search.match_prefix(asked, posts).collect()) == [1, 2]
    a, b = spark.createDataFrame([(1, "x")], "query int, row string"), spark.createDataFrame([(1, "y"), (2, "z")], "query int, row string")
    assert sorted(tuple(r) for r in search.first_tier(a, b).collect()) == [(1, "x"), (2, "z")]


def test_components(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C"), ("D", "D"), ("C", "E"), ("E", "F"), ("F", "C")], "source string, target string")
    found = graph.components(edges)
    assert {(r.node, r.component, r.is_cyclic) for r in found.collect()} == {("A", "A", True), ("B", "A", True), ("C", "C", True), ("E", "C", True), ("F", "C", True), ("D", "D", True)}
    assert {(r.component, r.n_in, r.n_out) for r in graph.condensation(edges, found).collect()} == {("A", 0, 1), ("C", 1, 0), ("D", 0, 0)}


def test_chains_of_cycles_end(spark):
    """Each cycle leads to the next, and the least names stand upstream."""
    edges = []
    for k in range(12):
        a, b = f"n{10 + k}a", f"n{10 + k}b"
        edges += [(a, b), (b, a)] + ([(f"n{9 + k}b", a)] if k else [])
    found = graph.components(spark.createDataFrame(edges, "source string, target string")).collect()
    assert len(found) == 24 and all(r.size == 2 and r.is_cyclic and r.component == r.node[:3] + "a" for r in found)


def test_calls_nest_without_bound(spark):
    text = "".join(f"{{{{T{k}|" for k in range(30)) + "x" + "}}" * 30
    got = markup.template_calls(spark.createDataFrame([("P", text)], "title string, text string")).collect()
    assert {r.template for r in got} == {f"Template:T{k}" for k in range(30)}


def test_citations(spark):
    text = """Lead<ref name='n1'>{{Cite web|url=https://www.Site1.example/x|title=[[T|Title]] one|last=Doe|first=Ann|archive-url=//zz.example/a|quote=q|doi=https://doi.org/10.5/AB}}</ref>
== H ==
again<ref name=n1 /> <ref group="g">plain note</ref> <ref>[https://youtube.com/w clip]</ref> <ref>{{note}}{{sfn|Doe|1999}}</ref> <!-- <ref>no</ref> --> <references />"""
    got = references.references(spark.createDataFrame([("P", text), ("N", None), ("E", "")], "title string, text string"), first_party=["site1.example"]).orderBy("place").collect()
    assert [(r.heading, r.source_type, r.origin, r.template) for r in got] == [(None, "web", "first-party", "Template:Cite web"), ("H", "note", "unknown", None), ("H", "other", "unknown", None), ("H", "video", "external", None), ("H", "short-footnote", "unknown", "Template:sfn")]
    assert (got[0].ref_title, got[0].author, got[0].ids, got[0].profile) == ("Title one", "Doe, Ann", ["doi:10.5/ab"], "first-party web / site1.example")
    assert {"first-party", "has-archive", "has-quote", "identifier:archive-url"} <= set(got[0].signals) and got[0].urls == ["https://www.Site1.example/x", "https://zz.example/a"]
    assert got[1].authority_kind == "named-reference" and "reused-reference" in got[1].signals and got[3].summary == "clip" and got[4].family == "Template:sfn"


def test_passages_for_readers(spark):
    rows = [(1, "A", "Main", None, "{{Info|a={{b}}}} [[File:x.png|thumb|[[a]] b]] one two three four five"), (2, "A/ko", "Main", None, "one two three four five six"), (3, "A", "Main", "See also", "one two three four five six"), (4, "A", "Main", "H", "#REDIRECT [[B]]"), (5, "T", "Template", None, "one two three four five six"), (6, "A", "Main", "H", "{{Info|a}} one two")]
    got = retrieve.for_audience(spark.createDataFrame([(*r, 9) for r in rows], "id int, title string, namespace string, heading string, text string, tokens long")).collect()
    assert [(r.id, r.text) for r in got] == [(1, "one two three four five")]


def test_containment_is_a_hash_join(spark):
    rows, asked = spark.createDataFrame([("abcabc",), ("xbc",), ("a",), ("",)], "t string"), spark.createDataFrame([(1, "bca"), (2, "bc"), (3, "a"), (4, ""), (5, "zzz")], "query int, q string")
    got = search.containing(rows, F.col("t"), asked, F.col("q"))
    assert sorted((r.query, r.t) for r in got.collect()) == [(1, "abcabc"), (2, "abcabc"), (2, "xbc"), (3, "a"), (3, "abcabc")]
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_deletes_and_readiness(spark):
    pages, gone = spark.createDataFrame([("A",), ("B",)], "title string"), spark.createDataFrame([("B",)], "title string")
    left = links.without_pages({"pages": pages, "links": spark.createDataFrame([("A", "B"), ("B", "A")], "source string, target string")}, gone, {"pages": "title", "links": "source"})
    assert [r.title for r in left["pages"].collect()] == ["A"] and [r.source for r in left["links"].collect()] == ["A"]
    art = spark.createDataFrame([("index",)], "kind string")
    assert tuple(links.readiness({"pages": pages}, art, ["index", "docs"]).first()) == ("degraded", "docs", "")
    assert links.readiness({"pages": pages.limit(0)}, art, ["index"]).first().status == "empty"
    asked = spark.createDataFrame([(1, "b")], "query int, text string")
    assert [r.title for r in links.page_by_title(pages, asked).collect()] == ["B"]


def test_manifest_and_docs(spark):
    base, over = spark.createDataFrame([("Foo", "1"), ("Bar", None)], "name string, version string"), spark.createDataFrame([("FOO ", "2"), ("foo", None), ("Baz", "3")], "name string, version string")
    assert {(r.key, r.version) for r in usage.manifest_merge(base, over.filter("name <> 'FOO '")).collect()} == {("foo", "1"), ("bar", None), ("baz", "3")}
    pages = spark.createDataFrame([("corpus:a", "tech", "P"), ("b", "ext", "Q")], "corpus string, kind string, page string")
    assert [docs.without(pages, k).count() for k in ("tech", "a", "Q", "zzz")] == [1, 1, 1, 2]
    corpora = spark.createDataFrame([("p1", "pr", "profile", 1), ("e1", "pr", "extension", 1), ("e2", "other", "extension", 1), ("e3", "x", "extension", 99)], "corpus string, profile string, kind string, expires int")
    assert sorted(r.corpus for r in docs.outdated(corpora, 5).collect()) == ["e2", "p1"]


def test_sync_paths_and_upserts(spark):
    pages = spark.createDataFrame([(1, "Ab", "main/Ab.wiki"), (2, "AB", "main/AB.wiki"), (3, "C", "main/C.wiki")], "ord int, title string, path string")
    got = {r.title: r.path for r in sync.chosen_paths(pages, spark.createDataFrame([("main/AB.wiki",)], "path string")).collect()}
    assert got == {"AB": "main/AB.wiki", "Ab": "main/Ab~4162.wiki", "C": "main/C.wiki"}
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "key string, v int"), spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "key string, v int")
    assert sorted(tuple(r) for r in sync.upsert(old, new).collect()) == [("a", 1), ("b", 3), ("c", 1)]
    told = sync.content_diffs(spark.createDataFrame([("x", None, "a"), ("y", "a", "a"), ("z", "a", "b")], "title string, before string, after string"))
    assert [r.status for r in told.orderBy("title").collect()] == ["missing_baseline", "same", "changed"]


def test_incremental_ingestion(spark, tmp_path):
    schema = "title string, changed_at long, hash string"
    args = (str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"), "title", "changed_at")
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 1, "x")], schema).write.parquet(args[0])
    assert sorted(tuple(r) for r in pull.ingest(spark, *args).select("title", "changed_at", "hash").collect()) == [("a", 3, "z"), ("b", 1, "x")]
    spark.createDataFrame([("a", 2, "old"), ("c", 5, "n")], schema).write.mode("append").parquet(args[0])
    assert sorted(tuple(r) for r in pull.ingest(spark, *args).select("title", "changed_at", "hash").collect()) == [("a", 3, "z"), ("b", 1, "x"), ("c", 5, "n")]
    assert pull.ingest(spark, *args).count() == 3


def test_budget_prefix_always_takes_the_first(spark):
    rows = spark.createDataFrame([("p", 1, 100), ("p", 2, 1), ("q", 1, 5), ("q", 2, 5), ("q", 3, 5)], "title string, at int, tokens long")
    got = links.within_budget(rows, ["title"], [F.asc("at")], "tokens", 10, 5)
    assert sorted((r.title, r["at"]) for r in got.collect()) == [("p", 1), ("q", 1), ("q", 2)]


def test_edges_of_contracts(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r")], "source string, target string, relation string")
    assert sorted(r.source for r in authoring.touching_edges(edges, spark.createDataFrame([("b",)], "key string")).collect()) == ["a", "b"]
