"""Artifacts, edits, contracts, robots, rules and packs on small hand-made inputs."""

import time

import pytest
from pyspark.sql import functions as F

from wikiloom import registry
from wikiloom.functions import text as T
from wikiloom.operators import artifacts, contracts, discovery, docs_search, fixes, markup, pack, page_passages, references, rules, surface, web
from wikiloom.plans import corpus

PAGES = [
    ("A", "Lead [[Beta|b]] and [[:Category:X]] in [[Category:Y]].<ref name=\"n\">{{Cite web|title=T|url=https://a.example}}</ref>\n== One ==\n{{Box|a={{In|1}}|b=2}} [[File:P.png|thumb|Cap]]\n=== Two ===\n<gallery>\nG.png|First\n</gallery>\ntext {{#invoke:M|f|x}}\n"),
    ("B", ""), ("C", None), ("D", "plain <!-- [[no]] --> <nowiki>{{no}}</nowiki> {{never closed [[x]]"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "title string, text string")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_a_bundle_gives_what_each_extraction_gives(spark):
    rows = pages(spark)
    bundle = artifacts.indexed(rows)
    for f in (markup.sections, markup.wikilinks, markup.calls, markup.template_calls, markup.module_calls, markup.media, references.references):
        assert same(f(bundle), f(rows)), f.__name__
    got = {r["title"]: r for r in artifacts.counts(bundle).collect()}
    assert tuple(got["A"])[1:] == (3, 4, 4, 2, 1) and tuple(got["B"])[1:] == (0, 0, 0, 0, 0) and tuple(got["C"])[1:] == (0, 0, 0, 0, 0)
    plan = artifacts.artifacts(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LocalTableScan") + plan.count("Scan") == 1 and "Exchange" not in plan
    one = artifacts.rows_of(bundle, "links")._jdf.queryExecution().executedPlan().toString()
    schema = one[one.index("ReadSchema") :]
    assert "links" in schema and "sections" not in schema and "calls" not in schema


def steps(df):
    """How many steps on text the optimized plan holds."""
    return df._jdf.queryExecution().optimizedPlan().numberedTreeString().count("regexp_")


def test_filters_on_citations_repeat_no_steps(spark):
    refs = references.references(pages(spark))
    assert 0 < steps(references.identifiers(refs)) <= steps(refs) + 1  # its own
    assert references.identifiers(refs).count() == 0 and refs.filter("domain = 'a.example'").count() == 1


def test_sources_by_domain_repeat_no_steps(spark):
    refs = references.references(pages(spark))
    told = spark.createDataFrame([("G", "unreliable_source", "www.A.example", "A"), ("G", "unreliable_source", "example", "All")], "doc string, kind string, key string, value string")
    got = rules.source_uses(refs, told)
    assert steps(got) < 2 * steps(refs)
    assert sorted((r["page"], r["key"], r["match"]) for r in got.collect()) == [("A", "example", "below"), ("A", "www.A.example", "exact")]


def test_extractions_are_made_once(spark):
    bundle = artifacts.artifacts(pages(spark), kinds=("refs",))
    each = artifacts.rows_of(bundle, "refs")
    found = [d._jdf.queryExecution().optimizedPlan().numberedTreeString().count("regexp_extract_all") for d in (bundle, each)]
    assert found == [1, 1]  # no filter that makes the citations anew
    assert [(r["title"], r["place"]) for r in each.collect()] == [("A", 0)]  # none of an empty or null text


def test_citations_work_out_what_is_asked(spark):
    every = references.references(pages(spark))
    some = references.references(pages(spark), columns=["page", "place", "domain"])
    assert same(some, every.select("page", "place", "domain")) and 0 < 2 * steps(some) < steps(every)
    assert steps(registry.queries()["k7_source_uses"](spark, "/root/testdata/sf0.001")) < steps(every)


def test_rules_of_some_kinds(spark):
    guide = '## VI. Unreliable sources\n- A Blog — why\n## Citations\n{{Cite web|url=}}\n**Never use:**\n- "rich"\nNever output Markdown, or == References ==.\n'
    guides = spark.createDataFrame([("g", guide)], "doc string, text string")
    every = rules.guide_rules(guides)
    assert sorted(r["kind"] for r in every.collect()) == ["banned_phrase", "citation_template", "setting", "setting", "unreliable_source"]
    for kinds in (("unreliable_source",), ("setting", "banned_phrase")):
        assert same(rules.guide_rules(guides, kinds), every.filter(F.col("kind").isin(*kinds)))


def test_articles_of_one_small_file_are_dealt_out(spark):
    made = corpus.frame(spark, "/root/testdata/sf0.01", "articles")
    assert made.rdd.getNumPartitions() >= 4 and made.select("title").distinct().count() == 2000
    assert corpus.frame(spark, "/root/testdata/sf0.001", "articles").rdd.getNumPartitions() == 1


def test_long_texts_take_time_in_proportion(spark):
    def took(f):
        f()
        best = []
        for _ in range(2):
            t = time.perf_counter()
            f()
            best.append(time.perf_counter() - t)
        return min(best)

    lint = lambda n: took(lambda: markup.lint(pages(spark, [("L", "\n".join(f"== Heading {i} ==\nsome text here" for i in range(n)))])).count())
    assert lint(8000) < 3 * lint(4000) + 1
    open_ = lambda n: took(lambda: spark.createDataFrame([("{{ open " * n,)], "t string").select(F.size(T.inner_calls(F.col("t"))), F.length(T.without_calls(F.col("t")))).collect())
    assert open_(16_000) < 3 * open_(8_000) + 1


def fixed(spark, text, **how):
    return fixes.applied(fixes.edited(pages(spark, [("P", text)]), **how)).first()


def test_fixes_of_one_article(spark):
    r = fixed(spark, "{{SHORTDESC:Alpha}}\n\n'''Alpha''' is a page.\n\n== References ==\n{{Reflist}}\n", banner="Article quality")
    assert r["text"].startswith("{{SHORTDESC:Alpha}}\n{{Article quality|unverified}}\n") and r["status"] == "applied" and r["n_edits"] == 1
    for state in ("wip", "verified"):
        text = "{{SHORTDESC:Alpha}}\n{{Article quality|%s}}\n\ntext\n" % state
        assert tuple(fixed(spark, text, banner="Article quality"))[1:] == (text, False, 0, "unchanged")
    assert fixed(spark, "a page.<ref>x</ref>\n\n== References ==\n[[Category:I]]\n")["text"].endswith("== References ==\n{{Reflist}}\n[[Category:I]]\n")
    assert fixed(spark, "== References ==")["text"] == "== References ==\n{{Reflist}}\n"
    assert fixed(spark, "== References ==\n=== Notes ===\n{{Reflist|2}}\n== See also ==\n")["status"] == "unchanged"
    assert fixed(spark, "page<ref>{{Cite web|title=S}}</ref><ref name=a /> <ref>b</ref>. Next<ref>c</ref>!")["text"] == "page.<ref>{{Cite web|title=S}}</ref><ref name=a /> <ref>b</ref> Next!<ref>c</ref>"
    assert fixed(spark, "# item\n## Head\n##no\n  ## no\n== Early Life ==\n=== SEE ALSO ===\n== Odd Name ==\n")["text"] == "# item\n== Head ==\n##no\n  ## no\n== Early life ==\n=== See also ===\n== Odd Name ==\n"
    assert fixed(spark, "é“x” ‘y’ \U0001f600“")["text"] == "é\"x\" 'y' \U0001f600\""
    r = fixed(spark, "## “Head”")
    assert r["status"] == "overlap" and r["text"] == "## “Head”" and not r["fixed"]
    assert fixed(spark, None)["text"] is None and fixed(spark, "")["status"] == "unchanged"


def test_edits_given_as_rows(spark):
    rows = pages(spark, [("A", "abcdef"), ("B", "abc"), ("C", "abc"), ("D", "abc")])
    edits = spark.createDataFrame([("A", 2, 4, "X", "r"), ("A", 0, 0, ">", "r"), ("A", 4, 4, "Y", "r"), ("A", 4, 4, "Z", "r"), ("B", 0, 2, "", "r"), ("B", 1, 3, "", "r"), ("C", 2, 9, "", "r")], "title string, start int, end int, replacement string, rule string")
    got = {r["title"]: tuple(r)[1:] for r in fixes.applied(fixes.gathered(rows, edits)).collect()}
    assert got == {"A": (">abXYZef", True, 4, "applied"), "B": ("abc", False, 2, "overlap"), "C": ("abc", False, 1, "invalid"), "D": ("abc", False, 0, "unchanged")}


def test_banner_in_the_first_lines(spark):
    rows = pages(spark, [("near", "\n\n" + "x" * 3000 + "\n {{Article quality|wip}}\n"), ("far", "\n".join(["line"] * 8) + "\n{{Article quality|wip}}")])
    got = {r["title"] for r in markup.lint(rows, banner="Article quality").filter("rule = 'structure.require_article_quality_banner'").collect()}
    assert got == {"far"}


def test_robots_and_sitemaps(spark):
    text = "Disallow: /before\n\nUser-agent: A\nUser-agent: b\n# note\nDisallow: /x\nAllow: /x/y.z+\nDisallow: /*.pdf$\nCrawl-delay: 3\nAllow: /x\nUser-agent: *\nDisallow: /\nContent-Signal: search=yes, ai-train=no\nSitemap: https://h.example/s.xml\nSitemap: /not-full"
    files = spark.createDataFrame([("https://h.example/robots.txt", text), ("https://e.example/robots.txt", "")], "url string, text string")
    said = discovery.robots_rules(files)
    assert sorted((r["agent"], r["allow"], r["pattern"]) for r in said.collect()) == sorted([(a, k, p) for a in "ab" for k, p in ((False, "/x"), (True, "/x/y.z+"), (False, "/*.pdf$"), (True, "/x"))] + [("*", False, "/")])
    assert [(r["key"], r["value"]) for r in discovery.content_signals(files).orderBy("key").collect()] == [("ai-train", "no"), ("search", "yes")]
    assert [r["sitemap"] for r in discovery.declared_sitemaps(files).collect()] == ["https://h.example/s.xml"]
    asked = [("https://H.example/x/1", "A", True, "/x"), ("https://h.example/x/y.z+q", "B", True, "/x/y.z+"), ("https://h.example/x/yaz", "b", True, "/x"), ("https://h.example/q.pdf", "a", False, "/*.pdf$"), ("https://h.example/q.pdf?v", "a", True, None), ("https://h.example", "other", False, "/"), ("https://e.example/x", "a", True, None)]
    got = discovery.allowed(spark.createDataFrame([x[:2] for x in asked], "url string, agent string"), said)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, asked))
    maps = [("r", "<sitemapindex><sitemap><loc>r</loc></sitemap><sitemap><loc>s</loc></sitemap><sitemap><loc>gone</loc></sitemap></sitemapindex>"), ("s", "<urlset><url><loc> p?a=1&amp;b=2 </loc></url><url><loc></loc></url><url><LOC>q</LOC></url></urlset>"), ("t", "no tags")]
    files = spark.createDataFrame(maps, "url string, text string")
    got = discovery.sitemap_frontier(spark.createDataFrame([("r",), ("t",)], "url string"), files, 6).collect()
    assert sorted(map(tuple, got)) == [("p?a=1&b=2", "r", 2), ("q", "r", 2)]


def test_challenges_and_shells(spark):
    html = ["<body>captcha</body>", "Access DENIED by Captcha", "x __cf_chl_ y", '<div id="app"></div>', '<div id="app"></div><script src="/_next/static/a.js">', "essay", '<div id="challenge-container"></div>access denied']
    got = [tuple(r)[1:] for r in web.access(spark.createDataFrame(list(enumerate(html)), "page_id int, html string")).orderBy("page_id").collect()]
    assert got == [("content", None), ("challenge", None), ("challenge", "cloudflare"), ("content", None), ("app_shell", None), ("content", None), ("challenge", None)]


def test_phrases_and_sources(spark):
    guide = 'x\n**Never use:**\n- "It  stands"  and "rich"\n### Else\n- "no"\n## VI. Unreliable sources\n- Daily Post (www.daily.example) — why\n- A Blog — why\n'
    found = rules.guide_rules(spark.createDataFrame([("g", guide)], "doc string, text string"))
    assert sorted((r["kind"], r["key"]) for r in found.collect()) == [("banned_phrase", "It stands"), ("banned_phrase", "rich"), ("unreliable_source", "a blog"), ("unreliable_source", "www.daily.example")]
    texts = pages(spark, [("P", "it STANDS, it stands. Enrich it; rich"), ("Q", "stands it"), ("R", None)])
    assert sorted(map(tuple, rules.phrase_uses(texts, found).collect())) == [("P", "banned_phrase", "It stands", 2), ("P", "banned_phrase", "rich", 1)]
    refs = spark.createDataFrame([("P", 0, "daily.example"), ("P", 1, "m.daily.example"), ("P", 2, "notdaily.example"), ("P", 3, ""), ("P", 4, None)], "page string, place int, domain string")
    assert sorted(map(tuple, rules.source_uses(refs, found).select("place", "match").collect())) == [(0, "exact"), (1, "below")]


@pytest.mark.parametrize("budget", [0, 7, 30, 1000])
def test_a_pack_keeps_its_budget(spark, budget):
    import random

    r = random.Random(9)
    lanes = [(q, lane, k, f"{lane}{k}", r.randrange(12)) for q in range(4) for lane, most in pack.LIMITS.items() for k in range(1, r.randrange(1, most + 1))]
    made = pack.packed(spark.createDataFrame(lanes, "query int, lane string, rank int, item string, tokens long"), budget)
    got = sorted((x["query"], x["turn"], x["item"], x["kept"], x["used"]) for x in made.collect())
    want = []
    for q in range(4):
        mine = sorted((x for x in lanes if x[0] == q), key=lambda x: (x[2] > 1, list(pack.LIMITS).index(x[1]), x[2]))
        used = 0
        for turn, x in enumerate(mine, 1):
            kept = used + x[4] <= budget
            used += x[4] * kept
            want.append((q, turn, x[3], kept, used))
    assert got == sorted(want)
    sums = pack.totals(made).collect()
    for q in {x[0] for x in want}:
        lane = [x for x in sums if x["query"] == q and x["lane"] != "all"]
        every = next(x for x in sums if x["query"] == q and x["lane"] == "all")
        assert every["tokens"] == sum(x["tokens"] for x in lane) <= budget and every["items"] == sum(x["items"] for x in lane)


def test_contract_plans(spark):
    rows = [("Template:Infobox_person", "infobox", "About people", 70, 9, ["Name", "born_on"], ["Module:Box"], [], []), ("Template:Quote", "text", None, 3, 2, ["text"], ["Module:Box", ""], ["P"], ["alias"]), ("Template:infobox person", "x", "", 0, 0, [], [], [], [])]
    catalog = spark.createDataFrame(rows, "title string, category string, summary string, uses int, pages int, parameters array<string>, modules array<string>, examples array<string>, more array<string>")
    calls = spark.createDataFrame([("P", "Module:box", "show"), ("Q", "Module:box", "show"), ("P", "Module:Lost", "x")], "page string, module string, function string")
    index, linked = contracts.nodes(catalog, calls), contracts.edges(catalog)
    by = {r["contract"]: r for r in index.collect()}
    assert set(by) == {"template:Template:Infobox person", "template:Template:Quote", "template:Template:infobox person", "module:Module:Box"}
    assert (by["module:Module:Box"]["uses"], by["module:Module:Box"]["pages"], by["module:Module:Box"]["functions"]) == (2, 2, ["show"])
    assert linked.count() == 2
    terms = spark.createDataFrame([(1, "Person"), (1, "nothing"), (2, "zzz"), (3, "show")], "query int, term string")
    lanes = spark.createDataFrame([(1, "stub_template", "Template:Quote", 3), (1, "module_pattern", "Template:Quote", 3), (2, "comparable_template", "Template:Lost", 100), (2, "stub_template", "Template:Other", 1)], "query int, lane string, title string, uses int")
    found = contracts.candidates(terms, lanes, index)
    got = {(r["query"], r["contract"]): (r["score"], list(r["reasons"])) for r in found.collect()}
    assert got[1, "template:Template:Infobox person"] == (210, ["title_match:150"]) and got[1, "template:Template:Quote"] == (523, ["stub_template:520"])
    assert got[2, "template:Template:Lost"] == (180, ["pack_template:120"]) and (2, "template:Template:Other") not in got and got[3, "module:Module:Box"][1] == ["function_match:48"]
    planned = contracts.plan(found, contracts.view(index), limit=2, budget=1)
    assert [(r["contract"], r["chosen"], r["reason"]) for r in planned.filter("query = 1").orderBy("place").collect()] == [("template:Template:Quote", True, ""), ("template:Template:Infobox person", False, "budget"), ("template:Template:infobox person", False, "budget"), ("module:Module:Box", False, "budget")]
    assert {(r["contract"], r["hops"]) for r in contracts.expanded(planned.filter("query = 1"), linked).collect()} == {("template:Template:Quote", 0), ("module:Module:Box", 1), ("template:Template:Infobox person", 2)}


def test_one_page_reads_its_own_part(spark, tmp_path):
    rows = spark.createDataFrame([(f"P{i % 20}", i, f"text {i} " + ("marker here" if i % 3 == 0 else "else"), 30) for i in range(200)], "page string, place int, text string, tokens int")
    path = f"file://{tmp_path}/index"
    page_passages.write_index(rows, path)
    got = page_passages.of_page(spark, path, "P4", "Marker", 3, 80)
    assert [(r["place"], r["chosen"]) for r in got.orderBy("place").collect()] == [(24, 1), (84, 2)]
    assert "EqualTo(page,P4)" in got._jdf.queryExecution().executedPlan().toString()
    assert page_passages.of_page(spark, path, "P4", "  ", 3, 80).count() == 0


def test_documentation_in_tiers(spark):
    manual = [("Manual:Hooks/OnSave", "Runs late. Sets $wgAlpha.\n== Use ==\nCall {{#if:x|y}} here.\n<pre>some code</pre>\n"), ("Extension:Box", "The alpha box.\n== Alpha ==\ntext\n")]
    tiers = docs_search.tiers_of(spark.createDataFrame(manual, "title string, text string"))
    asked = spark.createDataFrame([(1, "$wgAlpha"), (2, "alpha"), (3, "lpha bo"), (4, " "), (5, "some code")], "query int, text string")
    got = {}
    for r in docs_search.search(asked, tiers, 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["tier"], r["title"]))
    assert got[1][0] == ("symbol", "$wgAlpha") and got[2][0] == ("section", "Alpha") and ("page", "Extension:Box") in got[3] and 4 not in got and ("example", "") in got[5]
    drafts = spark.createDataFrame([("T", "{{#Cargo_query:x}} <tabber> <ref> {{#cargo_query:y}} <b>"), ("U", None)], "topic string, text string")
    used = spark.createDataFrame([("T", "Template:My_box", 0), ("T", "Template:Other", 1)], "topic string, template string, ord int")
    got = docs_search.draft_queries(drafts, used, None, ["tabber", "ref"]).orderBy("turn").collect()
    assert [r["text"] for r in got] == ["cargo_query parser function", "tabber extension tag", "My box", "Other"]


def test_drafts_are_worked_out_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(rows):
        for frame in rows:
            read.add(len(frame))
            yield frame

    tiers = docs_search.tiers_of(spark.createDataFrame([("Extension:Box", "The alpha box.\n== Alpha ==\ntext\n")], "title string, text string"))
    asked = spark.createDataFrame([("T", 1, "alpha"), ("U", 1, "alpha"), ("U", 2, "box")], "topic string, turn int, text string").mapInPandas(seen, "topic string, turn int, text string")
    got = docs_search.bridge(asked, tiers).collect()
    assert {r["topic"] for r in got} == {"T", "U"} and read.value == 3


def test_surface_counts_pages_once(spark):
    rows = pages(spark, [("A", "{{Box}} {{box}} {{#if:x}} <math>"), ("B", "{{Box}}")])
    known = spark.createDataFrame([("template", "template:BOX"), ("tag", "gallery")], "kind string, name string")
    got = {(r["kind"], r["rank"]): tuple(r)[2:] for r in surface.surface(surface.uses(rows), known, 3).collect()}
    assert got["template", 1] == ("Template:Box", 3, 2, True) and got["template", 0] == (None, 3, 2, None) and got["tag", 2] == ("gallery", 0, 0, True) and got["tag", 1] == ("math", 1, 1, False)


def test_parts_of_articles_read_them_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(rows):
        for frame in rows:
            read.add(len(frame))
            yield frame

    passages, profiles, cited, named = registry._article_parts(pages(spark).mapInPandas(seen, "title string, text string"))
    assert {r["page"] for r in profiles.collect()} == {"A", "D"} and passages.count() == 4 and cited.count() == 1 and named.count() == 0
    assert read.value == len(PAGES)


def test_counts_of_artifacts_write_no_bundle(spark, sf):
    got = registry.queries()["c16_artifacts"](spark, sf)
    assert all(f.endswith("/part.parquet") for f in got.inputFiles()) and got.count() == 200
