import json

from pyspark.sql import functions as F

from wikiloom.sources import files


def test_page_files(spark, tmp_path):
    for path, text in {"Main/Al_pha.wiki": "plain", "Category/Foo.wiki": "#REDIRECT [[Category:Bar]]", "Module/M--x.lua": "return 1", "Main/A___ko.wiki": "ko", "Main/skip.txt": ""}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r.title: r for r in files.page_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"Al pha", "Category:Foo", "Module:M:x", "A/ko"}
    assert got["Category:Foo"].redirect_target == "Category:Bar" and got["A/ko"].language == "ko" and got["A/ko"].base == "A" and got["Al pha"].namespace == "Main"


def test_paths_round_trip(spark):
    titles = ["Alpha", "A b/c", "Template:X: y", "Category:Z"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", files.path_title(files.title_path(F.col("t"))).alias("b")).collect()
    assert all(r.t == r.b for r in rows)


def test_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,content\nA,"x, ""y""\nz"\n\nB,q\n')
    assert [tuple(r) for r in files.csv_rows(spark, str(tmp_path / "a.csv")).orderBy("title").collect()] == [("A", 'x, "y"\nz'), ("B", "q")]
    (tmp_path / "a.json").write_text('[{"title": "A", "n": 1, "x": null}, {"title": "B"}]')
    got = [r["row"] for r in files.json_rows(spark, str(tmp_path / "a.json")).collect()]
    assert got == [{"title": "A", "n": "1", "x": ""}, {"title": "B"}]
    rows = spark.createDataFrame([("a", "1"), ("New", "2"), (None, "3")], "title string, content string")
    there = spark.createDataFrame([("A",)], "title string")
    assert {(r.content, r.action) for r in files.import_plan(rows, there).collect()} == {("1", "update"), ("2", "create"), ("3", "error")}
    assert {(r.content, r.action) for r in files.import_plan(rows, there, "create").collect()} == {("1", "skip"), ("2", "create"), ("3", "error")}
    page = spark.createDataFrame([({"b": "x|y", "a": "1"},)], "row map<string,string>").select(files.row_page(F.col("row"), "T")).first()[0]
    assert page == "{{T\n|a=1\n|b=<nowiki>x|y</nowiki>\n}}"


def test_bundles_replace_their_corpora(spark, tmp_path):
    bundle = {"schema_version": 1, "generated_at_unix": 1, "source": "s", "extensions": [{"extension_name": "E", "source_wiki": "w", "version": "1", "pages": [{"page_title": "P", "local_path": "p", "content": "t"}, {"page_title": "Q", "local_path": "q", "content": "u"}]}], "technical": [{"doc_type": "hooks", "pages": [{"page_title": "H", "local_path": "h", "content": "v"}]}]}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    pages = files.docs_bundle(spark, str(tmp_path / "b.json"))
    assert sorted(tuple(r) for r in pages.select("corpus", "page").collect()) == [("extension:E", "P"), ("extension:E", "Q"), ("technical:hooks", "H")]
    out = str(tmp_path / "out")
    files.replace_corpora(pages, out)
    files.replace_corpora(pages.filter("page = 'P'"), out)
    assert sorted(r.page for r in spark.read.parquet(out).collect()) == ["H", "P"]
