"""Tables that change together: all of a commit or nothing, whatever fails."""

import pytest
from pyspark.sql import functions as F

from wikiloom.sources.versions import Change, Conflict, Tables


def made(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t", {"pages": "title", "links": "source"}, 4)
    pages = spark.createDataFrame([(f"P{i}", i) for i in range(40)], "title string, n int")
    links = spark.createDataFrame([(f"P{i % 40}", f"P{i}") for i in range(80)], "source string, target string")
    assert tables.commit({"pages": Change(pages), "links": Change(links)}) == 1
    return tables


def rows(tables, name, version=None):
    return sorted(tuple(r) for r in tables.read(name, version).collect())


def test_deletes_and_upserts_appear_together(spark, tmp_path):
    tables = made(spark, tmp_path)
    gone = spark.createDataFrame([("P3",), ("absent",)], "title string")
    fresh = spark.createDataFrame([("P5", 500), ("new", 7)], "title string, n int")
    tables.commit({"pages": Change(fresh, gone), "links": Change(spark.createDataFrame([("P5", "X")], "source string, target string"), gone.withColumnRenamed("title", "source"))})
    assert rows(tables, "pages") == sorted([(f"P{i}", i) for i in range(40) if i not in (3, 5)] + [("P5", 500), ("new", 7)])
    assert rows(tables, "links") == sorted([(f"P{i % 40}", f"P{i}") for i in range(80) if i % 40 not in (3, 5)] + [("P5", "X")])
    assert len(rows(tables, "pages", 1)) == 40 and len(rows(tables, "links", 1)) == 80
    # buckets without a changed key stay where they were
    before, now = tables.manifest(1)["pages"], tables.manifest(2)["pages"]
    assert 0 < sum(before[b] == now.get(b) for b in before) < len(before)
    tables.commit({"links": Change(gone=tables.read("links").select("source"))})
    assert rows(tables, "links") == [] and len(rows(tables, "pages")) == 40
    assert tables.vacuum(1) > 0 and tables.versions() == [3] and len(rows(tables, "pages")) == 40


def test_a_failing_task_leaves_the_old_version(spark, tmp_path):
    tables = made(spark, tmp_path)
    fine = spark.createDataFrame([("P1", 100)], "title string, n int")
    bad = spark.createDataFrame([("P1", "X"), ("P2", "Y")], "source string, target string").withColumn("target", F.when(F.col("source") == "P2", F.raise_error(F.lit("lost"))).otherwise(F.col("target")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables.commit({"pages": Change(fine), "links": Change(bad)})
    assert tables.versions() == [1] and ("P1", 1) in rows(tables, "pages") and len(rows(tables, "links")) == 80
    tables.commit({"pages": Change(fine)})
    assert ("P1", 100) in rows(tables, "pages")


def test_two_writers_and_null_keys(spark, tmp_path):
    tables = made(spark, tmp_path)
    one = spark.createDataFrame([("P1", 1000), (None, 5)], "title string, n int")
    assert tables.commit({"pages": Change(one)}, base=1) == 2
    with pytest.raises(Conflict):
        tables.commit({"pages": Change(one.withColumn("n", F.lit(3)))}, base=1)
    assert (None, 5) in [tuple(r) for r in tables.read("pages").collect()] and tables.read("pages").count() == 41
    tables.commit({"pages": Change(gone=spark.createDataFrame([(None,)], "title string"))})
    assert tables.read("pages").count() == 40
