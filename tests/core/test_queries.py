"""Every query with SQL against DuckDB over the smallest test tables; the others run."""

import duckdb
import pytest

from wikiloom import registry
from wikiloom.operators import retrieve

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return repr(round(x, 6)) if isinstance(x, float) else repr(x)


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, con, name):
    made = registry.queries()[name](spark, sf)
    got = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(made.columns)
    assert sorted(tuple(map(plain, r)) for r in made.select(*names).collect()) == sorted(tuple(map(plain, r)) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("limit,budget", [(6, 200), (3, 1000)])
def test_choice_against_plain_python(spark, limit, budget):
    import random

    r = random.Random(4)
    words = [f"w{k}xx" for k in range(12)]
    rows = [(q, f"p{r.randrange(4)}", k, r.randrange(50), r.randrange(20, 90), k, " ".join(r.choice(words) for _ in range(4))) for q in range(6) for k in range(30)]
    got = retrieve.selected(spark.createDataFrame(rows, "query int, page string, place int, score long, tokens long, turn int, text string"), limit, budget, 2).collect()
    want = []
    for q in range(6):
        taken, used = [], 0
        for x in [x for x in rows if x[0] == q]:
            terms = set(x[6].split())
            near = any(len(terms & t) / len(terms | t) >= retrieve.SAME for *_, t in taken)
            if len(taken) < limit and sum(p == x[1] for p, *_ in taken) < 2 and (not taken or used + x[4] <= budget) and not near:
                taken.append((x[1], x[2], terms))
                used += x[4]
        want += [(q, p, k, i + 1) for i, (p, k, _) in enumerate(taken)]
    assert sorted((x["query"], x.page, x.place, x.chosen) for x in got) == sorted(want)


def test_flagship_keeps_its_limits(spark, sf):
    rows = registry.flagship(spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query"], []).append(r)
    for got in by.values():
        got.sort(key=lambda r: r["chosen"])
        assert len(got) <= 6 and [r["chosen"] for r in got] == list(range(1, len(got) + 1))
        assert sum(r["tokens"] for r in got[1:]) + got[0]["tokens"] <= max(400, got[0]["tokens"])
        pages = [r["page"] for r in got]
        assert len(set(pages)) <= 4 and max(map(pages.count, pages)) <= 2
