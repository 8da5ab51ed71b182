"""Every query of the engine against its SQL at the smallest scale, and some operators on fixtures of their own."""

import os

import pytest

from glyphmill.operators import discovery
from glyphmill.plans import catalog, lifecycle, records, shapes  # noqa: F401 (they add their queries to the catalog)

SF = "/root/testdata/sf0.001"


def cell(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", list(catalog.queries()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "customer part orders lineitem events pages embeddings documents".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(cell, r)) for r in df.select(*names).collect()) == sorted(tuple(map(cell, r)) for r in cur.fetchall())


def test_stop_rules(spark):
    rows = [("a", 1, ["x", "y"]), ("a", 2, ["z"]), ("b", 1, ["x", "y"]), ("b", 2, ["y", "x"]), ("c", 1, ["x", "y"]), ("c", 2, []), ("d", 1, ["x", "y"]), ("d", 2, ["x", "x"]), ("e", 1, ["x", "y"]), ("e", 2, ["p", "q"])]
    got = discovery.paginate(spark.createDataFrame(rows, "k string, page_no int, entries array<string>"), "k", 2, 40).collect()
    assert {r["k"]: (r["pages"], r["stop_reason"], r["found"]) for r in got} == {
        "a": (2, "short_page", 3), "b": (2, "repeated_signature", 2), "c": (2, "empty_layout", 2), "d": (2, "no_new_glyphs", 2), "e": (2, "max_pages", 4),
    }


def test_late_fill(spark):
    rows = [("k", 1, ""), ("k", 2, " "), ("k", 3, "late"), ("k", 4, "later"), ("m", 5, None)]
    got = {r["id"]: (r["first"]["at"], r["name"]) for r in discovery.first_wins(spark.createDataFrame(rows, "id string, at int, name string"), "id", ["at"], "name").collect()}
    assert got == {"k": (1, "late"), "m": (5, None)}


