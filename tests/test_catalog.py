"""Every registered query against its SQL, on the smallest tables (or those in CATALOG_SF_DIR)."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from regionloom import catalog

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v if math.isnan(v) else round(v, 9)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order]), sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    names, rows = rows_of(got.columns, got.collect())
    if name not in catalog.ORACLES:
        assert rows or name == "annealing_plan"
        return
    want = duck.execute(catalog.ORACLES[name])
    want_names, want_rows = rows_of([d[0] for d in want.description], want.fetchall())
    assert names == want_names
    assert len(rows) == len(want_rows)
    for a, b in zip(rows, want_rows, strict=True):
        assert all(x == y or (isinstance(x, float) and y is not None and math.isclose(x, float(y), rel_tol=1e-9, abs_tol=2e-9)) for x, y in zip(a, b, strict=True)), (a, b)


def test_annealing_plan_runs_the_default_steps(spark, monkeypatch):
    given = {}
    monkeypatch.setattr(catalog.search, "balance", lambda *_, **options: given.update(options))
    catalog.QUERIES["annealing_plan"](spark, "/root/testdata/sf0.001")
    assert "steps" not in given
