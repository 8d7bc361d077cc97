"""Every query that has SQL gives the same rows, names and values on the smallest tables."""

from pathlib import Path

import pytest

from tidemark import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    found = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    assert sorted(want.columns) == sorted(found.columns) and len(want) == len(found)
    key = lambda df: sorted(map(str, df[sorted(df.columns)].round(5).astype(object).where(df[sorted(df.columns)].notna(), None).map(lambda v: str(v)[:10] if hasattr(v, "year") else v).itertuples(index=False, name=None)))
    assert key(want) == key(found)


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")
def test_portfolio_vol_has_every_date(spark):
    found = catalog.QUERIES["portfolio_vol"](spark, str(DATA)).toPandas()
    dates = catalog.QUERIES["bars_daily"](spark, str(DATA)).select("dt").distinct().count()
    assert len(found) == dates > 0
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(catalog.ORACLE_SQL["portfolio_vol"]).fetchall()
    assert {str(d)[:10]: v for d, v in want} == pytest.approx({str(d)[:10]: v for d, v in zip(found.dt, found.vol, strict=True)}, abs=2e-6, nan_ok=True)


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")
def test_pair_queries_cover_the_universe(spark):
    assets = {r.asset for r in catalog.QUERIES["asset_list"](spark, str(DATA)).collect()}
    found = catalog.QUERIES["pair_R1"](spark, str(DATA))
    assert {r.asset for r in found.select("asset").distinct().collect()} == assets
    test_query_matches_sql(spark, "pair_R2_all")
