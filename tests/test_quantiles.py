"""Exact quantiles against numpy, window by window and section by section."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.operators import quantiles as Q

RNG = np.random.default_rng(5)
SCHEMA = StructType([StructField("asset", StringType()), StructField("dt", LongType()), StructField("v", DoubleType()), StructField("note", StringType())])


def naive(x, n, q, least):
    out = []
    for i in range(len(x)):
        known = [v for v in x[max(0, i + 1 - n) : i + 1] if not np.isnan(v)]
        out.append(np.quantile(known, q) if len(known) >= max(least, 1) else np.nan)
    return np.array(out)


@pytest.mark.parametrize("n, q, least", [(1, 0.5, 1), (7, 0.0, 7), (20, 0.8, 20), (20, 1.0, 5), (300, 0.31, 1)])
def test_window_quantiles(n, q, least):
    for x in (RNG.normal(size=200), RNG.integers(0, 4, 200).astype(float), np.full(200, np.nan), np.empty(0)):
        x = np.where(RNG.random(len(x)) < 0.1, np.nan, x)
        np.testing.assert_allclose(Q.window_quantiles(x, n, q, least), naive(x, n, q, least), rtol=1e-12)


def test_time_does_not_grow_with_the_window():
    x = RNG.normal(size=60_000)
    spent = []
    for n in (20, 1000, 20_000):
        began = time.perf_counter()
        Q.window_quantiles(x, n, 0.8, n)
        spent.append(time.perf_counter() - began)
    assert max(spent) < 10 * min(spent) + 0.5


@pytest.mark.parametrize("block", [1, 16, 10_000])
def test_rolling_quantile_whatever_the_block(spark, block):
    rows, expected = [], {}
    for asset, size in (("a", 90), ("b", 1), ("c", 33), (None, 40)):
        x = [None if RNG.random() < 0.15 else float(v) for v in RNG.integers(0, 9, size)]
        found = naive(np.array([np.nan if v is None else v for v in x], dtype=float), 10, 0.3, 6)
        for i, v in enumerate(x):
            rows.append((asset, i, v, None if i % 2 else "kept"))
            expected[asset, i] = (v, None if np.isnan(found[i]) else found[i], rows[-1][3])
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["asset"], r["dt"]): (r["v"], r["p"], r["note"]) for r in Q.rolling_quantile(df, "v", 10, 0.3, "p", 6, block=block).collect()}
    assert got.keys() == expected.keys()
    for key, (v, p, note) in expected.items():
        assert got[key][0] == v and got[key][2] == note
        assert (got[key][1] is None) == (p is None) and (p is None or math.isclose(got[key][1], p, abs_tol=1e-12))


def test_rolling_quantile_of_nothing(spark):
    assert Q.rolling_quantile(spark.createDataFrame([], SCHEMA), "v", 5, 0.5).collect() == []


def test_section_quantiles(spark):
    sections = {
        "normal": RNG.normal(size=400), "equal": np.full(50, -2.5), "one": np.array([7.0]), "signs": np.array([-1e300, -1.0, -0.0, 0.0, 1e-308, 5e-324, 3.0]),
        "close": 1 + np.arange(70) * 2.0**-52, "ties": RNG.integers(-2, 3, 300).astype(float), "ends": np.array([-np.inf, 0.0, 1.0, 2.0, np.inf]),
    }
    rows = [(s, i, float(v), None) for s, x in sections.items() for i, v in enumerate(x)]
    rows += [("normal", -1, None, None), ("normal", -2, float("nan"), None), ("unknown", 0, None, None), (None, 0, 1.0, None)]
    asked = {"q0": 0.0, "q10": 0.1, "median": 0.5, "q93": 0.93, "q100": 1.0}
    got = {r["asset"]: r for r in Q.section_quantiles(spark.createDataFrame(rows, SCHEMA), "v", asked, ["asset"]).collect()}
    assert got.keys() == sections.keys()
    for s, x in sections.items():
        if s == "ends":
            assert (got[s]["q0"], got[s]["median"], got[s]["q100"]) == (-np.inf, 1.0, np.inf)
            continue
        for name, q in asked.items():
            assert math.isclose(got[s][name], np.quantile(x, q), rel_tol=1e-12, abs_tol=1e-300), (s, name)


def test_one_section_and_clipping(spark):
    x = RNG.normal(size=500)
    df = spark.createDataFrame([("a", i, float(v), None) for i, v in enumerate(x)] + [("b", 0, None, None)], SCHEMA)
    lo, hi = np.quantile(x, [0.05, 0.9])
    got = Q.clipped_to_quantiles(df, "v", 0.05, 0.9).orderBy("asset", "dt").collect()
    np.testing.assert_allclose([r["norm"] for r in got[:-1]], np.clip(x, lo, hi), rtol=1e-12)
    assert got[-1]["norm"] is None and len(got) == 501
    assert Q.section_quantiles(df.where("false"), "v", {"m": 0.5}, []).collect() == []
    keyed = Q.clipped_to_quantiles(df.withColumn("asset", F.when(F.col("dt") > 9, F.col("asset"))), "v", 0.05, 0.9, ["asset"])
    assert keyed.count() == 501 and keyed.where("asset is null and norm is not null").count() == 0
