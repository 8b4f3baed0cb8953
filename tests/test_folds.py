import numpy as np
import pandas as pd

from tidegrid.operators import folds


def test_ewm_skips_missing():
    assert np.allclose(folds.ewm(np.array([1.0, np.nan, 3.0]), 0.5), [1, 1, 2])


def test_wilder_is_null_before_its_seed():
    out = folds.wilder(np.array([0.0, 1, 2, 3, 4]), 3)
    assert np.isnan(out[:3]).all() and out[3] == 2 and np.isclose(out[4], 2 + 2 / 3)


def test_ledger_keeps_cash_without_targets():
    g = pd.DataFrame({"t": [1, 1, 2, 2], "symbol": list("abab"), "close": [1.0, 2, 1, 2], "raw": [0.0] * 4})
    assert folds.ledger(g).nav.tolist() == [100_000, 100_000]


def test_ledger_doubles_with_its_only_symbol():
    g = pd.DataFrame({"t": [1, 2, 3], "symbol": ["a"] * 3, "close": [1.0, 1.0, 2.0], "raw": [1.0] * 3})
    assert np.isclose(folds.ledger(g, fee=0.0).nav.tolist()[-1], 200_000)


def _returns(spark, **series):
    return spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "symbol string, i long, r double")


def test_spa_tells_an_edge_from_noise(spark):
    rng = np.random.default_rng(5)
    noise = {f"n{k}": x - x.mean() - 0.02 for k, x in enumerate(rng.normal(0, 1, (5, 300)))}
    plain = folds.spa(_returns(spark, flat=np.zeros(300), **noise)).collect()[0]
    assert plain.variants == 5 and plain.p_consistent > 0.5 and plain.p_lower <= plain.p_consistent <= plain.p_upper
    assert folds.spa(_returns(spark, edge=rng.normal(0.5, 1, 300), **noise)).collect()[0].p_consistent < 0.05


def test_cpcv_against_brute_force(spark):
    from itertools import combinations

    from conftest import DATA
    from tidegrid import catalog

    x = folds.view(spark, DATA, "SELECT symbol, t, coalesce(r, 0.0) AS r FROM ret_1w").toPandas().pivot(index="t", columns="symbol", values="r").sort_index()
    values, groups, seen = x.to_numpy(), np.array_split(np.arange(len(x)), 10), [[] for _ in range(10)]
    sharpe = lambda v: v.mean(0) / v.std(0, ddof=1)
    for pair in combinations(range(10), 2):
        keep = np.ones(len(x), bool)
        for g in pair:
            a, b = groups[g][0], groups[g][-1]
            keep[max(0, a - 12) : b + 1 + 17] = False
        best = int(np.argmax(np.round(sharpe(values[keep]), 9)))
        for g in pair:
            seen[g].append(values[groups[g], best])
    want = [sharpe(np.concatenate([s[j] for s in seen])) * np.sqrt(52) for j in range(9)]
    got = [r.sharpe for r in catalog.QUERIES["st_cpcv"](spark, DATA).orderBy("path").collect()]
    assert np.allclose(got, want, atol=1e-5)
