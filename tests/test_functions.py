"""Expressions against the standard library."""

from statistics import NormalDist

from tidegrid.functions import expected_max, phi


def test_phi(spark):
    xs = [-6.0, -2.5, -1.0, -0.1, 0.0, 0.3, 1.7, 4.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr(phi("x").replace("1.0", "1.0D") + " AS p").collect()
    assert all(abs(r.p - NormalDist().cdf(x)) < 1e-6 for r, x in zip(got, xs))


def test_expected_max():
    assert 1.9 < expected_max(25) < 2.0
