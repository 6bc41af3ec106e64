import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrane.functions import kernels as K
from terrane.functions.transforms import from_line, to_line


@pytest.mark.parametrize("nu", [0.3, 0.8, 1.1, 2.1])
def test_bessel_recurrence(nu):
    x = np.logspace(-4, 1.5, 60)
    left = K.bessel_k(nu + 1, x)
    right = K.bessel_k(abs(nu - 1), x) + 2 * nu / x * K.bessel_k(nu, x)
    assert np.allclose(left, right, rtol=1e-9)


@pytest.mark.parametrize("nu", [0.5, 1.5, 2.5])
def test_general_matern_meets_closed_forms(nu):
    d = np.linspace(1e-4, 2, 50)
    x = d * 4
    general = 2 ** (1 - nu) / math.gamma(nu) * x**nu * K.bessel_k(nu, x)
    assert np.allclose(general, K.correlation(d, K.Theta(4.0, 1.0, nu)), rtol=1e-9)


def test_value_at_distance_zero_has_the_nugget():
    t = K.Theta(3.0, 2.0, 0.5, 0.4)
    assert K.covariance(np.array([0.0]), t)[0] == 2.0
    assert K.covariance(np.array([1e-12]), t)[0] == pytest.approx(1.2)


def test_unknown_family():
    with pytest.raises(ValueError):
        K.correlation(np.ones(1), K.Theta(1.0), 7)


@settings(max_examples=50, deadline=None)
@given(st.floats(0.31, 199), st.floats(0.001, 0.999))
def test_transform_round_trip(a, b):
    low, high = np.array([0.3, 0.0]), np.array([200.0, 1.0])
    x = np.array([a, b])
    assert np.allclose(from_line(to_line(x, low, high), low, high), x)


@pytest.mark.parametrize("nu", [0.05, 0.3, 0.8, 0.89, 0.9, 1.0, 1.2, 2.0, 2.09])
def test_general_smoothness_as_a_column(spark, nu):
    """Column functions against the Bessel function's integral in numpy, from distances next to 0 to those where nothing is left."""
    d = np.concatenate([[0.0], 10.0 ** np.linspace(-9, 1.2, 400)])
    theta = K.Theta(5.0, 2.0, nu, 0.1)
    got = spark.createDataFrame([(float(x),) for x in d], "d double").select("d", K.general_matern(F.col("d"), theta).alias("c")).toPandas().sort_values("d")["c"]
    assert np.abs(got.to_numpy() - K.covariance(d, theta)).max() < 5e-12
