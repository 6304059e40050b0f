import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.operators.quantiles import QUARTILES, quantile_values

CHANCES = (0.0, 0.01, *QUARTILES, 0.99, 1.0)


def test_many_rows(spark):
    rng = np.random.default_rng(7)
    columns = {
        "normal": rng.normal(size=5000),
        "skewed": rng.lognormal(sigma=6, size=5000),
        "ties": rng.integers(0, 3, size=5000).astype(float),
        "hot": np.where(rng.random(5000) < 0.4, 7.0, rng.normal(size=5000)),
        "one": np.full(5000, 3.5),
    }
    rows = list(zip(*[c.tolist() for c in columns.values()]))
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in columns)).repartition(5)
    found = quantile_values(frame, probabilities=CHANCES)
    for name, values in columns.items():
        assert found[name] == pytest.approx(np.quantile(values, CHANCES).tolist(), rel=1e-12, abs=1e-300)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False) | st.sampled_from([0.0, 1.0, -0.0, 5e-324]), min_size=1, max_size=30))
def test_any_doubles(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    found = quantile_values(frame, probabilities=(0, 0.5, 1))["x"]
    ordered = sorted(values)
    middle = [ordered[math.floor((len(values) - 1) / 2)], ordered[math.ceil((len(values) - 1) / 2)]]
    assert found[0] == ordered[0] and found[2] == ordered[-1]
    assert min(middle) <= found[1] <= max(middle)


def test_infinities(spark):
    frame = spark.createDataFrame([(float(v),) for v in ("-inf", "-5", "0", "2", "1e300", "inf", "inf")], "x double")
    found = quantile_values(frame, probabilities=(0, 1 / 6, 2 / 6, 0.5, 4 / 6, 1))["x"]
    assert found == [-math.inf, -5.0, 0.0, 2.0, 1e300, math.inf]


def test_a_frame_that_moves_is_an_error(spark):
    from pyspark.sql import functions as F

    moving = spark.range(2000).select((F.unix_micros(F.current_timestamp()) + F.col("id")).cast("double").alias("x"))
    with pytest.raises(ValueError, match="stage the frame"):
        quantile_values(moving)
