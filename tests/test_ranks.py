"""Exact medians against the library's own."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemill.operators import ranks


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_medians_of_groups(spark, accuracy):
    rng = random.Random(accuracy)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [7.0] * 50, "wide": [rng.lognormvariate(0, 9) for _ in range(501)], "even": [float(rng.randint(-40, 40)) for _ in range(300)], None: [5.0, -1.0, 2.0], "far": [1e300, -1e300, 0.0, 4.0]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("none", None), ("two", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    found = {r.g: (r.n, r["median"]) for r in ranks.medians(df, F.col("v"), {"g": F.col("g")}, accuracy).collect()}
    assert found == {k: (len(v), pytest.approx(statistics.median(v))) for k, v in groups.items()}
    whole = ranks.medians(df, F.col("v"), accuracy=accuracy).collect()
    every = [v for values in groups.values() for v in values]
    assert [(r.n, r["median"]) for r in whole] == [(len(every), pytest.approx(statistics.median(every)))]
    assert ranks.medians(df.filter("false"), F.col("v")).count() == 0
