"""Resampling and sign flips draw tasks, not groups of them."""

import datetime
import random

import pytest

from tidemill import plans
from tidemill.operators import reliability as op

RUNS = ("1-URGENT", "5-LOW")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(8), []
    for task in range(230):
        for run in RUNS:
            for _ in range(rng.randint(1, 4)):
                rows.append((len(rows), task, run, rng.choice("FO"), 1.0, datetime.date(1997, 1, 1)))
    path = str(tmp_path_factory.mktemp("orders"))
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double, o_orderdate date").write.parquet(f"{path}/orders.parquet")
    return path, rows


def counted(rows, runs):
    """(task, n, c) in order of tasks."""
    found = {}
    for _, task, run, status, *_ in rows:
        if run in runs:
            n, c = found.get(task, (0, 0))
            found[task] = (n + 1, c + (status == "F"))
    return [(k, *found[k]) for k in sorted(found)]


def interval(rows, statistic, seed):
    """One choice for each row, draw after draw, as intervals are published."""
    rng = random.Random(seed)
    drawn = sorted(statistic([rng.choice(rows) for _ in rows]) for _ in range(op.RESAMPLES))
    return pytest.approx((statistic(rows), drawn[250], drawn[9749]))


def test_intervals_are_of_tasks(spark, folder):
    path, rows = folder
    ask = lambda q: tuple(plans.queries()[q](spark, path).first())
    mean = lambda values: sum(values) / len(values)
    a, z = counted(rows, RUNS[:1]), counted(rows, RUNS[1:])
    assert ask("bootstrap_pass_1") == interval([c / n for _, n, c in counted(rows, RUNS)], mean, op.SEED)
    differences = [c2 / n2 - c / n for (_, n, c), (_, n2, c2) in zip(a, z)]
    assert ask("bootstrap_paired") == interval(differences, mean, op.SEED)
    ratio = lambda pairs: sum(y[2] for _, y in pairs) / sum(y[1] for _, y in pairs) - sum(x[2] for x, _ in pairs) / sum(x[1] for x, _ in pairs)
    assert ask("bootstrap_pooled_ratio") == interval(list(zip(a, z)), ratio, 20261005)
    assert ask("sign_flip_monte_carlo") == op.sign_flip_p(differences)
