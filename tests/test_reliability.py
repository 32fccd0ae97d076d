import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators import reliability as op


def test_pass_hat_k_is_a_ratio_of_binomials(spark):
    rows = [(n, c, k) for n in range(0, 7) for c in range(0, n + 1) for k in range(0, 8)]
    df = spark.createDataFrame(rows, "n long, c long, k int")
    for r in df.withColumn("v", op.pass_hat_k(F.col("n"), F.col("c"), F.col("k"))).collect():
        if 1 <= r.k <= r.n:
            assert r.v == pytest.approx(math.comb(r.c, r.k) / math.comb(r.n, r.k))
        else:
            assert r.v is None


def test_means_of_pass_k(spark):
    by = spark.createDataFrame([("a", 4, 4), ("b", 4, 2), ("c", 2, 1)], "task string, n long, c long")
    assert op.pass_k(by, 4).first().value == pytest.approx((1 + 0) / 2)
    assert math.isnan(op.pass_k(by, 5).first().value)
    table = {r.k: r.value for r in op.pass_k_table(by).collect()}
    assert table == {1: pytest.approx((1 + 0.5 + 0.5) / 3), 2: pytest.approx((1 + 1 / 6 + 0) / 3)}
    assert op.pass_k_table(by.limit(0)).collect() == []


def test_no_values_count_as_said(spark):
    schema = "verdict string, judged boolean, same boolean, said map<string,boolean>"
    rows = [("v", True, True, {}), ("v", True, True, {"a": False}), (None, True, True, {}), ("v", False, True, {}), ("v", True, True, {"a": True}), ("v", True, None, {})]
    df = spark.createDataFrame(rows, schema)
    found = [r.ok for r in df.select(op.success(F.col("verdict"), F.col("judged"), F.col("same"), F.col("said")).alias("ok")).collect()]
    assert found == [True, False, False, False, True, False]


@given(st.lists(st.integers(-3, 3), max_size=9))
def test_exact_sign_flips_count_all_patterns(ds):
    p, n, exact = op.sign_flip_p(ds)
    some = [d for d in ds if d]
    hits = sum(abs(sum(d if m >> k & 1 else -d for k, d in enumerate(some))) >= abs(sum(some)) for m in range(2 ** len(some)))
    assert exact and n == len(some) and p == pytest.approx(hits / 2 ** len(some))


def test_drawn_sign_flips_are_near_the_exact_p():
    ds = [random.Random(3).choice((-1, 1, 2)) for _ in range(14)]
    exact = op.sign_flip_p(ds)[0]
    drawn, n, is_exact = op.sign_flip_p(ds, exact_most=5)
    assert not is_exact and n == 14 and abs(drawn - exact) < 0.02


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 80, 1000])
def test_draws_are_those_of_the_generator(n):
    rng, source = random.Random(7), op.Draws(7)
    assert [x for k in (1, 3, 996, 4000) for x in source.below(n, k).tolist()] == [rng.choice(range(n)) for _ in range(5000)]
    rng, source = random.Random(9), op.Draws(9)
    assert source.heads(700).tolist() == [rng.random() < 0.5 for _ in range(700)]


def test_drawn_p_is_that_of_the_generator():
    ds = [random.Random(4).choice((-1.5, 1, 2, 0.25)) + k / 64 for k in range(25)]
    rng = random.Random(op.FLIP_SEED)
    hits = sum(abs(sum(d if rng.random() < 0.5 else -d for d in ds)) >= abs(sum(ds)) - 1e-9 for _ in range(op.DRAWS))
    assert op.sign_flip_p(ds) == ((hits + 1) / (op.DRAWS + 1), 25, False)


def test_resampling_order_statistics(spark):
    df = spark.createDataFrame([(k, float(k % 2)) for k in range(20)], "task int, v double")
    r = op.resampled(df, "task", op.mean_of("v"), draws=1000).first()
    rng, rows = random.Random(op.SEED), [float(k % 2) for k in range(20)]
    means = sorted(sum(rng.choice(rows) for _ in rows) / 20 for _ in range(1000))
    assert (r.point, r.low, r.high) == (0.5, pytest.approx(means[25]), pytest.approx(means[974]))
    pooled = spark.createDataFrame([(1, 1, 2, 1, 1), (2, 0, 0, 1, 2)], "task int, a int, b int, c int, d int")
    assert op.resampled(pooled, "task", op.pooled_ratio("a", "b", "c", "d"), draws=50).first().point == pytest.approx(2 / 3 - 1 / 2)


def test_runs_of_different_tasks_are_no_pair(spark):
    a = spark.createDataFrame([("a", 4, 1), ("b", 4, 0), ("c", 1, 1)], "task string, n long, c long")
    better = spark.createDataFrame([("a", 4, 3), ("b", 4, 1), ("c", 4, 4)], "task string, n long, c long")
    assert sorted((r.task, r.difference) for r in op.paired(a, better, "task", 1).collect()) == [("a", 0.5), ("b", 0.25), ("c", 0.0)]
    assert {r.task for r in op.paired(a, better, "task", 4).collect()} == {"a", "b"}
    for one, two in ((a, better.filter("task <> 'a'")), (a.filter("task <> 'b'"), better)):
        with pytest.raises(Exception, match="same tasks"):
            op.paired(one, two, "task", 1).collect()


def test_shares_of_the_negative_control_add_up(spark):
    rows = [("a", 1, True, False), ("a", 2, False, True), ("b", 1, False, True), ("b", 2, True, True), ("c", 1, False, False)]
    df = spark.createDataFrame(rows, "task string, trial int, base boolean, arm boolean").withColumn("fired", F.col("trial") == 1)
    found = {r.fired: r for r in op.negative_control(df, "task", "fired", "base", "arm").collect()}
    assert sum(r.pairs for r in found.values()) == 5
    assert sum(r.share for r in found.values()) == pytest.approx(((0.5 - 0.5) + (1 - 0.5) + 0) / 3)


def test_draws_go_on_from_any_output():
    whole, source = op.Draws(5).raw(op._NEAR + 4000), op.Draws(5, op._NEAR + 1000)
    assert (source.raw(3000) == whole[op._NEAR + 1000 :]).all()


def test_parts_of_a_sequence_are_drawn_by_many_tasks(spark, monkeypatch):
    """Whether a sequence is drawn in one part or in many, results are those of the one generator; and no task draws it all."""
    monkeypatch.setattr(op, "_ONE_PART", 1000)
    rows = [(k, float(k % 7), float(k % 3 + 1), float(k % 5), 2.0) for k in range(90)]
    df = spark.createDataFrame(rows, "task int, a double, b double, c double, d double").repartition(3)
    rng = random.Random(op.SEED)
    drawn = ([rng.choice(rows) for _ in rows] for _ in range(600))
    ratios = sorted(sum(r[3] for r in x) / sum(r[4] for r in x) - sum(r[1] for r in x) / sum(r[2] for r in x) for x in drawn)
    found = op.resampled(df, "task", op.pooled_ratio("a", "b", "c", "d"), draws=600)
    assert found.first().low == pytest.approx(ratios[15]) and found.first().high == pytest.approx(ratios[584])
    flips = spark.createDataFrame([(k, (-1.5, 1, 2, 0.25, 0)[k % 5] + (k % 5 < 4) * k / 64) for k in range(40)], "k int, d double")
    assert tuple(op.sign_flip(flips.repartition(3), "k", "d").first()) == op.sign_flip_p([r.d for r in flips.collect()])
    assert math.isnan(op.resampled(df.filter("task < 0"), "task", op.mean_of("a")).first().point) and tuple(op.sign_flip(flips.filter("k < 0"), "k", "d").first()) == (1.0, 0, True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow [part" in plan
