from collections import Counter
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators import state as op
from tidemill.operators import writes


def test_difference_and_equality_treat_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "y")], "k int, v string")
    assert sorted((r.side, r.k, r.v) for r in op.difference(a, b).collect()) == [("only_actual", 2, "y"), ("only_expected", 2, "x")]
    assert op.equality("t", a, a).first().equal and not op.equality("t", a, a.distinct()).first().equal


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_surplus_is_the_bag_difference(spark, done, gold):
    frames = [spark.createDataFrame([(x,) for x in xs], "k int") for xs in (done, gold)]
    assert {r.k: r.surplus for r in op.surplus(*frames).collect()} == dict(Counter(done) - Counter(gold))


def test_dump_is_plain_and_ordered(spark):
    df = spark.createDataFrame([("b", datetime(2024, 5, 1, 7), "free"), ("a", None, "text")], "id string, at timestamp, note string")
    assert [tuple(r) for r in op.dump(df, ["id"], ["note"]).collect()] == [("a", None), ("b", "2024-05-01T07:00:00+00:00")]


def test_first_stitch_sample_and_free_numbers(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "soon"), ("b", 5, "only")], "k string, t int, v string")
    assert sorted((r.k, r.v) for r in op.first_by(df, ["k"], ["t"]).collect()) == [("a", "soon"), ("b", "only")]
    again = spark.createDataFrame([("b", 5, "new")], df.schema)
    assert sorted(r.v for r in op.stitch(df, again, ["k"]).collect()) == ["late", "new", "soon"]
    ids = spark.range(100).toDF("k")
    one, two = (sorted((r.k, r.place) for r in op.sample(ids.repartition(n), "k", 7, "s").collect()) for n in (1, 5))
    assert one == two and len(one) == 7
    used = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2), ("c", 1), ("c", 1)], "o string, n long")
    assert {r.o: r.free for r in op.free_number(used, "o", "n").collect()} == {"a": 3, "b": 1, "c": 2}


def test_fingerprints_ignore_order_and_see_changes(spark):
    df = spark.range(50).toDF("k")
    f = lambda d: op.fingerprint("t", d, ["k"]).first().hash
    assert f(df) == f(df.orderBy(F.desc("k"))) != f(df.filter("k > 0"))
    pairs = [df.union(df.filter(f"k = {k}")).union(df.filter(f"k = {k}")) for k in (3, 4)]
    assert len({f(df), *map(f, pairs)}) == 3
    rows = lambda *values: spark.createDataFrame([(v,) for v in values], "k string")
    assert len({f(rows(None)), f(rows("")), f(rows())}) == 3


def test_floating_numbers_are_no_plain_values(spark):
    with pytest.raises(TypeError, match="price"):
        op.dump(spark.createDataFrame([(1, 0.5)], "id int, price double"), ["id"])


def test_refused_requests_leave_the_stock(spark):
    asked = spark.createDataFrame([("a", 1, 3), ("a", 2, 9), ("a", 3, 2), ("b", 1, 1)], "v string, t int, n int")
    stock = spark.createDataFrame([("a", 5), ("b", 0)], "v string, left int")
    found = {(r.v, r.t): (r.accepted, r.left) for r in writes.take_stock(asked, stock, "v", "t", "n", "left").collect()}
    assert found == {("a", 1): (True, 2), ("a", 2): (False, 2), ("a", 3): (True, 0), ("b", 1): (False, 0)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 90), max_size=14))
def test_trailing_limits_count_what_was_accepted(spark, days):
    df = spark.createDataFrame([("c", k, d) for k, d in enumerate(days)], "c string, k int, d int")
    found = {r.k: r.accepted for r in writes.limit_trailing(df, "c", "k", "d", 2, 30).collect()}
    kept, expected = [], {}
    for d, k in sorted((d, k) for k, d in enumerate(days)):
        expected[k] = sum(d - x < 30 for x in kept) < 2
        kept += [d] * expected[k]
    assert found == expected


def test_decisions_and_their_effect(spark):
    state = spark.createDataFrame([(1, "O"), (2, "F")], "k int, s string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    d = writes.decide(asked, state, "k", [("closed", F.col("s") != "O")])
    assert {r.k: r.code for r in d.collect()} == {1: None, 2: "closed", 3: "not_found"}
    after = writes.apply(state, d.filter("code IS NULL"), "k", {"s": F.lit("C")})
    assert sorted(map(tuple, after.collect())) == [(1, "C"), (2, "F")]
    assert [tuple(r) for r in writes.dry_run(state, d.filter("code IS NULL"), "k", {"s": F.lit("C")}).collect()] == [(1, "s", "O", "C")]
    assert writes.dry_run(state, d.filter("code IS NULL"), "k", {"s": F.lit("O")}).collect() == []


def test_fingerprints_tell_values_apart(spark):
    bits = lambda *row: spark.range(1).select(op.row_bits(*(F.lit(x).cast("string") for x in row)).alias("b")).first().b
    assert len({bits("a|b", "c"), bits("a", "b|c"), bits("a", "b", "c"), bits("", None), bits(None, ""), bits("-", ""), bits("\\N", "")}) == 7
