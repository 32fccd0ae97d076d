"""Parents with children of several tables nested at once."""

from tidemill.operators import documents as op


def test_all_children_in_one_shuffle(spark):
    parent = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", None), (None, 9)], "id string, n int")
    lines = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 1, "x"), ("b", 1, None), ("z", 5, "lost"), (None, 1, "q")], "id string, no int, what string")
    paid = spark.createDataFrame([("a", 10), ("a", 7)], "id string, won long")
    found = op.nested(parent, "id", {"lines": (lines, ["no", "what"]), "payment": (paid, ["won"])}, single=["payment"])
    rows = sorted(((r.id, r.n, [tuple(x) for x in r.lines], r.payment and r.payment.won) for r in found.collect()), key=repr)
    assert rows == [("a", 1, [(1, "x"), (1, "x"), (2, "y")], 7), ("b", 2, [(1, None)], None), ("b", 2, [(1, None)], None), ("c", None, [], None)]
    assert found.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert op.nested(parent.filter("false"), "id", {"lines": (lines, ["no"])}).count() == 0
