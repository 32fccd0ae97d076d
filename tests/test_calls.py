"""Tool calls folded over a shop: what rules refuse, what policies let pass, savepoints, dry runs, end states, forbidden calls."""

import json

import pytest
from pyspark.sql import functions as F

from tidemill.operators import calls as op

NOW = "2026-09-14 05:00:00"


@pytest.fixture(scope="module")
def shop(spark):
    df = spark.createDataFrame
    return op.Shop(
        orders=df(
            [("O-1", "C-1", "paid", "A-1", "2026-09-10", None, 58300), ("O-2", "C-1", "delivered", "A-1", "2026-09-05", "2026-09-07 16:00:00", 30000), ("O-3", "C-1", "delivered", "A-1", "2026-09-01", "2026-09-01 01:00:00", 9000), ("O-9", "C-2", "paid", "A-9", "2026-09-20", None, 100)],
            "order_id string, customer_id string, status string, ship_address_id string, promised_by string, delivered_at string, amount_won long",
        ).withColumns({"promised_by": F.to_date("promised_by"), "delivered_at": F.to_timestamp("delivered_at")}),
        lines=df([("O-1", 1, "V-1", 1, 58300, "ordered"), ("O-2", 1, "V-1", 2, 10000, "ordered"), ("O-2", 2, "V-3", 1, 10000, "ordered"), ("O-3", 1, "V-1", 1, 9000, "ordered")], "order_id string, line_no int, variant_id string, quantity long, unit_won long, status string"),
        variants=df([("V-1", "P-1", 5), ("V-2", "P-1", 3), ("V-3", "P-2", 9)], "variant_id string, product_id string, stock long"),
        addresses=df([("A-1", "C-1"), ("A-2", "C-1"), ("A-9", "C-2")], "address_id string, customer_id string"),
        requests=df([], "request_id string, order_id string, reason string"),
        coupons=df([("CP-O-3-1", "O-3", "C-1", "2026-08-20 00:00:00")], "coupon_id string, order_id string, customer_id string, issued_at string").withColumn("issued_at", F.to_timestamp("issued_at")),
        tickets=df([("TK-C-1-1", "C-1"), ("TK-C-1-4", "C-1")], "ticket_id string, customer_id string"),
        handoffs=df([("HO-1",), ("HO-2",)], "handoff_id string"),
    )


def done(spark, shop, *conversations):
    """Conversations of calls (tool, arguments, and what is not as usual) as lists of rows."""
    rows = []
    for k, calls in enumerate(conversations):
        for place, (tool, args, *rest) in enumerate(calls):
            odd = rest[0] if rest else {}
            rows.append((k, place, tool, args if args is None or isinstance(args, str) else json.dumps(args), odd.get("who", "C-1"), odd.get("strict", True), odd.get("dry", False)))
    calls = spark.createDataFrame(rows, "of int, place int, tool string, args string, customer_id string, strict boolean, dry boolean").withColumn("now", F.to_timestamp(F.lit(NOW)))
    found = op.run(calls, shop)
    out = [[] for _ in conversations]
    for r in sorted(found.collect(), key=lambda r: (r.of, r.place)):
        out[r.of].append(r)
    return found, out


def exchange(line, option, order="O-2", reason="changed_mind"):
    return ("request_exchange", {"order_id": order, "line_no": line, "new_variant_id": option, "reason": reason})


def back(*lines, order="O-2", reason="changed_mind"):
    return ("request_return", {"order_id": order, "line_nos": list(lines), "reason": reason})


def cancel(order, **odd):
    return ("cancel_order", {"order_id": order}, odd)


def test_every_tool_and_what_the_rules_refuse(spark, shop):
    move = lambda order, address, **odd: ("change_shipping_address", {"order_id": order, "address_id": address}, odd)
    coupon = lambda order, reason, **odd: ("issue_compensation_coupon", {"order_id": order, "reason": reason}, odd)
    lenient = {"strict": False}
    _, (a, b, c, d, e, f) = done(
        spark,
        shop,
        [cancel("O-1", who=None), cancel("O-404"), cancel("O-9"), cancel("O-2"), cancel("O-1"), cancel("O-1"), ("cancel_order", "{}"), ("frob", {}), ("cancel_order", None)],
        [back(1, 1), back(7), back(2, 1), back(1), exchange(1, "V-2"), back(1, order="O-1"), back(1, order="O-3"), (*back(1, order="O-3"), lenient)],
        [exchange(1, "V-404"), exchange(1, "V-1"), exchange(2, "V-1"), exchange(1, "V-2"), exchange(2, "V-2"), (*exchange(2, "V-2"), lenient), ("request_exchange", {"order_id": "O-2", "line_no": 1, "new_variant_id": "V-2", "reason": "odd"})],
        [move("O-1", "A-404"), move("O-1", "A-9"), move("O-1", "A-1"), move("O-1", "A-2"), move("O-1", "A-2"), move("O-1", "A-1"), move("O-2", "A-2"), move("O-2", "A-2", strict=False)],
        [coupon("O-2", "delivery_delay"), coupon("O-2", "delivery_delay"), coupon("O-3", "defective_item"), coupon("O-3", "defective_item", strict=False), coupon("O-1", "delivery_delay"), coupon("O-9", "delivery_delay", who="C-2"), coupon("O-1", "luck")],
        [("create_ticket", {"category": "x"}), ("create_ticket", {"order_id": "O-1"}), ("create_ticket", {"order_id": "O-9"}), ("create_ticket", {"order_id": ""}), ("transfer_to_human", {}), ("transfer_to_human", {}, {"who": None}), ("create_ticket", {}, {"who": None})],
    )
    say = lambda rows: [r.code or r.made or r.amount or "moved" for r in rows]
    assert say(a) == ["identity_not_verified", "order_not_found", "not_order_owner", "cancel_not_allowed_status", 58300, "already_cancelled", "invalid_arguments", "unknown_tool", "invalid_arguments"]
    assert say(b) == ["invalid_arguments", "line_not_found", "RT-O-2-1", "already_requested", "already_requested", "return_not_delivered", "return_window_expired", "RT-O-3-1"]
    assert b[2].amount == 27000 and b[7].violations == ["return_window_expired"] and b[7].amount == 6000
    assert say(c) == ["variant_not_found", "same_variant", "exchange_different_product", "EX-O-2-1", "exchange_different_product", "EX-O-2-2", "invalid_arguments"]
    assert [(x.table, x.key, x.was, x.now) for x in c[5].changes if x.field == "stock"] == [("variants", "V-2", "1", "0")]
    assert say(d) == ["address_not_found", "address_not_owned", "same_address", "moved", "same_address", "moved", "address_change_not_allowed_status", "moved"]
    assert [r.policy for r in d] == [False] * 6 + [True, False] and d[7].violations == ["address_change_not_allowed_status"]
    assert say(e) == ["CP-O-2-1", "coupon_already_issued_for_order", "coupon_not_eligible", "CP-O-3-2", "coupon_limit_exceeded", "coupon_not_eligible", "invalid_arguments"]
    assert e[3].violations == ["coupon_not_eligible", "coupon_already_issued_for_order", "coupon_limit_exceeded"] and e[3].amount == 3000
    assert say(f) == ["TK-C-1-3", "TK-C-1-5", "not_order_owner", "TK-C-1-6", "HO-3", "HO-4", "identity_not_verified"]


def test_refused_calls_and_dry_runs_leave_state_and_violations(spark, shop):
    _, (a, b) = done(
        spark,
        shop,
        [cancel("O-2", dry=True, strict=False), cancel("O-2"), cancel("O-2", strict=False), cancel("O-2", strict=False), back(1)],
        [(*exchange(1, "V-2"), {"dry": True}), exchange(1, "V-2"), (*back(1, 2), {"strict": False}), back(2)],
    )
    assert [(r.code, r.violations, len(r.changes)) for r in a] == [(None, ["cancel_not_allowed_status"], 4), ("cancel_not_allowed_status", [], 0), (None, ["cancel_not_allowed_status"], 4), ("already_cancelled", [], 0), ("already_cancelled", [], 0)]
    assert [(r.code, r.made) for r in b] == [(None, "EX-O-2-1"), (None, "EX-O-2-1"), ("already_requested", None), (None, "RT-O-2-2")]


def test_end_states_do_not_depend_on_the_way(spark, shop):
    move = lambda address: ("change_shipping_address", {"order_id": "O-1", "address_id": address})
    found, _ = done(spark, shop, [move("A-2"), back(1), back(2)], [back(2), back(1), move("A-2")], [move("A-2"), move("A-1")], [cancel("O-9")], [cancel("O-1", dry=True)])
    cells = op.base_cells({"orders": (shop.orders, ["order_id"], ["status", "ship_address_id"]), "lines": (shop.lines, ["order_id", "line_no"], ["status"]), "variants": (shop.variants, ["variant_id"], ["stock"])})
    hashes = {r.of: (r.problems, r.hash) for r in op.end_hashes(spark.range(6).withColumnRenamed("id", "of"), found, cells).collect()}
    untouched = cells.agg(F.sum(op.cell_bits("table", "key", "field", "value")).cast("string")).first()[0]
    assert hashes[0] == hashes[1] and hashes[0][1] not in (None, untouched)
    assert hashes[2] == (0, untouched) and hashes[3] == (1, None) and hashes[4] == (0, untouched) and hashes[5] == (0, untouched)
    ends = {(r.table, r.key, r.field, r.base, r.now) for r in op.end_cells(found).filter("of = 0 AND base IS NOT NULL").collect()}
    assert ends == {("orders", "O-1", "ship_address_id", "A-1", "A-2"), ("lines", "O-2#1", "status", "ordered", "return_requested"), ("lines", "O-2#2", "status", "ordered", "return_requested")}


def tasks(spark, rows):
    act = lambda a: {"tool": a[0], "args": json.dumps(a[1]), "expect_code": a[2] if len(a) > 2 else None}
    kind = "array<struct<tool:string,args:string,expect_code:string>>"
    made = [(i, "C-1", [act(a) for a in gold], True, [act(a) for a in forbidden], values) for i, gold, forbidden, values in rows]
    return spark.createDataFrame(made, f"id string, customer_id string, gold_actions {kind}, gold_verified boolean, forbidden_actions {kind}, required_values array<struct<label:string,kind:string,value:string>>").withColumn("now", F.lit(NOW))


def test_forbidden_calls_are_tried_on_copies_of_the_end_state(spark, shop):
    stop = lambda order, code="cancel_not_allowed_status": ("cancel_order", {"order_id": order}, code)
    gold = [("cancel_order", {"order_id": "O-1"})]
    found = op.forbidden_problems(
        tasks(spark, [("fine", gold, [stop("O-2"), stop("O-2")], []), ("after", gold, [stop("O-1")], []), ("allowed", [], [stop("O-1")], []), ("code", [], [stop("O-2", "other")], []), ("gone", [], [stop("O-404", "order_not_found")], []), ("none", gold, [], [])]), shop
    )
    assert sorted((r.id, r.problem) for r in found.collect()) == [("after", "does_not_run"), ("after", "wrong_code"), ("allowed", "not_refused"), ("code", "wrong_code"), ("gone", "does_not_run"), ("gone", "wrong_code")]


def test_values_must_be_in_an_output(spark, shop):
    value = lambda v, kind="number": {"label": f"v{v}", "kind": kind, "value": v}
    t = tasks(spark, [("a", [], [], [value("58300"), value("8300"), value("2026-09-10", "date")]), ("b", [], [], [value("27000")]), ("c", [], [], [value("27000")])])
    texts = spark.createDataFrame([("C-1", '{"amount_won": 58300, "promised": "2026-09-10"}'), ("C-2", "8300 27000")], "customer_id string, text string")
    outputs = spark.createDataFrame([("b", '{"refund_won": 27000}')], "of string, text string")
    assert sorted(map(tuple, op.unobtainable(t, texts, outputs).collect())) == [("a", "v8300"), ("c", "v27000")]


def test_no_calls(spark, shop):
    empty = spark.createDataFrame([], "of int, place int, tool string, args string, customer_id string, now timestamp, strict boolean, dry boolean")
    assert op.run(empty, shop).count() == 0


def test_calls_without_a_key_are_dealt_over_all_tasks(spark):
    """They are told nothing, and aren't all sent to the task that null belongs to."""
    calls = spark.range(2000).select(F.col("id").alias("of"), F.lit(0).alias("place"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("address_id"))
    facts = spark.range(0, 2000, 20).select(F.col("id").cast("string").alias("address_id"), F.col("id").alias("owner"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        told = op._told(calls, "address_id", facts).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {(r.of, r.address_id, r.owner) for r in told} == {(k, None if k % 10 else str(k), None if k % 20 else k) for k in range(2000)} and len(told) == 2000
    assert max(sum(r.task == t for r in told) for t in range(4)) < 700
