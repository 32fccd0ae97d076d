"""Calls of all write tools, replayed over the tables as a shop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import calls as op
from tidemill.registry import query, table


def shop(spark: SparkSession, sf_dir: str) -> op.Shop:
    """The tables in the shape that calls read: parts are options of products of ten, returned lines are requests, every
    third order has a coupon, every fourth customer has two tickets whose numbers leave a gap."""
    text = lambda c: F.col(c).cast("string")
    o, c, p = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    orders = o.select(
        text("o_orderkey").alias("order_id"),
        text("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "O", "paid").when(F.col("o_orderstatus") == "F", "delivered").otherwise("shipping").alias("status"),
        F.concat(F.lit("A"), "o_custkey", F.lit("-1")).alias("ship_address_id"),
        F.date_add(F.to_date("o_orderdate"), 3).alias("promised_by"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '5 4' DAY TO HOUR")).alias("delivered_at"),
        F.round("o_totalprice").cast("long").alias("amount_won"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").cast("string").alias("variant_id"), F.min("l_quantity").cast("long").alias("quantity"), F.min(F.round("l_extendedprice")).cast("long").alias("unit_won"), F.bool_or(F.col("l_returnflag") == "R").alias("back")
    )
    named = lines.select(text("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), "variant_id", "quantity", "unit_won", F.when(F.col("back"), "return_requested").otherwise("ordered").alias("status"))
    back = named.filter("status <> 'ordered'")
    some = c.filter("c_custkey % 4 = 0").select(text("c_custkey").alias("customer_id"))
    return op.Shop(
        orders=orders,
        lines=named,
        variants=p.select(text("p_partkey").alias("variant_id"), F.expr("p_partkey div 10").cast("string").alias("product_id"), F.col("p_size").alias("stock")),
        addresses=c.select(text("c_custkey").alias("customer_id"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("n")).select(F.concat(F.lit("A"), "customer_id", F.lit("-"), "n").alias("address_id"), "customer_id"),
        requests=back.select(F.concat(F.lit("RT-"), "order_id", F.lit("-"), "line_no").alias("request_id"), "order_id", F.when(F.col("line_no") % 2 == 0, "defective").otherwise("changed_mind").alias("reason")),
        coupons=o.filter("o_orderkey % 3 = 0").select(F.concat(F.lit("CP-"), "o_orderkey", F.lit("-1")).alias("coupon_id"), text("o_orderkey").alias("order_id"), text("o_custkey").alias("customer_id"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 10 DAY")).alias("issued_at")),
        tickets=some.select(F.explode(F.array(*(F.concat(F.lit("TK-"), "customer_id", F.lit(f"-{n}")) for n in (1, 4)))).alias("ticket_id"), "customer_id"),
        handoffs=table(spark, sf_dir, "nation").select(F.concat(F.lit("HO-"), (F.col("n_nationkey") * 2 + 1).cast("string")).alias("handoff_id")),
    )


def _act(tool: str, **args: Column) -> Column:
    none = F.lit(None).cast("string")
    lists = F.array().cast("array<int>")
    every = {"order_id": none, "line_nos": lists, "line_no": F.lit(None).cast("int"), "new_variant_id": none, "address_id": none, "reason": none} | args
    return F.struct(F.lit(tool).alias("tool"), F.to_json(F.struct(*(v.alias(k) for k, v in every.items()))).alias("args"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, now, least, most, acts): three or four calls for each customer with orders, of eight patterns, on its first and last order."""
    o = table(spark, sf_dir, "orders")
    ends = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.min_by("o_orderdate", "o_orderkey").alias("day"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("fl"), F.max("l_linenumber").alias("ml"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("part"))
    t = ends.join(lines, F.col("first") == F.col("l_orderkey"), "left")
    text = lambda x: x.cast("string")
    k, least, most = F.col("o_custkey"), text(F.col("first")), text(F.col("last"))
    fl, ml, more, mind, bad = F.col("fl"), F.col("ml"), text(F.col("part") + 1), F.lit("changed_mind"), F.lit("defective")
    cancel = lambda order: _act("cancel_order", order_id=order)
    back = lambda reason, *lines: _act("request_return", order_id=least, line_nos=F.array(*lines), reason=reason)
    swap = lambda line, option: _act("request_exchange", order_id=least, line_no=line, new_variant_id=option, reason=mind)
    move = lambda order, address: _act("change_shipping_address", order_id=order, address_id=address)
    coupon = lambda order, reason: _act("issue_compensation_coupon", order_id=order, reason=F.lit(reason))
    second, other = F.concat(F.lit("A"), text(k), F.lit("-2")), F.concat(F.lit("A"), text(k + 1), F.lit("-1"))
    patterns = [
        [cancel(least), cancel(least), cancel(most)],
        [back(mind, fl), back(mind, ml, fl), cancel(least)],
        [swap(fl, more), swap(fl, more), swap(ml, more)],
        [move(least, second), move(least, second), move(most, other)],
        [coupon(least, "delivery_delay"), coupon(most, "delivery_delay"), coupon(least, "delivery_delay")],
        [_act("create_ticket", order_id=least), _act("create_ticket"), _act("transfer_to_human"), _act("create_ticket", order_id=F.lit("none"))],
        [back(bad, ml), coupon(least, "defective_item"), coupon(most, "defective_item")],
        [_act("frobnicate", order_id=least), cancel(F.lit("none")), cancel(text(F.col("first") + 1)), cancel(F.lit(None).cast("string"))],
    ]
    acts = F.when(k % 8 == 0, F.array(*patterns[0]))
    for n, p in enumerate(patterns[1:], 1):
        acts = acts.when(k % 8 == n, F.array(*p))
    return t.select(k.alias("c"), (F.col("day").cast("timestamp") + F.expr("INTERVAL '12 3' DAY TO HOUR")).alias("now"), "first", "last", acts.alias("acts"))


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c")
    each = tasks(spark, sf_dir).select("c", "now", F.posexplode("acts").alias("place", "a"))
    made = each.select(k.alias("of"), "place", "a.tool", "a.args", F.when(k % 11 != 0, k.cast("string")).alias("customer_id"), "now", (k % 3 != 0).alias("strict"), ((F.col("place") == 0) & (k % 5 == 0)).alias("dry"))
    return op.run(made, shop(spark, sf_dir))


_DAY = "(({0}) + INTERVAL 9 HOUR)::DATE"
_SHOP = f"""
l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS variant, min(l_quantity)::BIGINT AS q, min(round(l_extendedprice)::BIGINT) AS unit, bool_or(l_returnflag = 'R') AS back FROM lineitem GROUP BY 1, 2),
g AS (SELECT o, list({{'n': n, 'variant': variant, 'q': q, 'unit': unit, 'back': back}} ORDER BY n) AS items, bool_or(back AND n % 2 = 0) AS defective FROM l GROUP BY 1),
e AS (SELECT o_custkey AS c, min(o_orderkey) AS least, max(o_orderkey) AS most, arg_min(o_orderdate, o_orderkey) + INTERVAL 12 DAY + INTERVAL 3 HOUR AS now FROM orders GROUP BY 1),
h AS (SELECT l_orderkey AS o, min(l_linenumber) AS fl, max(l_linenumber) AS ml FROM lineitem GROUP BY 1),
b AS (SELECT e.*, fl, ml, l.variant + 1 AS more, c % 8 AS k FROM e LEFT JOIN h ON h.o = least LEFT JOIN l ON l.o = least AND l.n = fl),
a AS (SELECT c, now, unnest(CASE k
  WHEN 0 THEN [{{'p': 0, 't': 'cancel_order', 'o': least::VARCHAR, 'ls': NULL::INT[], 'v': NULL::BIGINT, 'a': NULL::VARCHAR, 'r': NULL::VARCHAR}}, {{'p': 1, 't': 'cancel_order', 'o': least::VARCHAR, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': NULL}}, {{'p': 2, 't': 'cancel_order', 'o': most::VARCHAR, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': NULL}}]
  WHEN 1 THEN [{{'p': 0, 't': 'request_return', 'o': least::VARCHAR, 'ls': [fl], 'v': NULL, 'a': NULL, 'r': 'changed_mind'}}, {{'p': 1, 't': 'request_return', 'o': least::VARCHAR, 'ls': [fl, ml], 'v': NULL, 'a': NULL, 'r': 'changed_mind'}}, {{'p': 2, 't': 'cancel_order', 'o': least::VARCHAR, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': NULL}}]
  WHEN 2 THEN [{{'p': 0, 't': 'request_exchange', 'o': least::VARCHAR, 'ls': [fl], 'v': more, 'a': NULL, 'r': 'changed_mind'}}, {{'p': 1, 't': 'request_exchange', 'o': least::VARCHAR, 'ls': [fl], 'v': more, 'a': NULL, 'r': 'changed_mind'}}, {{'p': 2, 't': 'request_exchange', 'o': least::VARCHAR, 'ls': [ml], 'v': more, 'a': NULL, 'r': 'changed_mind'}}]
  WHEN 3 THEN [{{'p': 0, 't': 'change_shipping_address', 'o': least::VARCHAR, 'ls': NULL, 'v': NULL, 'a': 'A' || c || '-2', 'r': NULL}}, {{'p': 1, 't': 'change_shipping_address', 'o': least::VARCHAR, 'ls': NULL, 'v': NULL, 'a': 'A' || c || '-2', 'r': NULL}}, {{'p': 2, 't': 'change_shipping_address', 'o': most::VARCHAR, 'ls': NULL, 'v': NULL, 'a': 'A' || (c + 1) || '-1', 'r': NULL}}]
  WHEN 4 THEN [{{'p': 0, 't': 'issue_compensation_coupon', 'o': least::VARCHAR, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': 'delivery_delay'}}, {{'p': 1, 't': 'issue_compensation_coupon', 'o': most::VARCHAR, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': 'delivery_delay'}}, {{'p': 2, 't': 'issue_compensation_coupon', 'o': least::VARCHAR, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': 'delivery_delay'}}]
  WHEN 5 THEN [{{'p': 0, 't': 'create_ticket', 'o': least::VARCHAR, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': NULL}}, {{'p': 1, 't': 'create_ticket', 'o': NULL, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': NULL}}, {{'p': 2, 't': 'transfer_to_human', 'o': NULL, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': NULL}}, {{'p': 3, 't': 'create_ticket', 'o': 'none', 'ls': NULL, 'v': NULL, 'a': NULL, 'r': NULL}}]
  WHEN 6 THEN [{{'p': 0, 't': 'request_return', 'o': least::VARCHAR, 'ls': [ml], 'v': NULL, 'a': NULL, 'r': 'defective'}}, {{'p': 1, 't': 'issue_compensation_coupon', 'o': least::VARCHAR, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': 'defective_item'}}, {{'p': 2, 't': 'issue_compensation_coupon', 'o': most::VARCHAR, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': 'defective_item'}}]
  ELSE [{{'p': 0, 't': 'frobnicate', 'o': least::VARCHAR, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': NULL}}, {{'p': 1, 't': 'cancel_order', 'o': 'none', 'ls': NULL, 'v': NULL, 'a': NULL, 'r': NULL}}, {{'p': 2, 't': 'cancel_order', 'o': (least + 1)::VARCHAR, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': NULL}}, {{'p': 3, 't': 'cancel_order', 'o': NULL, 'ls': NULL, 'v': NULL, 'a': NULL, 'r': NULL}}]
  END) AS x FROM b),
s AS (SELECT o_custkey AS c, o_orderdate + INTERVAL 10 DAY AS issued FROM orders WHERE o_orderkey % 3 = 0),
f AS (SELECT a.c, now, x.p AS place, x.t AS tool, x.o AS ord, x.ls AS ls, x.v AS v, x.a AS adr, x.r AS reason, a.c % 3 <> 0 AS strict, x.p = 0 AND a.c % 5 = 0 AS dry, a.c % 11 <> 0 AS known,
  o_custkey AS owner, o_orderstatus AS st, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 5 DAY + INTERVAL 4 HOUR END AS got, round(o_totalprice)::BIGINT AS won,
  list_filter(items, lambda i: list_contains(x.ls, i.n)) AS chosen, items, coalesce(g.defective, false) AS defective, (o_orderkey % 3 = 0)::INT AS on_order, p_partkey // 10 AS product, p_size AS stock,
  CASE WHEN x.t LIKE 'issue%' THEN (SELECT count(*) FROM s WHERE s.c = o_custkey AND {_DAY.format('issued')} BETWEEN {_DAY.format('a.now')} - 29 AND {_DAY.format('a.now')}) ELSE 0 END AS recent,
  EXISTS (SELECT 1 FROM customer WHERE x.a IN ('A' || c_custkey || '-1', 'A' || c_custkey || '-2')) AS adr_there
  FROM a LEFT JOIN orders ON o_orderkey::VARCHAR = x.o LEFT JOIN g ON g.o = o_orderkey LEFT JOIN part ON p_partkey = x.v)
"""
_LATE = f"{_DAY.format('now')} > {_DAY.format('got')} + 7"
_DUE = (
    f"CASE WHEN reason = 'defective_item' THEN CASE WHEN defective OR list_contains(m.bad, ord) THEN 3000 END ELSE CASE WHEN {_DAY.format('coalesce(got, now)')} - (o_orderdate::DATE + 3) <= 0 THEN NULL "
    f"WHEN {_DAY.format('coalesce(got, now)')} - (o_orderdate::DATE + 3) >= 3 THEN 5000 ELSE 2000 END END"
)
_GONE = "list_contains(m.gone, ord)"
_ID = "CASE tool WHEN 'request_exchange' THEN 'EX-' ELSE 'RT-' END || ord || '-' || ls[1]"


def _checks(*checks: tuple[str, str]) -> str:
    """A list of (code, policy) of failed checks; codes that begin with ! are policies."""
    return "list_filter([" + ", ".join(f"CASE WHEN {bad} THEN {{'code': '{code.lstrip('!')}', 'policy': {str(code[0] == '!').lower()}}} END" for code, bad in checks) + "], lambda z: z IS NOT NULL)"


_OWN = [("identity_not_verified", "NOT known"), ("order_not_found", "owner IS NULL"), ("not_order_owner", "owner <> c")]
_BUSY = [
    ("already_requested", "len(list_filter(chosen, lambda i: i.back OR list_contains(m.lines, ord || '#' || i.n))) > 0"),
    ("already_requested", f"list_contains(m.made, {_ID}) OR (tool = 'request_return' AND len(list_filter(chosen, lambda i: i.back AND i.n = ls[1])) > 0)"),
]
_STOCK = "stock - coalesce(list_sum(list_transform(list_filter(m.taken, lambda i: i.v = v), lambda i: i.n)), 0)"
_FAILED = f"""CASE tool
 WHEN 'cancel_order' THEN {_checks(('invalid_arguments', 'ord IS NULL'), *_OWN, ('already_cancelled', _GONE), ('!cancel_not_allowed_status', "st <> 'O'"))}
 WHEN 'request_return' THEN {_checks(('invalid_arguments', 'len(list_distinct(ls)) < len(ls)'), *_OWN, ('line_not_found', 'len(chosen) < len(ls)'), ('already_cancelled', _GONE), *_BUSY, ('!return_not_delivered', "st <> 'F'"), ('!return_window_expired', _LATE))}
 WHEN 'request_exchange' THEN {_checks(('invalid_arguments', 'v IS NULL'), *_OWN, ('line_not_found', 'len(chosen) < len(ls)'), ('variant_not_found', 'stock IS NULL'), ('already_cancelled', _GONE), *_BUSY, ('same_variant', 'chosen[1].variant = v'), ('out_of_stock', f'{_STOCK} < chosen[1].q'), ('!exchange_not_delivered', "st <> 'F'"), ('!exchange_window_expired', _LATE), ('!exchange_different_product', 'chosen[1].variant // 10 <> product'))}
 WHEN 'change_shipping_address' THEN {_checks(*_OWN, ('address_not_found', 'NOT adr_there'), ('address_not_owned', "NOT starts_with(adr, 'A' || owner || '-')"), ('already_cancelled', _GONE), ('same_address', "coalesce(m.moved[1].a, 'A' || owner || '-1') = adr AND coalesce(m.moved[1].o, ord) = ord"), ('!address_change_not_allowed_status', "st <> 'O'"))}
 WHEN 'issue_compensation_coupon' THEN {_checks(*_OWN, ('!coupon_order_cancelled', _GONE), ('!coupon_not_eligible', f'({_DUE}) IS NULL'), ('!coupon_already_issued_for_order', 'on_order + len(list_filter(m.coupons, lambda i: i = ord)) > 0'), ('!coupon_limit_exceeded', 'recent + len(m.coupons) >= 2'))}
 WHEN 'create_ticket' THEN {_checks(('identity_not_verified', 'NOT known'), ('order_not_found', 'ord IS NOT NULL AND owner IS NULL'), ('not_order_owner', 'owner <> c'))}
 WHEN 'transfer_to_human' THEN []
 ELSE [{{'code': 'unknown_tool', 'policy': false}}] END"""
_ITEMS = "list_transform(chosen, lambda i: {'t': 'lines', 'k': ord || '#' || i.n, 'f': 'status', 'v': CASE tool WHEN 'request_return' THEN 'return_requested' ELSE 'exchange_requested' END})"
_BACK = "greatest(0, list_sum(list_transform(chosen, lambda i: i.q * i.unit))::BIGINT - CASE reason WHEN 'changed_mind' THEN 3000 ELSE 0 END)"
_TICKET = "'TK-' || c || '-' || CASE WHEN c % 4 = 0 THEN [3, 5, 6, 7][m.tickets + 1] ELSE m.tickets + 1 END"
_MADE = f"CASE WHEN tool LIKE 'request%' THEN {_ID} WHEN tool LIKE 'issue%' THEN 'CP-' || ord || '-' || (on_order + len(list_filter(m.coupons, lambda i: i = ord)) + 1) WHEN tool = 'create_ticket' THEN {_TICKET} WHEN tool = 'transfer_to_human' THEN 'HO-26' END"
_SUM = f"CASE tool WHEN 'cancel_order' THEN won WHEN 'request_return' THEN {_BACK} WHEN 'request_exchange' THEN 0 WHEN 'issue_compensation_coupon' THEN coalesce({_DUE}, CASE reason WHEN 'defective_item' THEN 3000 ELSE 2000 END) END::BIGINT"
_FOLD = f"""
r AS (
  SELECT c, -1 AS place, '' AS tool, false AS dry, NULL::VARCHAR AS code, false AS policy, []::VARCHAR[] AS violations, NULL::VARCHAR AS made, NULL::BIGINT AS amount,
    []::STRUCT(t VARCHAR, k VARCHAR, f VARCHAR, v VARCHAR)[] AS cells,
    {{'gone': []::VARCHAR[], 'lines': []::VARCHAR[], 'made': []::VARCHAR[], 'bad': []::VARCHAR[], 'taken': []::STRUCT(v BIGINT, n BIGINT)[], 'moved': []::STRUCT(o VARCHAR, a VARCHAR)[], 'coupons': []::VARCHAR[], 'tickets': 0}} AS m FROM e
  UNION ALL
  SELECT c, place, tool, dry, code, policy, violations, made, amount, CASE WHEN ok THEN cells ELSE [] END,
    CASE WHEN NOT ok OR dry THEN m ELSE {{'gone': CASE tool WHEN 'cancel_order' THEN list_append(m.gone, ord) ELSE m.gone END,
      'lines': CASE WHEN tool LIKE 'request%' THEN list_concat(m.lines, list_transform(chosen, lambda i: ord || '#' || i.n)) ELSE m.lines END,
      'made': CASE WHEN tool LIKE 'request%' THEN list_append(m.made, made) ELSE m.made END, 'bad': CASE WHEN tool LIKE 'request%' AND reason = 'defective' THEN list_append(m.bad, ord) ELSE m.bad END,
      'taken': CASE tool WHEN 'request_exchange' THEN list_append(m.taken, {{'v': v, 'n': chosen[1].q}}) ELSE m.taken END, 'moved': CASE tool WHEN 'change_shipping_address' THEN list_prepend({{'o': ord, 'a': adr}}, m.moved) ELSE m.moved END,
      'coupons': CASE WHEN tool LIKE 'issue%' THEN list_append(m.coupons, ord) ELSE m.coupons END, 'tickets': m.tickets + (tool = 'create_ticket')::INT}} END
  FROM (SELECT *, refusal IS NULL AS ok, refusal.code AS code, coalesce(refusal.policy, false) AS policy, CASE WHEN refusal IS NULL THEN list_transform(list_filter(failed, lambda z: z.policy), lambda z: z.code) ELSE [] END AS violations,
      CASE WHEN refusal IS NULL THEN {_MADE} END AS made, CASE WHEN refusal IS NULL THEN {_SUM} END AS amount,
      CASE tool WHEN 'cancel_order' THEN list_concat([{{'t': 'orders', 'k': ord, 'f': 'status', 'v': 'cancelled'}}, {{'t': 'payments', 'k': ord, 'f': 'refund_won', 'v': won::VARCHAR}}], list_transform(items, lambda i: {{'t': 'lines', 'k': ord || '#' || i.n, 'f': 'status', 'v': 'cancelled'}}))
        WHEN 'request_return' THEN list_concat([{{'t': 'requests', 'k': {_ID}, 'f': 'kind', 'v': 'return'}}, {{'t': 'requests', 'k': {_ID}, 'f': 'lines', 'v': array_to_string(list_transform(chosen, lambda i: i.n), ',')}}, {{'t': 'requests', 'k': {_ID}, 'f': 'reason', 'v': reason}}, {{'t': 'requests', 'k': {_ID}, 'f': 'refund_won', 'v': ({_BACK})::VARCHAR}}], {_ITEMS})
        WHEN 'request_exchange' THEN list_concat([{{'t': 'requests', 'k': {_ID}, 'f': 'kind', 'v': 'exchange'}}, {{'t': 'requests', 'k': {_ID}, 'f': 'lines', 'v': ls[1]::VARCHAR}}, {{'t': 'requests', 'k': {_ID}, 'f': 'reason', 'v': reason}}, {{'t': 'requests', 'k': {_ID}, 'f': 'variant', 'v': v::VARCHAR}}, {{'t': 'variants', 'k': v::VARCHAR, 'f': 'stock', 'v': ({_STOCK} - chosen[1].q)::BIGINT::VARCHAR}}], {_ITEMS})
        WHEN 'change_shipping_address' THEN [{{'t': 'orders', 'k': ord, 'f': 'ship_address_id', 'v': adr}}]
        WHEN 'issue_compensation_coupon' THEN [{{'t': 'coupons', 'k': {_MADE}, 'f': 'amount_won', 'v': ({_SUM})::VARCHAR}}, {{'t': 'coupons', 'k': {_MADE}, 'f': 'reason', 'v': reason}}]
        WHEN 'create_ticket' THEN [{{'t': 'tickets', 'k': {_MADE}, 'f': 'customer_id', 'v': c::VARCHAR}}, {{'t': 'tickets', 'k': {_MADE}, 'f': 'order_id', 'v': ord}}]
        WHEN 'transfer_to_human' THEN [{{'t': 'handoffs', 'k': {_MADE}, 'f': 'customer_id', 'v': CASE WHEN known THEN c::VARCHAR ELSE '' END}}] ELSE [] END AS cells
    FROM (SELECT *, list_filter(failed, lambda z: strict OR NOT z.policy)[1] AS refusal
      FROM (SELECT f.*, m, {_FAILED} AS failed FROM (SELECT c AS rc, place AS rp, m FROM r) JOIN f ON f.c = rc AND f.place = rp + 1)))
)
"""
_RUN = f"WITH RECURSIVE {_SHOP.strip()}, {_FOLD.strip()}"


@query(f"{_RUN} SELECT c AS of, place, tool, dry, code, policy, array_to_string(violations, ',') AS violations, made, amount, len(cells)::INTEGER AS n_changes FROM r WHERE place >= 0", write=True)
def replayed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all write tools, refused and accepted ones and dry runs mixed, each under what the ones before it left."""
    return _run(spark, sf_dir).select("of", "place", "tool", "dry", "code", "policy", F.array_join("violations", ",").alias("violations"), "made", "amount", F.size("changes").alias("n_changes"))


@query(
    f"{_RUN}, n AS (SELECT c, place, unnest(cells) AS x, generate_subscripts(cells, 1) AS pos FROM r WHERE code IS NULL AND NOT dry) "
    "SELECT c AS of, x.t AS table, x.k AS key, x.f AS field, arg_max(x.v, place * 100 + pos) AS now FROM n GROUP BY ALL HAVING arg_max(x.v, place * 100 + pos) IS NOT NULL",
    write=True,
)
def replayed_end_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in which each conversation's end state differs from the tables."""
    return op.end_cells(_run(spark, sf_dir)).select("of", "table", "key", "field", "now")


def cells(s: op.Shop) -> DataFrame:
    """(table, key, field, value) of what calls can change in the tables."""
    return op.base_cells({"orders": (s.orders, ["order_id"], ["status", "ship_address_id"]), "lines": (s.lines, ["order_id", "line_no"], ["status"]), "variants": (s.variants, ["variant_id"], ["stock"])})


def _bits(*parts: str) -> str:
    return "('0x' || substr(sha256(" + " || ".join(f"CASE WHEN {p} IS NULL THEN '-' ELSE length({p}) || ':' || {p} END" for p in parts) + "), 1, 15))::BIGINT::HUGEINT"


_CELLS = """
w AS (SELECT 'orders' AS t, o_orderkey::VARCHAR AS k, 'status' AS f, CASE o_orderstatus WHEN 'O' THEN 'paid' WHEN 'F' THEN 'delivered' ELSE 'shipping' END AS v FROM orders
  UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'ship_address_id', 'A' || o_custkey || '-1' FROM orders UNION ALL SELECT 'lines', o || '#' || n, 'status', CASE WHEN back THEN 'return_requested' ELSE 'ordered' END FROM l
  UNION ALL SELECT 'variants', p_partkey::VARCHAR, 'stock', p_size::VARCHAR FROM part)
"""


@query(
    f"{_RUN}, {_CELLS.strip()}, n AS (SELECT c, place, unnest(cells) AS x, generate_subscripts(cells, 1) AS pos FROM r WHERE code IS NULL AND NOT dry), "
    "z AS (SELECT c, x.t AS t, x.k AS k, x.f AS f, arg_max(x.v, place * 100 + pos) AS v FROM n GROUP BY ALL HAVING arg_max(x.v, place * 100 + pos) IS NOT NULL), "
    f"d AS (SELECT c, sum({_bits('z.t', 'z.k', 'z.f', 'z.v')} - CASE WHEN w.v IS NULL THEN 0 ELSE {_bits('w.t', 'w.k', 'w.f', 'w.v')} END) AS delta FROM z LEFT JOIN w ON w.t = z.t AND w.k = z.k AND w.f = z.f GROUP BY c), "
    f"q AS (SELECT sum({_bits('t', 'k', 'f', 'v')}) AS total FROM w), y AS (SELECT c, count(code) AS problems FROM r WHERE place >= 0 GROUP BY c) "
    "SELECT c AS of, problems, CASE WHEN problems = 0 THEN (total + coalesce(delta, 0))::HUGEINT::VARCHAR END AS hash FROM q, y LEFT JOIN d USING (c)",
    write=True,
)
def replayed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of the state that each conversation's calls lead to, where none was refused."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("of"))
    return op.end_hashes(ids, _run(spark, sf_dir), cells(shop(spark, sf_dir)))


def guarded_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that cancel a customer's first order, forbid to cancel its first and last, and require an amount that is in one of its
    orders, or nowhere."""
    o = table(spark, sf_dir, "orders")
    ends = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.min_by(F.round("o_totalprice").cast("long"), "o_orderkey").alias("won"))
    k, text = F.col("o_custkey"), lambda c: F.col(c).cast("string")
    forbid = lambda c: F.struct(_act("cancel_order", order_id=text(c)).getField("tool").alias("tool"), _act("cancel_order", order_id=text(c)).getField("args").alias("args"), F.lit("cancel_not_allowed_status").alias("expect_code"))
    value = F.struct(F.lit("total").alias("label"), F.lit("number").alias("kind"), (F.col("won") + F.when(k % 2 == 0, 0).otherwise(1)).cast("string").alias("value"))
    return ends.select(
        k.alias("id"), k.cast("string").alias("customer_id"), F.lit("1999-01-01 00:00:00").cast("timestamp").alias("now"), F.array(_act("cancel_order", order_id=text("first"))).alias("gold_actions"),
        F.lit(True).alias("gold_verified"), F.array(forbid("first"), forbid("last")).alias("forbidden_actions"), F.array(value).alias("required_values"),
    )


_ENDS = "e AS (SELECT o_custkey AS c, min(o_orderkey) AS least, max(o_orderkey) AS most, arg_min(o_orderstatus, o_orderkey) AS ls, arg_max(o_orderstatus, o_orderkey) AS ms, arg_min(round(o_totalprice)::BIGINT, o_orderkey) AS won FROM orders GROUP BY 1)"


@query(
    f"WITH {_ENDS} SELECT c AS id, 0 AS place, unnest(['wrong_code', 'does_not_run']) AS problem FROM e WHERE ls = 'O' UNION ALL SELECT c, 1, unnest(['wrong_code', 'does_not_run']) FROM e WHERE ls = 'O' AND most = least UNION ALL SELECT c, 1, 'not_refused' FROM e WHERE ms = 'O' AND most <> least",
    write=True,
)
def forbidden_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the calls that tasks forbid, each tried on an overlay of its own over the task's end state."""
    return op.forbidden_problems(guarded_tasks(spark, sf_dir), shop(spark, sf_dir))


@query(
    f"WITH {_ENDS} SELECT c AS id, 'total' AS label FROM e WHERE c % 2 = 1 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c AND (round(o_totalprice)::BIGINT = won + 1 OR o_orderkey = won + 1)) AND (ls <> 'O' OR least <> won + 1)"
)
def unobtainable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required values that no order document of the task's customer and no output of its expected calls tells."""
    t, s = guarded_tasks(spark, sf_dir), shop(spark, sf_dir)
    texts = s.orders.select("customer_id", F.to_json(F.struct("order_id", "status", "amount_won")).alias("text"))
    calls = t.select(F.col("id").alias("of"), "customer_id", "now", F.posexplode("gold_actions").alias("place", "a")).select("of", "place", "a.tool", "a.args", "customer_id", "now", F.lit(True).alias("strict"), F.lit(False).alias("dry"))
    outputs = op.run(calls, s).filter("code IS NULL").select("of", F.to_json(F.struct("tool", "made", "amount")).alias("text"))
    return op.unobtainable(t, texts, outputs)
