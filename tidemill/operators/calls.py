"""Tool calls over a shop's tables as data: each conversation's calls are folded, in order, over what they touch.

No conversation gets a copy of the state. Joins bring each call the facts of the tables that its rules look at (the order with its
lines, the address, the option, how many coupons there are); one row of calls for a conversation then runs through a fold in the JVM
whose state is an overlay: what this conversation has changed so far. A call is checked against facts under the overlay. A
refused call leaves the overlay and the recorded violations as they were before it, a dry run tells what it would do and
leaves them too. The end state is told by the cells that differ from the tables.

Integrity checks always refuse. Policy checks refuse where a call is strict; else they are recorded as violations and the
call goes on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import rules
from tidemill.functions.text import let
from tidemill.operators.state import row_bits

#: The tools, and what their arguments may be.
TOOLS = ("cancel_order", "request_return", "request_exchange", "change_shipping_address", "issue_compensation_coupon", "create_ticket", "transfer_to_human")
REQUEST_REASONS, COUPON_REASONS = ("changed_mind", "defective", "wrong_item"), ("delivery_delay", "defective_item")
CANCELLABLE = ("paid", "preparing")
MOST_LINES = 50

CHANGE = "struct<table:string,key:string,field:string,base:string,was:string,now:string>"
_OVERLAY = (
    "struct<cancelled:array<string>,lines:array<struct<key:string,status:string>>,requests:array<string>,defective:array<string>,taken:array<struct<variant:string,n:bigint>>,"
    "addresses:array<struct<order:string,address:string>>,coupons:array<string>,tickets:int,handoffs:int>"
)
_DONE = f"struct<place:int,tool:string,code:string,policy:boolean,violations:array<string>,made:string,amount:bigint,changes:array<{CHANGE}>>"


@dataclass(frozen=True)
class Shop:
    """The tables that calls read. Keys are text, times are in UTC.

    orders (order_id, customer_id, status, ship_address_id, promised_by, delivered_at, amount_won), lines (order_id, line_no,
    variant_id, quantity, unit_won, status), variants (variant_id, product_id, stock), addresses (address_id, customer_id),
    requests (request_id, order_id, reason), coupons (coupon_id, order_id, customer_id, issued_at; compensation only), tickets
    (ticket_id, customer_id), handoffs (handoff_id)."""

    orders: DataFrame
    lines: DataFrame
    variants: DataFrame
    addresses: DataFrame
    requests: DataFrame
    coupons: DataFrame
    tickets: DataFrame
    handoffs: DataFrame


def _number(id_: Column) -> Column:
    """The number that ends an id."""
    return F.try_to_number(F.regexp_extract(id_, r"(\d+)$", 1), F.lit("9" * 18)).cast("long")


def _only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is asked for: what no call touches is not gathered."""
    return df.join(keys.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_semi")


def _told(met: DataFrame, key: str, *facts: DataFrame) -> DataFrame:
    """``met`` with the columns of each table of ``facts`` (unique by ``key``) on its key, null where there is none. Rows without a key
    are dealt out at random, not all to the task that null belongs to; one exchange of ``met`` serves all tables."""
    met = met.withColumn("_at", F.coalesce(key, F.xxhash64("of", "place").cast("string")))
    for told in facts:
        met = met.join(told.withColumnRenamed(key, "_key"), (F.col("_at") == F.col("_key")) & F.col(key).isNotNull(), "left").drop("_key")
    return met.drop("_at")


def with_facts(calls: DataFrame, shop: Shop) -> DataFrame:
    """``calls`` (of, place, tool, args, customer_id, now, strict, dry) with parsed arguments and what the tables say about them.

    ``customer_id`` is the customer who is verified (null: none). Only rows that some call asks for are gathered, each into
    one array for its order; what has one row a key is joined as it is."""
    arg = lambda name: F.get_json_object("args", f"$.{name}")
    asked = calls.select(
        "*",
        arg("order_id").alias("order_id"),
        arg("reason").alias("reason"),
        arg("address_id").alias("address_id"),
        arg("new_variant_id").alias("variant_id"),
        F.when(F.col("tool") == "request_exchange", F.array(arg("line_no").try_cast("int"))).otherwise(F.array_sort(F.from_json(arg("line_nos"), "array<int>"))).alias("asked_lines"),
    )
    order = shop.orders.withColumnRenamed("customer_id", "owner")
    lines = _only(shop.lines, asked, "order_id").join(shop.variants.select("variant_id", "product_id"), "variant_id", "left")
    line = F.struct("line_no", "variant_id", "product_id", F.col("quantity").cast("long").alias("quantity"), F.col("unit_won").cast("long").alias("unit_won"), "status")
    items = lines.groupBy("order_id").agg(F.sort_array(F.collect_list(line)).alias("items"))
    held = _only(shop.requests, asked, "order_id").groupBy("order_id").agg(F.collect_set("request_id").alias("request_ids"), F.bool_or(F.col("reason") == "defective").alias("defective"))
    on_order = _only(shop.coupons, asked, "order_id").groupBy("order_id").agg(F.count("*").alias("on_order"))
    address = shop.addresses.select("address_id", F.col("customer_id").alias("address_owner"))
    option = shop.variants.select("variant_id", F.col("product_id").alias("new_product"), F.col("stock").cast("long").alias("stock"))

    # what a call asks for, not what it was told: the joins above are not worked out again for these two
    days = asked.filter(F.col("tool") == "issue_compensation_coupon").join(order.select("order_id", "owner"), "order_id").select("owner", "now").distinct()
    age = F.datediff(rules.local_date(F.col("now")), rules.local_date(F.col("issued_at")))
    recent = days.join(shop.coupons.select(F.col("customer_id").alias("owner"), "issued_at"), "owner").filter(age.between(0, rules.COUPON_DAYS - 1)).groupBy("owner", "now").agg(F.count("*").alias("recent"))
    tickets = _only(shop.tickets, asked, "customer_id").withColumn("n", _number(F.col("ticket_id"))).groupBy("customer_id").agg(F.count("*").alias("tickets"), F.collect_set("n").alias("ticket_numbers"))
    tickets = tickets.select("customer_id", "tickets", F.filter("ticket_numbers", lambda n: n > F.col("tickets")).alias("ticket_numbers"))
    counted = shop.handoffs.select(_number(F.col("handoff_id")).alias("n")).agg(F.count("*").alias("handoffs"))
    above = shop.handoffs.select(_number(F.col("handoff_id")).alias("n")).join(F.broadcast(counted), F.col("n") > F.col("handoffs")).agg(F.collect_set("n").alias("handoff_numbers"))
    met = _told(_told(_told(asked, "address_id", address), "variant_id", option), "order_id", order, items, held, on_order)
    met = _told(met.join(recent, ["owner", "now"], "left"), "customer_id", tickets).join(F.broadcast(counted), F.lit(True)).join(F.broadcast(above), F.lit(True))
    item = "array<struct<line_no:int,variant_id:string,product_id:string,quantity:bigint,unit_won:bigint,status:string>>"
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("on_order", "recent", "tickets")}
    none = {c: F.coalesce(c, F.array().cast("array<bigint>")) for c in ("ticket_numbers", "handoff_numbers")}
    return met.withColumns(zero | none | {"items": F.coalesce(F.col("items").cast(item), F.array().cast(item)), "request_ids": F.coalesce("request_ids", F.array().cast("array<string>")), "defective": F.coalesce("defective", F.lit(False))})


def _free(count: Column, numbers: Column, made: Column) -> Column:
    """The number of a new id: the ``made``-th after the count that is not in use. Gaps below the count stay gaps."""
    return F.get(F.array_except(F.sequence(count + 1, count + 1 + F.size(numbers) + made.cast("long")), numbers), made)


def _line_key(order: Column, line: Column) -> Column:
    return F.concat_ws("#", order, line.cast("string"))


def _view(o: Column, x: Column) -> Column:
    """A call's facts under the overlay: what this conversation sees now."""
    key = lambda i: _line_key(x["order_id"], i["line_no"])
    now = lambda i: F.get(F.filter(o["lines"], lambda d: d["key"] == key(i)), F.lit(0))["status"]
    items = F.transform(x["items"], lambda i: F.struct(*(i[c].alias(c) for c in ("line_no", "variant_id", "product_id", "quantity", "unit_won")), F.coalesce(now(i), i["status"]).alias("status")))
    taken = F.aggregate(F.filter(o["taken"], lambda t: t["variant"] == x["variant_id"]), F.lit(0).cast("long"), lambda s, t: s + t["n"])
    moved = F.get(F.filter(o["addresses"], lambda m: m["order"] == x["order_id"]), F.lit(0))["address"]
    chosen = lambda all_: F.filter(all_, lambda i: F.array_contains(F.coalesce(x["asked_lines"], F.array().cast("array<int>")), i["line_no"]))
    return let(
        items,
        lambda all_: F.struct(
            F.when(F.array_contains(o["cancelled"], x["order_id"]), "cancelled").otherwise(x["status"]).alias("status"),
            chosen(all_).alias("chosen"),
            all_.alias("items"),
            (x["stock"] - taken).alias("stock"),
            F.coalesce(moved, x["ship_address_id"]).alias("address"),
            (x["on_order"] + F.size(F.filter(o["coupons"], lambda c: c == x["order_id"]))).alias("on_order"),
            (x["recent"] + F.size(o["coupons"])).alias("recent"),
            (x["defective"] | F.array_contains(o["defective"], x["order_id"])).alias("defective"),
        ),
    )


def _claim(x: Column, v: Column) -> Column:
    """The coupon that is due; null if none is."""
    delayed = F.when(x["promised_by"].isNull(), None).otherwise(rules.compensation(x["reason"], rules.delay_days(x["promised_by"], x["delivered_at"], x["now"])))
    return F.when(x["reason"] == "defective_item", F.when(v["defective"], rules.DEFECTIVE)).otherwise(delayed)


def _failures(o: Column, x: Column, v: Column) -> Column:
    """(code, policy) of every check that the call fails, in the order in which they are made."""
    tool, order = x["tool"], x["order_id"]
    request = F.concat(F.when(tool == "request_exchange", "EX-").otherwise("RT-"), order, F.lit("-"), F.get(x["asked_lines"], F.lit(0)).cast("string"))
    item = F.get(v["chosen"], F.lit(0))
    lines_bad = x["asked_lines"].isNull() | (F.size(x["asked_lines"]) == 0) | F.exists(x["asked_lines"], lambda n: n.isNull() | ~n.between(1, 999)) | (F.size(F.array_distinct(x["asked_lines"])) < F.size(x["asked_lines"])) | (F.size(x["asked_lines"]) > MOST_LINES)
    own = [
        ("identity_not_verified", False, x["customer_id"].isNull()),
        ("order_not_found", False, x["owner"].isNull()),
        ("not_order_owner", False, x["owner"] != x["customer_id"]),
    ]
    no_order, closed = ("invalid_arguments", False, order.isNull()), ("already_cancelled", False, v["status"] == "cancelled")
    missing = ("line_not_found", False, F.size(v["chosen"]) < F.size(x["asked_lines"]))
    busy = [("already_cancelled", False, F.exists(v["chosen"], lambda i: i["status"] == "cancelled")), ("already_requested", False, F.exists(v["chosen"], lambda i: i["status"] != "ordered"))]
    again = ("already_requested", False, F.array_contains(x["request_ids"], request) | F.array_contains(o["requests"], request))
    late = ~rules.in_return_window(x["now"], x["delivered_at"])

    def delivered(kind: str) -> list:
        done = v["status"] == "delivered"
        return [(f"{kind}_not_delivered", True, ~done), ("shipment_not_found", False, done & x["delivered_at"].isNull()), (f"{kind}_window_expired", True, late)]

    moving = v["status"].isin(*CANCELLABLE)
    checks = {
        "cancel_order": [no_order, *own, closed, ("cancel_not_allowed_status", True, ~moving)],
        "request_return": [("invalid_arguments", False, order.isNull() | lines_bad | ~F.coalesce(x["reason"].isin(*REQUEST_REASONS), F.lit(False))), *own, missing, closed, *busy, again, *delivered("return")],
        "request_exchange": [
            ("invalid_arguments", False, order.isNull() | lines_bad | x["variant_id"].isNull() | ~F.coalesce(x["reason"].isin(*REQUEST_REASONS), F.lit(False))),
            *own,
            missing,
            ("variant_not_found", False, x["stock"].isNull()),
            closed,
            *busy,
            again,
            ("same_variant", False, x["variant_id"] == item["variant_id"]),
            ("out_of_stock", False, v["stock"] < item["quantity"]),
            *delivered("exchange"),
            ("exchange_different_product", True, item["product_id"] != x["new_product"]),
        ],
        "change_shipping_address": [
            ("invalid_arguments", False, order.isNull() | x["address_id"].isNull()),
            *own,
            ("address_not_found", False, x["address_owner"].isNull()),
            ("address_not_owned", False, x["address_owner"] != x["owner"]),
            closed,
            ("same_address", False, v["address"] == x["address_id"]),
            ("address_change_not_allowed_status", True, ~moving),
        ],
        "issue_compensation_coupon": [
            ("invalid_arguments", False, order.isNull() | ~F.coalesce(x["reason"].isin(*COUPON_REASONS), F.lit(False))),
            *own,
            ("coupon_order_cancelled", True, v["status"] == "cancelled"),
            ("coupon_not_eligible", True, _claim(x, v).isNull()),
            ("coupon_already_issued_for_order", True, v["on_order"] > 0),
            ("coupon_limit_exceeded", True, v["recent"] >= rules.COUPON_LIMIT),
        ],
        "create_ticket": [own[0], *((c, p, (F.coalesce(order, F.lit("")) != "") & bad) for c, p, bad in own[1:])],
        "transfer_to_human": [],
    }
    found = F.array(F.struct(F.lit("unknown_tool").alias("code"), F.lit(False).alias("policy")))
    failed = lambda c: F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(policy).alias("policy"))) for code, policy, bad in c)))
    out = F.when(~F.coalesce(tool.isin(*TOOLS), F.lit(False)), found)
    for name, c in checks.items():
        out = out.when(tool == name, failed(c) if c else F.array().cast("array<struct<code:string,policy:boolean>>"))
    return out


def _effect(o: Column, x: Column, v: Column) -> Column:
    """(made, amount, changes, next overlay) of a call that is accepted."""
    tool, order = x["tool"], x["order_id"]
    text = lambda c: c.cast("string")
    cell = lambda table, key, field, base, was, now: F.struct(F.lit(table).alias("table"), key.alias("key"), F.lit(field).alias("field"), text(base).alias("base"), text(was).alias("was"), text(now).alias("now"))
    null, no_n = F.lit(None).cast("string"), F.lit(None).cast("long")
    new = lambda table, key, **fields: [cell(table, key, f, null, null, c) for f, c in fields.items()]
    base = lambda i: F.get(F.filter(x["items"], lambda b: b["line_no"] == i["line_no"]), F.lit(0))["status"]
    line = lambda i, status: cell("lines", _line_key(order, i["line_no"]), "status", base(i), i["status"], F.lit(status))
    item, first = F.get(v["chosen"], F.lit(0)), text(F.get(x["asked_lines"], F.lit(0)))
    request = F.concat(F.when(tool == "request_exchange", "EX-").otherwise("RT-"), order, F.lit("-"), first)
    goods = F.aggregate(v["chosen"], F.lit(0).cast("long"), lambda s, i: s + i["quantity"] * i["unit_won"])
    back = rules.refund(goods, F.when(x["reason"] == "changed_mind", "changed_mind").otherwise("other")).cast("long")
    coupon = F.concat(F.lit("CP-"), order, F.lit("-"), text(v["on_order"] + 1))
    due = F.coalesce(_claim(x, v), rules.fallback_compensation(x["reason"])).cast("long")
    ticket = F.concat(F.lit("TK-"), x["customer_id"], F.lit("-"), text(_free(x["tickets"], x["ticket_numbers"], o["tickets"])))
    handoff = F.concat(F.lit("HO-"), text(_free(x["handoffs"], x["handoff_numbers"], o["handoffs"])))
    after = lambda status: F.transform(v["chosen"], lambda i: F.struct(_line_key(order, i["line_no"]).alias("key"), F.lit(status).alias("status")))
    every = F.transform(v["items"], lambda i: F.struct(_line_key(order, i["line_no"]).alias("key"), F.lit("cancelled").alias("status")))
    is_ = lambda name: tool == name
    case = lambda default, **by: _case(tool, default, by)
    none = F.array().cast(f"array<{CHANGE}>")
    made = case(null, request_return=request, request_exchange=request, issue_compensation_coupon=coupon, create_ticket=ticket, transfer_to_human=handoff)
    amount = case(no_n, cancel_order=x["amount_won"].cast("long"), request_return=back, request_exchange=F.lit(0).cast("long"), issue_compensation_coupon=due)
    changes = case(
        none,
        cancel_order=F.concat(
            F.array(cell("orders", order, "status", x["status"], v["status"], F.lit("cancelled")), cell("payments", order, "refund_won", null, null, x["amount_won"])),
            F.transform(v["items"], lambda i: line(i, "cancelled")),
        ),
        request_return=F.concat(F.array(*new("requests", request, kind=F.lit("return"), lines=F.array_join(F.transform(v["chosen"], lambda i: text(i["line_no"])), ","), reason=x["reason"], refund_won=back)), F.transform(v["chosen"], lambda i: line(i, "return_requested"))),
        request_exchange=F.array(
            *new("requests", request, kind=F.lit("exchange"), lines=first, reason=x["reason"], variant=x["variant_id"]),
            line(item, "exchange_requested"),
            cell("variants", x["variant_id"], "stock", x["stock"], v["stock"], v["stock"] - item["quantity"]),
        ),
        change_shipping_address=F.array(cell("orders", order, "ship_address_id", x["ship_address_id"], v["address"], x["address_id"])),
        issue_compensation_coupon=F.array(*new("coupons", coupon, amount_won=due, reason=x["reason"])),
        create_ticket=F.array(*new("tickets", ticket, customer_id=x["customer_id"], order_id=F.nullif(order, F.lit("")))),
        transfer_to_human=F.array(*new("handoffs", handoff, customer_id=F.coalesce(x["customer_id"], F.lit("")))),
    )
    put = lambda name, when, more: F.when(when, F.concat(more, o[name])).otherwise(o[name]).alias(name)  # noqa: E731  the newest first
    requested = is_("request_return") | is_("request_exchange")
    overlay = F.struct(
        put("cancelled", is_("cancel_order"), F.array(order)),
        F.concat(case(F.array().cast("array<struct<key:string,status:string>>"), cancel_order=every, request_return=after("return_requested"), request_exchange=after("exchange_requested")), o["lines"]).alias("lines"),
        put("requests", requested, F.array(request)),
        put("defective", requested & (x["reason"] == "defective"), F.array(order)),
        put("taken", is_("request_exchange"), F.array(F.struct(x["variant_id"].alias("variant"), item["quantity"].alias("n")))),
        put("addresses", is_("change_shipping_address"), F.array(F.struct(order.alias("order"), x["address_id"].alias("address")))),
        put("coupons", is_("issue_compensation_coupon"), F.array(order)),
        (o["tickets"] + is_("create_ticket").cast("int")).alias("tickets"),
        (o["handoffs"] + is_("transfer_to_human").cast("int")).alias("handoffs"),
    )
    return F.struct(made.alias("made"), amount.alias("amount"), changes.alias("changes"), overlay.cast(_OVERLAY).alias("overlay"))


def _case(tool: Column, default: Column, by: dict[str, Column]) -> Column:
    out = None
    for name, value in by.items():
        out = F.when(tool == name, value) if out is None else out.when(tool == name, value)
    return out.otherwise(default)


def _step(a: Column, x: Column) -> Column:
    """One call: checked under the overlay; then either all of its effect holds, or none."""

    def decided(v: Column, f: Column) -> Column:
        refusal = F.get(F.filter(f, lambda c: x["strict"] | ~c["policy"]), F.lit(0))
        passed = F.when(refusal.isNull(), F.transform(F.filter(f, lambda c: c["policy"]), lambda c: c["code"])).otherwise(F.array().cast("array<string>"))

        def after(e: Column) -> Column:
            done = F.struct(
                x["place"].alias("place"), x["tool"].alias("tool"), refusal["code"].alias("code"), F.coalesce(refusal["policy"], F.lit(False)).alias("policy"), passed.alias("violations"),
                e["made"].alias("made"), e["amount"].alias("amount"), F.coalesce(e["changes"], F.array().cast(f"array<{CHANGE}>")).alias("changes"),
            )
            kept = F.when(e.isNull() | x["dry"], a["overlay"]).otherwise(e["overlay"])
            return F.struct(kept.alias("overlay"), F.concat(a["done"], F.array(done.cast(_DONE))).alias("done"))

        return let(F.when(refusal.isNull(), _effect(a["overlay"], x, v)), after)

    return let(_view(a["overlay"], x), lambda v: let(_failures(a["overlay"], x, v), lambda f: decided(v, f)))


def run(calls: DataFrame, shop: Shop) -> DataFrame:
    """(of, place, tool, dry, code, policy, violations, made, amount, changes) of every call, in order within its conversation.

    ``code`` is why it was refused (null: accepted); ``policy`` whether a policy did so; ``violations`` the policies that
    it broke and that let it pass; ``made`` the id of a new row and ``amount`` what is paid back or given; ``changes`` the
    cells that it changed, or in a dry run would. A tool that is not known is refused with ``unknown_tool``."""
    facts = with_facts(calls, shop)
    names = [c for c in facts.columns if c not in ("of", "place", "args")]
    listed = facts.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("place", *names))).alias("calls"))
    empty = F.from_json(F.lit('{"cancelled":[],"lines":[],"requests":[],"defective":[],"taken":[],"addresses":[],"coupons":[],"tickets":0,"handoffs":0}'), _OVERLAY)
    start = F.struct(empty.alias("overlay"), F.array().cast(f"array<{_DONE}>").alias("done"))
    folded = listed.select("of", "calls", F.aggregate("calls", start, _step, lambda a: a["done"]).alias("done"))
    each = folded.select("of", F.explode(F.arrays_zip("calls", "done")).alias("z"))
    return each.select("of", "z.done.place", "z.done.tool", F.col("z.calls.dry").alias("dry"), *(f"z.done.{c}" for c in ("code", "policy", "violations", "made", "amount", "changes")))


def end_cells(done: DataFrame) -> DataFrame:
    """(of, table, key, field, base, now): the cells in which a conversation's end state differs from the tables."""
    each = done.filter("code IS NULL AND NOT dry").select("of", "place", F.posexplode("changes").alias("at", "c")).select("of", "place", "at", "c.*")
    last = each.groupBy("of", "table", "key", "field").agg(F.max_by("now", F.struct("place", "at")).alias("now"), F.max_by("base", F.struct("place", "at")).alias("base"))
    return last.filter("NOT now <=> base").select("of", "table", "key", "field", "base", "now")


def cell_bits(*parts: Column | str) -> Column:
    """60 bits of a cell's digest."""
    return row_bits(*(F.col(p) if isinstance(p, str) else p for p in parts))


def base_cells(tables: dict[str, tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """(table, key, field, value) of tables given as {name: (rows, key columns, fields)}."""
    out = None
    for name, (rows, key, fields) in tables.items():
        cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
        part = rows.select(F.lit(name).alias("table"), F.concat_ws("#", *key).alias("key"), F.inline(cells))
        out = part if out is None else out.union(part)
    return out


def end_hashes(ids: DataFrame, done: DataFrame, cells: DataFrame) -> DataFrame:
    """(of, problems, hash) of every conversation of ``ids`` (of): how many calls were refused, and the fingerprint of all
    cells as its calls leave them, null if any was refused. The fingerprint is a sum over cells, so it moves by the changed ones."""
    total = cells.agg(F.coalesce(F.sum(cell_bits("table", "key", "field", "value")), F.lit(0)).alias("total"))
    moved = cell_bits("table", "key", "field", "now") - F.when(F.col("base").isNull(), F.lit(0)).otherwise(cell_bits("table", "key", "field", "base"))
    deltas = end_cells(done).groupBy("of").agg(F.sum(moved).alias("delta"))
    refused = done.groupBy("of").agg(F.count("code").alias("problems"))
    by = ids.select("of").distinct().join(refused, "of", "left").join(deltas, "of", "left").join(F.broadcast(total), F.lit(True))
    problems = F.coalesce("problems", F.lit(0))
    return by.select("of", problems.alias("problems"), F.when(problems == 0, (F.col("total") + F.coalesce("delta", F.lit(0))).cast("string")).alias("hash"))


def forbidden_problems(tasks: DataFrame, shop: Shop) -> DataFrame:
    """(id, place, problem): what is wrong with the calls that tasks forbid.

    ``tasks`` has (id, customer_id, now, gold_actions, gold_verified, forbidden_actions with expect_code). Each forbidden call
    branches off the task's end state on an overlay of its own, once strict and once lenient. It must be refused by the
    policy that it names, and without policies it must run and change something; else the two do not differ."""
    base = tasks.select("id", "customer_id", F.col("now").cast("timestamp").alias("now"), "gold_actions", "gold_verified", F.posexplode("forbidden_actions").alias("nth", "f"))
    modes = base.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("mode"))
    call = lambda a, strict, customer: F.struct(a["tool"].alias("tool"), a["args"].alias("args"), strict.alias("strict"), customer.alias("customer_id"))
    gold = F.transform("gold_actions", lambda a: call(a, F.lit(True), F.when(F.col("gold_verified"), F.col("customer_id"))))
    branch = modes.select(F.struct("id", "nth", "mode").alias("of"), "now", F.posexplode(F.concat(gold, F.array(call(F.col("f"), F.col("mode"), F.col("customer_id"))))).alias("place", "c"), F.size("gold_actions").alias("last"), F.col("f.expect_code").alias("expected"))
    calls = branch.select("of", "place", "c.tool", "c.args", "c.customer_id", "now", "c.strict", F.lit(False).alias("dry"))
    ends = branch.filter("place = last").select(F.col("of").alias("branch"), F.col("place").alias("at"), "expected")
    met = run(calls, shop).join(ends, (F.col("of") == F.col("branch")) & (F.col("place") == F.col("at")))
    changed = F.exists("changes", lambda c: ~c["was"].eqNullSafe(c["now"]))
    strict = F.when(F.col("code").isNull(), "not_refused").when(~F.col("policy") | ~F.col("code").eqNullSafe(F.col("expected")), "wrong_code")
    lenient = F.when(F.col("code").isNotNull(), "does_not_run").when(~changed, "changes_nothing")
    problem = F.when(F.col("of.mode"), strict).otherwise(lenient)
    return met.select(F.col("of.id").alias("id"), F.col("of.nth").alias("place"), problem.alias("problem")).filter("problem IS NOT NULL")


def unobtainable(tasks: DataFrame, texts: DataFrame, outputs: DataFrame) -> DataFrame:
    """(id, label): required values of tasks that neither the texts which reads give on their customer (customer_id, text) nor
    the outputs of their own calls (of, text) tell. A label with several values is named if any of them is nowhere."""
    from tidemill.operators.tasks import value_found

    wanted = tasks.select("id", "customer_id", F.explode("required_values").alias("v")).select("id", "customer_id", "v.label", "v.kind", "v.value").distinct()
    tells = value_found(F.col("kind"), F.col("value"), F.col("text"))
    read = wanted.join(texts.select("customer_id", "text"), "customer_id").filter(tells)
    told = wanted.join(outputs.select(F.col("of").alias("id"), "text"), "id").filter(tells)
    names = ["id", "label", "kind", "value"]
    found = read.select(*names).union(told.select(*names)).distinct()
    return wanted.join(found, names, "left_anti").select("id", "label").distinct()
