"""Write operators over orders, lines and stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import rules
from tidemill.operators import writes as op
from tidemill.registry import query, table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice").cast("long").alias("won"))


_CANCEL = "CASE WHEN o_orderkey IS NULL THEN 'not_found' WHEN asker <> o_custkey THEN 'not_owner' WHEN o_orderstatus <> 'O' THEN 'not_cancellable' END"
_ASKED = "q AS (SELECT o_orderkey + CASE WHEN o_orderkey % 130 = 0 THEN 100000000 ELSE 0 END AS key, CASE WHEN o_orderkey % 26 = 0 THEN o_custkey ELSE o_custkey + o_orderkey % 3 END AS asker FROM orders)"


def _cancellations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    key = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 130 == 0, 100000000).otherwise(0)
    asker = F.when(F.col("o_orderkey") % 26 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + F.col("o_orderkey") % 3)
    asked = o.select(key.alias("o_orderkey"), asker.alias("asker"))
    return op.decide(asked, o, "o_orderkey", [("not_owner", F.col("asker") != F.col("o_custkey")), ("not_cancellable", F.col("o_orderstatus") != "O")])


@query(f"WITH {_ASKED} SELECT key AS o_orderkey, asker, {_CANCEL} AS code, CASE WHEN {_CANCEL} IS NULL THEN round(o_totalprice)::BIGINT END AS refund FROM q LEFT JOIN orders ON o_orderkey = key", write=True)
def cancel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancellations with their code, or the whole amount as refund."""
    d = _cancellations(spark, sf_dir)
    return d.select("o_orderkey", "asker", "code", F.when(F.col("code").isNull(), F.col("won")).alias("refund"))


@query(
    f"WITH {_ASKED}, a AS (SELECT o_orderkey FROM q JOIN orders ON o_orderkey = key WHERE {_CANCEL} IS NULL) "
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM a) THEN 'C' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice)::BIGINT AS won FROM orders",
    write=True,
)
def state_after_cancellations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders once the accepted cancellations hold."""
    return op.apply(_orders(spark, sf_dir), _cancellations(spark, sf_dir).filter("code IS NULL"), "o_orderkey", {"o_orderstatus": F.lit("C")})


@query(f"WITH {_ASKED} SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS was, 'C' AS would_be FROM q JOIN orders ON o_orderkey = key WHERE {_CANCEL} IS NULL", write=True)
def rehearsal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run of the cancellations would change; the state stays as it is."""
    return op.dry_run(_orders(spark, sf_dir), _cancellations(spark, sf_dir).filter("code IS NULL"), "o_orderkey", {"o_orderstatus": F.lit("C")})


_LATE = "(TIMESTAMP '1997-06-15 20:30:00' + INTERVAL 9 HOUR)::DATE > (l_shipdate + INTERVAL 9 HOUR)::DATE + 7"


_RETURN = f"CASE WHEN bool_or(l_linestatus <> 'F') THEN 'not_delivered' WHEN bool_or(l_returnflag = 'R') THEN 'already_requested' WHEN bool_or({_LATE}) THEN 'window_passed' END"


@query(
    f"SELECT l_orderkey, count(*) AS lines, {_RETURN} AS code, CASE WHEN {_RETURN} IS NULL THEN 'RT-' || l_orderkey END AS request_id, "
    f"CASE WHEN {_RETURN} IS NULL THEN greatest(0, sum(round(l_extendedprice)::BIGINT)::BIGINT - 3000) END AS refund FROM lineitem GROUP BY l_orderkey",
    write=True,
)
def request_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return requests of whole orders: the first rule that a line breaks refuses, else an id and a refund, the fee taken once."""
    now = F.lit("1997-06-15 20:30:00").cast("timestamp")
    late = ~rules.in_return_window(now, F.col("l_shipdate"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("lines"),
        F.sum(F.round("l_extendedprice").cast("long")).alias("goods"),
        F.bool_or(F.col("l_linestatus") != "F").alias("open"),
        F.bool_or(F.col("l_returnflag") == "R").alias("asked"),
        F.bool_or(late).alias("late"),
    )
    d = g.withColumn("code", rules.first_failure([("not_delivered", F.col("open")), ("already_requested", F.col("asked")), ("window_passed", F.col("late"))]))
    ok = F.col("code").isNull()
    return d.select(
        "l_orderkey",
        "lines",
        "code",
        F.when(ok, F.concat(F.lit("RT-"), F.col("l_orderkey").cast("string"))).alias("request_id"),
        F.when(ok, rules.refund(F.col("goods"), F.lit("changed_mind")).cast("long")).alias("refund"),
    )


@query(
    "WITH RECURSIVE q AS (SELECT l_partkey AS part, l_orderkey * 10 + l_linenumber AS pos, l_quantity::BIGINT AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber, l_quantity) AS k FROM lineitem), "
    "r AS (SELECT part, pos, n, k, n <= 200 AS accepted, CASE WHEN n <= 200 THEN 200 - n ELSE 200 END AS remaining FROM q WHERE k = 1 UNION ALL "
    "SELECT q.part, q.pos, q.n, q.k, q.n <= r.remaining, CASE WHEN q.n <= r.remaining THEN r.remaining - q.n ELSE r.remaining END FROM r JOIN q ON q.part = r.part AND q.k = r.k + 1) "
    "SELECT part, pos, n, accepted, remaining::BIGINT AS remaining FROM r",
    write=True,
)
def request_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges against the stock of each variant, in order; what is refused leaves the stock to later ones."""
    asked = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").cast("long").alias("n")
    )
    stock = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.lit(200).alias("stock"))
    return op.take_stock(asked, stock, "part", "pos", "n", "stock").withColumnRenamed("left", "remaining")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND c_custkey IS NOT NULL THEN c_name || ' 2F' ELSE 'as before' END AS ship_to FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 4 = 0",
    write=True,
)
def change_shipping_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's own address copied into the orders that haven't been shipped."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").join(c, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderkey") % 4 == 0), "left")
    copied = (F.col("o_orderstatus") == "O") & F.col("c_custkey").isNotNull()
    return o.select("o_orderkey", F.when(copied, F.concat("c_name", F.lit(" 2F"))).otherwise("as before").alias("ship_to"))


_DAY = "date_diff('day', DATE '1970-01-01', (o_orderdate + INTERVAL 9 HOUR)::DATE)"


@query(
    f"WITH RECURSIVE q AS (SELECT o_custkey, o_orderkey, {_DAY} AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY {_DAY}, o_orderkey) AS k FROM orders), "
    "r AS (SELECT *, true AS accepted, -1000000::BIGINT AS earlier, day AS last FROM q WHERE k = 1 UNION ALL "
    "SELECT q.o_custkey, q.o_orderkey, q.day, q.k, q.day - r.earlier >= 30, CASE WHEN q.day - r.earlier >= 30 THEN r.last ELSE r.earlier END, CASE WHEN q.day - r.earlier >= 30 THEN q.day ELSE r.last END "
    "FROM r JOIN q ON q.o_custkey = r.o_custkey AND q.k = r.k + 1) SELECT o_custkey, o_orderkey, day::INTEGER AS day, accepted FROM r",
    write=True,
)
def issue_compensation_coupon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupons in order of day, two at most within 30 days; refused ones don't count."""
    day = F.datediff(rules.local_date(F.col("o_orderdate")), F.lit("1970-01-01").cast("date"))
    asked = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("day"))
    return op.limit_trailing(asked, "o_custkey", "o_orderkey", "day", rules.COUPON_LIMIT, rules.COUPON_DAYS)


@query("SELECT 'TK-' || user_id || '-' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ticket_id, user_id, event_id FROM events WHERE event_type = 'error'", write=True)
def create_ticket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets numbered within their customer."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return e.select(F.concat_ws("-", F.lit("TK"), F.col("user_id").cast("string"), n.cast("string")).alias("ticket_id"), "user_id", "event_id")


@query("SELECT conv_id, 'HO-' || conv_id AS handoff_id, min(turn) AS ends_at FROM conversations WHERE role = 'system' GROUP BY conv_id", write=True)
def transfer_to_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One handoff for each conversation that asks for it, at the first request, which ends the conversation."""
    c = table(spark, sf_dir, "conversations").filter("role = 'system'").groupBy("conv_id").agg(F.min("turn").alias("ends_at"))
    return c.select("conv_id", F.concat(F.lit("HO-"), F.col("conv_id").cast("string")).alias("handoff_id"), "ends_at")


@query(
    "WITH a AS (SELECT l_orderkey, min(l_linenumber) AS first, sum(round(l_extendedprice)::BIGINT)::BIGINT AS won FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) "
    "SELECT l_orderkey, first, won, CASE WHEN won >= 60000 THEN 'queued' ELSE 'executed' END AS outcome FROM a",
    write=True,
)
def approval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of one target are one: over the threshold it waits for approval, else it is executed."""
    a = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first"), F.sum(F.round("l_extendedprice").cast("long")).alias("won"))
    return a.select("l_orderkey", "first", "won", F.when(F.col("won") >= 60000, "queued").otherwise("executed").alias("outcome"))


@query(
    "SELECT o_orderkey, CASE WHEN n > 1 AND r > 1 THEN 'conflict' WHEN o_orderstatus = 'O' THEN 'approved' ELSE 'failed' END AS decision FROM (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r "
    "FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority))",
    write=True,
)
def approval_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare and set: of decisions on one request the first wins, and is approved or failed by running it again."""
    w = Window.partitionBy("o_custkey", "o_orderpriority")
    first = F.row_number().over(w.orderBy("o_orderkey")) == 1
    decision = F.when(~first, "conflict").when(F.col("o_orderstatus") == "O", "approved").otherwise("failed")
    return table(spark, sf_dir, "orders").select("o_orderkey", decision.alias("decision"))


@query(
    "SELECT user_id, event_id, coalesce(lag(turn) OVER (PARTITION BY user_id, event_type ORDER BY turn) = turn - 1, false) AND value > 20 AS runs "
    "FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events)",
    write=True,
)
def confirm_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that run: previewed one turn before, and consented to."""
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", turn.alias("turn"), F.coalesce(F.col("value") > 20, F.lit(False)).alias("consent"))
    return op.confirm_gate(calls, "user_id", "turn", "event_type", "consent").select("user_id", "event_id", "runs")
