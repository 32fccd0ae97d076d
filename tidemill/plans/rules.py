"""Business rules bound to orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import rules as rule
from tidemill.registry import query, table

_NOW = "1997-06-15 20:30:00"
_LABELS = {"F": "완료", "O": "진행 중", "P": "일부 진행"}
_REASON = "CASE WHEN l_returnflag = 'R' THEN 'changed_mind' ELSE 'defective_item' END"


def _now():
    return F.lit(_NOW).cast("timestamp")


@query(
    "SELECT event_id, (ts + INTERVAL 9 HOUR)::DATE::VARCHAR AS local_date, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS local_minute FROM events"
)
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times in local time: date, and minute as text."""
    return table(spark, sf_dir, "events").select("event_id", rule.local_date(F.col("ts")).cast("string").alias("local_date"), rule.local_minute(F.col("ts")).alias("local_minute"))


@query(
    "SELECT l_orderkey, l_linenumber, ((l_shipdate + INTERVAL 9 HOUR)::DATE + 7)::VARCHAR AS deadline, "
    f"(TIMESTAMP '{_NOW}' + INTERVAL 9 HOUR)::DATE <= (l_shipdate + INTERVAL 9 HOUR)::DATE + 7 AS in_window FROM lineitem"
)
def return_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last day to return each line, and whether today is no later."""
    shipped = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rule.return_deadline(shipped).cast("string").alias("deadline"), rule.in_return_window(_now(), shipped).alias("in_window"))


@query(
    f"SELECT l_orderkey, {_REASON} AS reason, greatest(0, sum(round(l_extendedprice)::BIGINT)::BIGINT - CASE WHEN {_REASON} = 'changed_mind' THEN 3000 ELSE 0 END) AS refund, "
    "CASE WHEN sum(round(l_extendedprice)::BIGINT) >= 30000 THEN 0 ELSE 3000 END AS shipping FROM lineitem GROUP BY 1, 2"
)
def refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refund of each order and reason, the fee taken once, and the shipping fee of the goods."""
    reason = F.when(F.col("l_returnflag") == "R", "changed_mind").otherwise("defective_item")
    goods = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", reason.alias("reason")).agg(F.sum(F.round("l_extendedprice").cast("long")).alias("goods"))
    return goods.select("l_orderkey", "reason", rule.refund(F.col("goods"), F.col("reason")).cast("long").alias("refund"), rule.shipping_fee(F.col("goods")).alias("shipping"))


_DELAY = "date_diff('day', (o_orderdate + INTERVAL 9 HOUR)::DATE + 30, (coalesce(shipped, TIMESTAMP '1997-06-15 20:30:00') + INTERVAL 9 HOUR)::DATE)"


@query(
    "WITH s AS (SELECT l_orderkey, max(l_shipdate) FILTER (l_linestatus = 'F') AS shipped FROM lineitem GROUP BY 1), "
    f"d AS (SELECT o_orderkey, o_orderpriority, {_DELAY} AS days FROM orders LEFT JOIN s ON l_orderkey = o_orderkey) "
    "SELECT o_orderkey, days, CASE WHEN o_orderpriority = '5-LOW' THEN 3000 WHEN days <= 0 THEN NULL WHEN days >= 3 THEN 5000 ELSE 2000 END AS amount, "
    "CASE WHEN o_orderpriority = '5-LOW' THEN 3000 ELSE 2000 END AS fallback FROM d"
)
def delay_compensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of delay of each order, the coupon due, and the amount if one passes without a claim."""
    shipped = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    o = table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    reason = F.when(F.col("o_orderpriority") == "5-LOW", "defective_item").otherwise("delivery_delay")
    promised = F.date_add(rule.local_date(F.col("o_orderdate")), 30)
    days = rule.delay_days(promised, F.col("shipped").cast("timestamp"), _now())
    return o.select("o_orderkey", days.alias("days"), rule.compensation(reason, days).alias("amount"), rule.fallback_compensation(reason).alias("fallback"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '완료' WHEN 'O' THEN '진행 중' WHEN 'P' THEN '일부 진행' END AS label, replace(format('{:,}', round(o_totalprice)::BIGINT), '''', '') || '원' AS amount FROM orders")
def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of status codes (an unknown one is an error) and amounts with thousands."""
    return table(spark, sf_dir, "orders").select("o_orderkey", rule.label(F.col("o_orderstatus"), _LABELS).alias("label"), rule.amount(F.round("o_totalprice").cast("long")).alias("amount"))


@query("SELECT o_orderkey, ('0x' || substr(sha256(concat_ws('|', 20260919, o_orderkey, o_custkey, 'user', 0)), 1, 8))::BIGINT % 2147483648 AS seed FROM orders")
def derived_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds from base, task, trial, role and call."""
    seed = rule.derived_seed(F.lit(20260919), F.col("o_orderkey"), F.col("o_custkey"), F.lit("user"), F.lit(0))
    return table(spark, sf_dir, "orders").select("o_orderkey", seed.alias("seed"))


_CHECKS = [
    ("not_found", "o_custkey % 97 = 0", lambda: F.col("o_custkey") % 97 == 0),
    ("wrong_status", "o_orderstatus = 'O'", lambda: F.col("o_orderstatus") == "O"),
    ("too_late", "o_orderdate < TIMESTAMP '1995-01-01'", lambda: F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")),
    ("amount_limit", "o_totalprice > 250000", lambda: F.col("o_totalprice") > 250000),
]


@query("SELECT o_orderkey, CASE " + " ".join(f"WHEN {sql} THEN '{code}'" for code, sql, _ in _CHECKS) + " END AS code FROM orders")
def strict_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failed check of each request, which refuses it."""
    return table(spark, sf_dir, "orders").select("o_orderkey", rule.first_failure([(code, c()) for code, _, c in _CHECKS]).alias("code"))


@query("SELECT o_orderkey, concat_ws(',', " + ", ".join(f"CASE WHEN {sql} THEN '{code}' END" for code, sql, _ in _CHECKS) + ") AS codes FROM orders")
def lenient_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All failed checks of each request, which are recorded while it goes on."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(rule.all_failures([(code, c()) for code, _, c in _CHECKS]), ",").alias("codes"))


@query("SELECT o_orderkey, concat_ws(', ', 'status ' || o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'ordered ' || strftime(o_orderdate, '%Y-%m-%d') END) AS facts FROM orders")
def error_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refusal says about the order."""
    done = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("ordered "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(", ", F.concat(F.lit("status "), "o_orderstatus"), done).alias("facts"))


@query("SELECT o_custkey, round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_totalprice > 100000), 0), 6) AS share FROM orders GROUP BY 1")
def guarded_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate with a guard against a zero denominator."""
    share = rule.share(F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_totalprice") > 100000))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(share, 6).alias("share"))


_DAY = "date_diff('day', DATE '1970-01-01', (o_orderdate + INTERVAL 9 HOUR)::DATE)"


@query(
    f"SELECT o_custkey, o_orderkey, count(*) OVER w AS recent, count(*) OVER w > 2 AS over_limit FROM (SELECT *, {_DAY} AS day FROM orders) "
    "WINDOW w AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)"
)
def trailing_30_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a customer's orders lie in the 30 local days up to each, and whether that is over the limit."""
    day = F.datediff(rule.local_date(F.col("o_orderdate")), F.lit("1970-01-01").cast("date"))
    recent = F.count("*").over(Window.partitionBy("o_custkey").orderBy("day").rangeBetween(1 - rule.COUPON_DAYS, 0))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("day")).withColumn("recent", recent)
    return o.select("o_custkey", "o_orderkey", "recent", (F.col("recent") > rule.COUPON_LIMIT).alias("over_limit"))


@query(
    "SELECT l_orderkey, l_linenumber, coalesce(sum(round(l_extendedprice)::BIGINT) OVER w, 0)::BIGINT AS earlier, "
    "coalesce(sum(round(l_extendedprice)::BIGINT) OVER w, 0)::BIGINT + round(l_extendedprice)::BIGINT >= 100000 AS needs_approval FROM lineitem "
    "WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
def approval_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refunds already asked for an order, and whether they and the new one reach the threshold."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    won = F.round("l_extendedprice").cast("long")
    earlier = F.coalesce(F.sum(won).over(w), F.lit(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", earlier.alias("earlier"), (earlier + won >= 100000).alias("needs_approval"))
