"""Comparability of runs, alignment of reruns, gates and tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as fn
from tidemill.operators import compare as op
from tidemill.operators import conversation
from tidemill.registry import query, table


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), "o_orderpriority")
    return o.filter("o_orderpriority = '1-URGENT'"), o.filter("o_orderpriority = '5-LOW'")


@query(
    "WITH a AS (SELECT o_custkey AS task, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT o_custkey AS task, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) "
    "SELECT coalesce(a.task, b.task) AS task, coalesce(a.n, 0) AS base, coalesce(b.n, 0) AS other FROM a FULL JOIN b ON a.task = b.task WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"
)
def pairing_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that two runs didn't try equally often."""
    return op.uneven_trials(*_runs(spark, sf_dir), "task")


@query(
    "WITH c AS (SELECT l_returnflag AS run, l_linestatus AS axis, (count(*) % 5)::VARCHAR AS v FROM lineitem GROUP BY 1, 2), a AS (SELECT * FROM c WHERE run = 'A'), b AS (SELECT * FROM c WHERE run = 'R') "
    "SELECT coalesce(a.axis, b.axis) AS axis, coalesce(a.v, 'off') AS base, coalesce(b.v, 'off') AS other, coalesce(a.axis, b.axis) = 'F' AS known FROM a FULL JOIN b ON a.axis = b.axis "
    "WHERE coalesce(a.v, 'off') <> coalesce(b.v, 'off')"
)
def device_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes on which two runs differ, and whether each is known."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("axis")).agg((F.count("*") % 5).cast("string").alias("v"))
    apart = op.settings_apart(c.filter("run = 'A'"), c.filter("run = 'R'"), "axis", "v", "off")
    return op.axes_apart(apart, "axis", ["F"])


@query(
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderkey % 9 <> 0 AS recorded, o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 0 AS same FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)"
)
def replay_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a rerun held against the record: is the key there, and is the rest the same."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rerun = o.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, "Z").otherwise(F.col("o_orderstatus")))
    return op.aligned(rerun, o.filter("o_orderkey % 9 <> 0"), ["o_orderkey", "o_custkey"], ["o_orderstatus"])


@query(
    "WITH g AS (SELECT round(avg((l_returnflag = 'R')::INTEGER), 6) AS a, round(avg(l_discount), 6) AS b, max(l_quantity)::DOUBLE AS c FROM lineitem) "
    "SELECT 'returned' AS check, a AS value, a BETWEEN 0.2 AND 0.4 AS passed FROM g UNION ALL SELECT 'discount', b, b BETWEEN 0.2 AND 1 FROM g UNION ALL SELECT 'quantity', c, c BETWEEN 1 AND 50 FROM g"
)
def plan_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares and bounds that a plan must keep."""
    bounds = {
        "returned": (F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 6), 0.2, 0.4),
        "discount": (F.round(F.avg("l_discount"), 6), 0.2, 1.0),
        "quantity": (F.max("l_quantity"), 1.0, 50.0),
    }
    return op.gate(table(spark, sf_dir, "lineitem"), bounds)


_TURNS = "t AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM conversations)"


@query(f"WITH {_TURNS} SELECT role, exchange > 2 OR (exchange = 2 AND role <> 'user') AS after, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM t GROUP BY 1, 2")
def injection_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes before and after the second customer message."""
    m = conversation.turns(table(spark, sf_dir, "conversations"))
    after = (F.col("exchange") > 2) | ((F.col("exchange") == 2) & (F.col("role") != "user"))
    return m.groupBy("role", after.alias("after")).agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


@query(
    f"WITH {_TURNS}, e AS (SELECT conv_id, exchange, max(text) FILTER (role = 'user') AS said, arg_max(text, turn) FILTER (role = 'assistant') AS reply FROM t WHERE exchange > 0 GROUP BY 1, 2), "
    "l AS (SELECT *, lead(said) OVER (PARTITION BY conv_id ORDER BY exchange) AS answer FROM e) "
    "SELECT count(*) AS exchanges, count(reply) AS replied, count(answer) AS answered, count(*) FILTER (contains(answer, '?')) AS questions, max(exchange) AS longest FROM l"
)
def confirmation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over exchanges: replied to, answered, answered by a question."""
    return conversation.exchanges(table(spark, sf_dir, "conversations")).agg(
        F.count("*").alias("exchanges"), F.count("reply").alias("replied"), F.count("answer").alias("answered"), F.count_if(F.col("answer").contains("?")).alias("questions"), F.max("exchange").alias("longest")
    )


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def disagreeing_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose trials came out differently."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("a"), F.max("o_orderstatus").alias("z")).filter("a <> z").select("o_custkey")


@query(
    "WITH s AS (SELECT o_orderkey, o_custkey, contains((o_custkey * 1000 + o_orderkey % 1000)::VARCHAR, (o_orderkey % 10000)::VARCHAR) AS ok FROM orders) "
    "SELECT o_custkey, count(*) AS answers, count(*) FILTER (NOT ok) AS unexplained, bool_and(ok) AS all_explained FROM s GROUP BY o_custkey"
)
def grounding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with values that no source explains, by customer."""
    num = lambda c: F.concat(F.lit("num:"), c.cast("string"))
    o = table(spark, sf_dir, "orders").select("o_custkey", num(F.col("o_orderkey") % 10000).alias("stated"), F.array(num(F.col("o_custkey") * 1000 + F.col("o_orderkey") % 1000)).alias("sources"))
    ok = fn.grounded(F.col("stated"), F.col("sources"))
    return o.withColumn("ok", ok).groupBy("o_custkey").agg(F.count("*").alias("answers"), F.count_if(~F.col("ok")).alias("unexplained"), F.bool_and("ok").alias("all_explained"))
