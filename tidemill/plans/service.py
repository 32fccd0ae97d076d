"""Approvals and session turns, over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import approvals as op
from tidemill.registry import query, table
from tidemill.streaming import turns


def approval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of each order: its status, a request to return each of its returned lines, by two sessions, requests to cancel,
    a change of status for some, and decisions on all, some twice."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice").cast("long").alias("won"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.round("l_extendedprice")).cast("long").alias("won"))
    k, none, no_lines = F.col("o_orderkey"), F.lit(None).cast("string"), F.array().cast("array<int>")
    session = F.concat(F.lit("S"), (k % 2).cast("string"))
    status = F.when(F.col("o_orderstatus") == "O", "paid").when(F.col("o_orderstatus") == "F", "delivered").otherwise("shipping")

    def entry(at, kind, session, tool=none, lines=no_lines, refund=None, approve=None, status=none):
        return F.struct(
            F.lit(at).alias("at") if isinstance(at, int) else at.cast("int").alias("at"), F.lit(kind).alias("kind"), session.alias("session"), (F.lit(tool) if isinstance(tool, str) else tool).alias("tool"), lines.alias("lines"),
            (F.lit(None).cast("long") if refund is None else refund.cast("long")).alias("refund"), (F.lit(None).cast("boolean") if approve is None else approve).alias("approve"), status.alias("status"),
        )

    of_order = F.array(
        entry(0, "status", none, status=status),
        entry(100, "ask", session, "cancel_order", refund=F.col("won")),
        entry(101, "ask", session, "cancel_order", refund=F.col("won")),
        F.when(k % 5 == 0, entry(150, "status", none, status=F.lit("shipping"))),
        entry(200, "decide", session, "cancel_order", approve=k % 3 > 0),
        F.when(k % 7 == 0, entry(201, "decide", session, "cancel_order", approve=F.lit(True))),
    )
    n, one = F.col("l_linenumber"), F.array(F.col("l_linenumber").cast("int"))
    other = F.concat(F.lit("S"), (n % 2).cast("string"))
    of_line = F.array(
        entry(10 * n, "ask", other, "request_return", one, F.col("won")),
        F.when(n % 3 == 0, entry(10 * n + 1, "ask", other, "request_return", one, F.col("won"))),
        F.when(n % 2 == 0, entry(10 * n + 5, "decide", other, "request_return", one, approve=F.col("l_orderkey") % 4 > 0)),
    )
    each = o.select(k.alias("key"), F.inline(of_order)).union(lines.join(o.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_orderkey").alias("key"), F.inline(of_line)))
    # An entry that an order or a line has not is a null struct, which becomes a row of nulls.
    return each.filter("kind IS NOT NULL").withColumnRenamed("key", "order_id")


_LOG = """
s AS (SELECT o_orderkey AS o, CASE o_orderstatus WHEN 'O' THEN 'paid' WHEN 'F' THEN 'delivered' ELSE 'shipping' END AS status, round(o_totalprice)::BIGINT AS won, 'S' || o_orderkey % 2 AS who FROM orders),
l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(round(l_extendedprice)::BIGINT) AS won, 'S' || l_linenumber % 2 AS who FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2),
e AS (
  SELECT o, 0 AS pos, 'status' AS kind, NULL AS who, NULL AS tool, NULL::INT AS n, NULL::BIGINT AS won, NULL::BOOLEAN AS yes, status FROM s
  UNION ALL SELECT o, unnest([100, 101]), 'ask', who, 'cancel_order', NULL, won, NULL, NULL FROM s
  UNION ALL SELECT o, 150, 'status', NULL, NULL, NULL, NULL, NULL, 'shipping' FROM s WHERE o % 5 = 0
  UNION ALL SELECT o, 200, 'decide', who, 'cancel_order', NULL, NULL, o % 3 > 0, NULL FROM s
  UNION ALL SELECT o, 201, 'decide', who, 'cancel_order', NULL, NULL, true, NULL FROM s WHERE o % 7 = 0
  UNION ALL SELECT o, unnest(CASE WHEN n % 3 = 0 THEN [10 * n, 10 * n + 1] ELSE [10 * n] END), 'ask', who, 'request_return', n, won, NULL, NULL FROM l
  UNION ALL SELECT o, 10 * n + 5, 'decide', who, 'request_return', n, NULL, o % 4 > 0, NULL FROM l WHERE n % 2 = 0),
q AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY pos) AS k, coalesce(tool || ' ' || coalesce(n::VARCHAR, ''), '') AS target FROM e),
r AS (
  SELECT o_orderkey AS o, 0::BIGINT AS k, 0 AS pos, '' AS kind, NULL::VARCHAR AS who, '' AS target, '' AS outcome, NULL::INTEGER AS number, NULL::BIGINT AS total, '' AS st, []::STRUCT(who VARCHAR, target VARCHAR, won BIGINT, number INTEGER)[] AS open_, []::INT[] AS taken, 0::BIGINT AS paid, 0::INTEGER AS made FROM orders
  UNION ALL
  SELECT o, k, pos, kind, who, target, outcome, CASE WHEN outcome = 'queued' THEN made + 1 WHEN outcome <> 'executed' THEN p.number END, CASE WHEN kind = 'ask' THEN total END,
    CASE WHEN kind = 'status' THEN status WHEN outcome IN ('executed', 'approved') AND tool = 'cancel_order' THEN 'cancelled' ELSE st END,
    CASE WHEN kind = 'decide' THEN list_filter(open_, lambda x: NOT (x.who = who AND x.target = target)) WHEN outcome = 'queued' THEN list_append(open_, {'who': who, 'target': target, 'won': won, 'number': made + 1}) ELSE open_ END,
    CASE WHEN outcome IN ('executed', 'approved') AND tool = 'request_return' THEN list_append(taken, n) ELSE taken END,
    paid + CASE WHEN outcome IN ('executed', 'approved') AND tool = 'request_return' THEN back ELSE 0 END, made + (outcome = 'queued')::INT
  FROM (SELECT *, CASE kind WHEN 'status' THEN 'changed' WHEN 'ask' THEN CASE WHEN NOT free THEN 'refused' WHEN total < 100000 THEN 'executed' WHEN p IS NOT NULL THEN 'reused' ELSE 'queued' END
      ELSE CASE WHEN p IS NULL THEN 'conflict' WHEN NOT yes THEN 'rejected' WHEN free THEN 'approved' ELSE 'failed' END END AS outcome
    FROM (SELECT *, CASE WHEN kind = 'decide' THEN p.won ELSE won END AS back, CASE WHEN kind = 'decide' THEN p.won ELSE won END + CASE WHEN tool = 'cancel_order' THEN 0 ELSE paid END AS total,
        CASE tool WHEN 'cancel_order' THEN st IN ('paid', 'preparing') ELSE st = 'delivered' AND NOT list_contains(taken, n) END AS free
      FROM (SELECT q.*, st, open_, taken, paid, made, list_filter(open_, lambda x: x.who = q.who AND x.target = q.target)[1] AS p
        FROM (SELECT o AS ro, k AS rk, st, open_, taken, paid, made FROM r) JOIN q ON q.o = ro AND q.k = rk + 1))))
"""


@query(f"WITH RECURSIVE {_LOG.strip()} SELECT o AS order_id, pos, kind, who AS session, target, outcome, number, total FROM r WHERE k > 0", write=True)
def approval_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes of each request and decision: executed, refused, queued, reused, rejected, approved, failed, or a conflict."""
    return op.decide(approval_log(spark, sf_dir)).withColumnRenamed("at", "pos")


@query(
    f"WITH RECURSIVE {_LOG.strip()} SELECT o AS order_id, number, min(who) AS session, min(target) AS target, min(pos) AS asked_at, max(pos) FILTER (kind = 'decide') AS decided_at, coalesce(max(outcome) FILTER (kind = 'decide'), 'pending') AS status, count(*) FILTER (kind <> 'decide') AS times "
    "FROM r WHERE k > 0 AND number IS NOT NULL AND outcome <> 'conflict' GROUP BY o, number",
    write=True,
)
def approval_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every approval as its last version says."""
    return op.approvals(op.decide(approval_log(spark, sf_dir)))


def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which each reply makes one to four calls before it."""
    m = table(spark, sf_dir, "conversations")
    calls = F.transform(F.sequence(F.lit(1), (F.length("text") % 4 + 1).cast("int")), lambda j: F.struct(j.alias("j"), F.lit("tool").alias("role"), F.concat(F.lit("t"), ((F.col("turn") + j) % 3).cast("string")).alias("tool")))
    own = F.array(F.struct(F.lit(9).alias("j"), F.col("role"), F.lit(None).cast("string").alias("tool")))
    parts = m.select("conv_id", "turn", F.explode(F.when(F.col("role") == "assistant", F.concat(calls, own)).otherwise(own)).alias("p"))
    return parts.select("conv_id", (F.col("turn") * 10 + F.col("p.j")).alias("turn"), "p.role", "p.tool")


@query(
    "WITH m AS (SELECT conv_id, turn * 10 + j AS turn, CASE WHEN j = 9 THEN role ELSE 'tool' END AS role, CASE WHEN j < 9 THEN 't' || (turn + j) % 3 END AS tool FROM conversations, (SELECT unnest([1, 2, 3, 4, 9]) AS j) WHERE j = 9 OR (role = 'assistant' AND j <= length(text) % 4 + 1)), "
    "t AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS turns, CASE WHEN role = 'tool' THEN count(*) OVER (PARTITION BY conv_id, tool ORDER BY turn) ELSE 0 END AS tool_calls FROM m), "
    "c AS (SELECT *, count(*) FILTER (role = 'tool') OVER (PARTITION BY conv_id, turns ORDER BY turn) AS calls FROM t) "
    "SELECT conv_id, turn, role, turns, calls, tool_calls, CASE WHEN turns > 3 THEN 'closed' WHEN role = 'tool' AND calls > 2 THEN 'limited' WHEN role = 'tool' THEN 'called' WHEN role = 'user' THEN 'asked' ELSE 'replied' END AS outcome FROM c"
)
def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of sessions that may make two calls a turn and are closed after three."""
    return turns.turns(session_messages(spark, sf_dir), 2, 3)
