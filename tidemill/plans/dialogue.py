"""What customers make up, hear and consent to, over the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import consent
from tidemill.operators import confirm, invented
from tidemill.registry import query, table

_LEN = "CASE WHEN role = 'assistant' THEN (length(text) * 100019 + conv_id)::VARCHAR END"
_SAID = (
    f"n AS (SELECT *, {_LEN} AS told FROM conversations), "
    "l AS (SELECT *, last_value(told IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, "
    "first_value(told IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM n), "
    "u AS (SELECT conv_id AS conv, turn AS pos, CASE (turn + conv_id) % 3 WHEN 0 THEN substr(before, 2, 4) WHEN 1 THEN later ELSE (conv_id * 7919 + 40000)::VARCHAR END AS x FROM l WHERE role = 'user')"
)


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers who repeat part of the number told last, or tell the next one too early, or the same one each time; and what they hear."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    told = F.when(F.col("role") == "assistant", (F.length("text") * 100019 + F.col("conv_id")).cast("string"))
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", told.alias("told"))
    before = F.last("told", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("told", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    k = (F.col("turn") + F.col("conv_id")) % 3
    x = F.when(k == 0, F.substring(before, 2, 4)).when(k == 1, later).otherwise((F.col("conv_id") * 7919 + 40000).cast("string"))
    said = m.select("conv_id", "turn", "role", x.alias("x")).filter("role = 'user'").select(F.col("conv_id").alias("conv"), F.col("turn").alias("at"), F.concat(F.lit("number "), F.coalesce("x", F.lit("-")), F.lit(", please")).alias("text"))
    return said, m.filter("told IS NOT NULL").select(F.col("conv_id").alias("conv"), F.col("turn").alias("at"), F.concat(F.lit("It is "), "told", F.lit("원.")).alias("text"))


@query(
    f"WITH {_SAID} SELECT conv, pos, 'num:' || x AS missing FROM u WHERE length(x) >= 4 AND NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = conv AND turn < pos AND contains(told, x))"
)
def invented_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a customer states before anyone told them, be it as part of a longer number."""
    said, heard = _spoken(spark, sf_dir)
    return invented.invented(said, heard).select("conv", F.col("at").alias("pos"), F.array_join("missing", " ").alias("missing"))


@query(
    f"WITH {_SAID}, c AS (SELECT conv_id AS conv, max(turn) AS last, count(*) AS k, max(told) AS most FROM n GROUP BY 1), "
    "v AS (SELECT conv, CASE WHEN conv % 3 = 0 THEN most ELSE '88' || conv END AS value FROM c WHERE conv % 4 <> 3 AND (conv % 3 <> 0 OR most IS NOT NULL)), "
    "h AS (SELECT v.conv, NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = v.conv AND told = value) AS lacks FROM v) "
    "SELECT c.conv, CASE WHEN c.conv % 11 <> 0 THEN lacks END AS never_heard, CASE WHEN c.conv % 11 <> 0 AND lacks IS NOT NULL THEN lacks AND c.conv % 2 = 0 END AS stopped_before, "
    "CASE WHEN c.conv % 11 <> 0 AND k % 2 = 0 THEN c.conv % 2 = 0 AND last % 3 > 0 END AS stopped_with_writes FROM c LEFT JOIN h USING (conv)"
)
def simulated_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether customers stop before they heard what they had to hear, or with writes left."""
    _, heard = _spoken(spark, sf_dir)
    numbers = heard.select("conv", F.regexp_extract("text", r"(\d+)", 1).alias("told"))
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("conv")).agg(F.max("turn").alias("last"), F.count("*").alias("k")).join(numbers.groupBy("conv").agg(F.max("told").alias("most")), "conv", "left")
    value = F.when(F.col("conv") % 3 == 0, F.col("most")).otherwise(F.concat(F.lit("88"), "conv"))
    values = c.filter("conv % 4 <> 3").select("conv", F.lit("number").alias("kind"), value.alias("value")).filter("value IS NOT NULL")
    episodes = c.select("conv", (F.col("conv") % 11 == 0).alias("infra"), F.when(F.col("conv") % 2 == 0, "user_stop").otherwise("max_turns").alias("termination"), ((F.col("k") + 1) % 2).alias("gold"), (F.col("last") % 3).alias("missing_writes"))
    return invented.ends(episodes, values, heard)


_CALLS = (
    "m AS (SELECT conv_id AS conv, turn AS pos, role, (conv_id + turn) % 3 = 0 AS agrees, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations), "
    "s AS (SELECT *, last_value(CASE WHEN role = 'user' THEN agrees END IGNORE NULLS) OVER (PARTITION BY conv ORDER BY pos) AS consent FROM m), "
    "c AS (SELECT conv, pos * 2 + j AS pos, t, consent, pos % 5 <> 4 AS ok, 'request_return {\"line_nos\":\"[1,2]\",\"order_id\":\"O-' || (pos // 4) % 2 || '\"}' AS key FROM s, (SELECT unnest([0, 1]) AS j) WHERE role = 'assistant'), "
    "q AS (SELECT *, row_number() OVER (PARTITION BY conv, key ORDER BY pos) AS k FROM c), "
    "r AS (SELECT conv, key, 0 AS k, -1::BIGINT AS pending, NULL::BIGINT AS pos, NULL::VARCHAR AS outcome FROM q WHERE k = 1 UNION ALL "
    "SELECT q.conv, q.key, q.k, CASE WHEN pending = t - 1 AND consent THEN -1 WHEN ok THEN t ELSE pending END, q.pos, CASE WHEN NOT ok THEN 'refused' WHEN pending = t - 1 AND consent THEN 'ran' ELSE 'preview' END "
    "FROM r JOIN q ON q.conv = r.conv AND q.key = r.key AND q.k = r.k + 1)"
)


@query(f"WITH RECURSIVE {_CALLS} SELECT conv, pos, key, outcome FROM r WHERE k > 0", write=True)
def confirmed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, two for each reply, that run once the same call was previewed and consented to, however its arguments are written."""
    agrees = (F.col("conv_id") + F.col("turn")) % 3 == 0
    said = F.when(agrees, "네, 진행해 주세요").otherwise(F.concat(F.lit("잠깐만요. "), F.col("text")))
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").alias("at"), "role", said.alias("content"), F.lit(False).alias("harness"))
    last = F.last(F.when(F.col("role") == "user", F.col("content")), True).over(Window.partitionBy("conv").orderBy("at"))
    t = confirm.turns(m).withColumn("said", last).filter("role = 'assistant'").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    order = F.concat(F.lit("O-"), (F.expr("at div 4") % 2).cast("string"))
    one, other = F.format_string('{"order_id": "%s", "line_nos": [2, 1]}', order), F.format_string('{"line_nos":[1,2],"note":null,"order_id":"%s"}', order)
    calls = t.select("conv", (F.col("at") * 2 + F.col("j")).alias("at"), "turn", confirm.call_key(F.lit("request_return"), F.when(F.col("at") % 3 == 0, one).otherwise(other)).alias("key"), (consent.kind(F.col("said")) == "consent").alias("consent"), (F.col("at") % 5 != 4).alias("ok"))
    return confirm.gate(calls).withColumnRenamed("at", "pos")


_EXCHANGES = (
    "m AS (SELECT conv_id AS conv, turn, role, CASE (conv_id + turn) % 5 WHEN 0 THEN '네, 진행해 주세요' WHEN 1 THEN '아니요' WHEN 2 THEN '언제요?' ELSE '흠' END AS said, role = 'user' AND (conv_id + turn) % 7 <> 0 AS mine, conv_id + turn AS k, 1000 + turn AS won FROM conversations), "
    "t AS (SELECT *, count(*) FILTER (mine) OVER (PARTITION BY conv ORDER BY turn) AS t FROM m), "
    "b AS (SELECT conv, t, coalesce(sum(CASE WHEN role = 'assistant' THEN (k % 2 = 0)::INT + (k % 6 = 0)::INT END), 0)::BIGINT AS previews, "
    "coalesce(sum(CASE WHEN role = 'assistant' AND k % 2 = 0 THEN (k % 6 = 0)::INT END), 0)::BIGINT AS again, count(*) FILTER (role = 'assistant' AND k % 2 = 0) AS distinct_, "
    "list_sort(flatten(list(CASE WHEN k % 6 = 0 THEN [won, won] ELSE [won] END) FILTER (role = 'assistant' AND k % 2 = 0))) AS amounts, "
    "min(turn) FILTER (role = 'assistant' AND k % 2 = 0) AS first, max(turn) FILTER (role = 'assistant') AS last, count(*) FILTER (role = 'assistant' AND k % 5 < 2) AS ran, max(said) FILTER (mine) AS said FROM t GROUP BY 1, 2), "
    "x AS (SELECT *, lead(said) OVER w AS answer, coalesce(lead(ran) OVER w, 0) AS ran_next FROM b WINDOW w AS (PARTITION BY conv ORDER BY t)), "
    "f AS (SELECT conv, t AS turn, previews, previews - distinct_ AS repeats, array_to_string(amounts, ' ') AS amounts, len(list_filter(amounts, lambda a: a <> 1000 + last)) = 0 AND conv % 2 = 0 AS said_amounts, "
    "CASE answer WHEN '네, 진행해 주세요' THEN 'consent' WHEN '아니요' THEN 'refusal' WHEN '언제요?' THEN 'question' WHEN '흠' THEN 'other' ELSE 'none' END AS kind, CASE WHEN answer IS NULL THEN 0 ELSE ran_next END AS ran FROM x WHERE previews > 0)"
)


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, won = F.col("conv_id") + F.col("turn"), 1000 + F.col("turn")
    answer = F.when(k % 5 == 0, "네, 진행해 주세요").when(k % 5 == 1, "아니요").when(k % 5 == 2, "언제요?").otherwise("흠")
    body = F.to_json(F.struct(F.lit("cancel_order").alias("tool"), F.struct(F.concat(F.lit("O-"), F.col("turn").cast("string")).alias("order_id")).alias("arguments"), F.struct(won.alias("refund_won"), F.lit(0).alias("return_fee_won")).alias("preview")))
    shown = F.concat(F.lit(f"{confirm.PREVIEW}: please ask\n"), body)
    said = F.when(F.col("conv_id") % 2 == 0, F.format_string("환불 금액은 %s원입니다.", F.format_number(won, 0))).otherwise("확인했습니다.")
    message = lambda j, role, content, tool: F.struct(F.lit(j).alias("j"), F.lit(role).alias("role"), content.alias("content"), F.lit(tool).cast("string").alias("tool"))
    steps = F.array(
        F.when(k % 2 == 0, message(0, "tool", shown, "cancel_order")),
        F.when(k % 6 == 0, message(1, "tool", shown, "cancel_order")),
        F.when(k % 5 < 2, message(2, "tool", F.lit('{"ok": true}'), "create_ticket")),
        F.when(k % 5 == 3, message(3, "tool", F.lit("Error: [x] no"), "create_ticket")),
        message(4, "assistant", said, None),
    )
    parts = F.when(F.col("role") == "assistant", F.array_compact(steps)).when(F.col("role") == "user", F.array(message(0, "user", answer, None)))
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", (k % 7 == 0).alias("seventh"), F.explode(parts).alias("p"))
    return confirm.exchanges(m.select("conv", (F.col("turn") * 10 + F.col("p.j")).alias("at"), "p.role", "p.content", "p.tool", F.lit(True).alias("delivered"), (F.col("seventh") & (F.col("p.role") == "user")).alias("harness"), F.lit(False).alias("calls")))


@query(f"WITH {_EXCHANGES} SELECT * FROM f")
def confirmation_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with previewed calls, how the customer answered, and the writes that ran then."""
    return _exchanges(spark, sf_dir).select("conv", "turn", "previews", "repeats", F.array_join("amounts", " ").alias("amounts"), "said_amounts", "kind", "ran")


@query(
    f"WITH {_EXCHANGES} SELECT count(*) AS exchanges, count(*) FILTER (kind = 'consent') AS consent, count(*) FILTER (kind = 'refusal') AS refusal, count(*) FILTER (kind = 'question') AS question, count(*) FILTER (kind = 'other') AS other, count(*) FILTER (kind = 'none') AS none, "
    "coalesce(sum(repeats), 0)::BIGINT AS repeats, count(*) FILTER (kind = 'consent' AND ran = 0) AS consent_unrun, count(*) FILTER (said_amounts) AS amounts_said, count(said_amounts) AS with_amounts FROM f"
)
def exchange_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the exchanges."""
    return confirm.statistics(_exchanges(spark, sf_dir))
