"""Conversation operators over the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import claims, consent
from tidemill.operators import conversation as op
from tidemill.registry import query, table

_PLAIN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


_DELIVERED = "SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant' AND trim(text) <> '') WHERE NOT (n = 1 AND length(text) < 40)"


@query(f"SELECT conv_id, turn, length(text) AS chars FROM ({_DELIVERED})")
def delivered_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that were seen, a short leading one left out as greeting."""
    return op.delivered(messages(spark, sf_dir), F.length("text") < 40).select("conv_id", "turn", F.length("text").cast("long").alias("chars"))


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def visible_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages a customer may see."""
    return messages(spark, sf_dir).filter(F.col("role").isin("user", "assistant") & (F.trim("text") != "")).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("SELECT conv_id, arg_min(md5(text), turn) AS first, arg_max(md5(text), turn) AS last, max(turn) AS at FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def first_and_last_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the first and of the last reply."""
    m = messages(spark, sf_dir).filter("role = 'assistant'").withColumn("digest", F.md5("text"))
    return m.groupBy("conv_id").agg(F.min_by("digest", "turn").alias("first"), F.max_by("digest", "turn").alias("last"), F.max("turn").alias("at"))


@query(
    f"SELECT conv_id, count(*) = 3 AND count(DISTINCT p) = 1 AS loops FROM (SELECT conv_id, {_PLAIN} AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n "
    "FROM conversations WHERE role = 'assistant') WHERE n <= 3 GROUP BY conv_id"
)
def reply_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that end in a loop."""
    return op.loops(messages(spark, sf_dir).filter("role = 'assistant'"))


#: A sentence behind some replies, so that the tables have what is looked for.
_TAIL = "CASE (conv_id + turn) % 4 WHEN 0 THEN ' 확인해 보겠습니다.' WHEN 1 THEN ' 잠시만요, 번호를 알려 주세요.' WHEN 2 THEN ' 곧 처리해 드리겠습니다?' ELSE '' END"


@query(
    f"SELECT conv_id, turn, coalesce(p = lag(p) OVER (PARTITION BY conv_id ORDER BY turn), false) AS repeats, "
    f"regexp_matches(text || {_TAIL}, '{op.PROMISE}') AND NOT regexp_matches(text || {_TAIL}, '{op.ASKS}') AS stalls, "
    f"len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}]')) >= 2 AS other_script FROM (SELECT *, {_PLAIN} AS p FROM conversations WHERE role = 'assistant')"
)
def reply_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each reply repeats the one before, stalls, or slips into another script."""
    m = messages(spark, sf_dir).filter("role = 'assistant'").withColumn("p", op.collapsed(F.col("text")))
    repeats = F.coalesce(F.col("p") == F.lag("p").over(op.in_order()), F.lit(False))
    other = F.regexp_count("text", F.lit(op.SCRIPT)) >= 2
    return m.select("conv_id", "turn", repeats.alias("repeats"), op.is_stall(F.concat("text", F.expr(_TAIL))).alias("stalls"), other.alias("other_script"))


_TURNS = "t AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM conversations)"


@query(
    f"WITH {_TURNS}, e AS (SELECT conv_id, exchange, max(md5(text)) FILTER (role = 'user') AS said, arg_max(md5(text), turn) FILTER (role = 'assistant') AS reply FROM t WHERE exchange > 0 GROUP BY 1, 2) "
    "SELECT *, lead(said) OVER (PARTITION BY conv_id ORDER BY exchange) AS answer FROM e"
)
def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each customer message, the last reply to it, and the next customer message."""
    return op.exchanges(messages(spark, sf_dir).withColumn("text", F.md5("text")))


@query(f"WITH {_TURNS} SELECT conv_id, exchange > 2 OR (exchange = 2 AND role <> 'user') AS after, count(*) AS n FROM t GROUP BY 1, 2")
def injection_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before and after the second customer message."""
    after = (F.col("exchange") > 2) | ((F.col("exchange") == 2) & (F.col("role") != "user"))
    return op.turns(messages(spark, sf_dir)).groupBy("conv_id", after.alias("after")).agg(F.count("*").alias("n"))


@query(
    "WITH p AS (SELECT DISTINCT conv_id AS a, conv_id + 1 AS b FROM conversations), "
    "x AS (SELECT a, b, turn, role, text FROM p JOIN conversations ON conv_id = a), y AS (SELECT a, b, turn, role, text FROM p JOIN conversations ON conv_id = b), "
    "d AS (SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(x.turn, y.turn) AS turn, coalesce(x.role, y.role) AS side FROM x FULL JOIN y ON x.a = y.a AND x.turn = y.turn "
    "WHERE x.role IS DISTINCT FROM y.role OR x.text IS DISTINCT FROM y.text) SELECT a, b, min(turn) AS turn, arg_min(side, turn) AS side FROM d GROUP BY a, b"
)
def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where neighbouring conversations part, and whose message it is."""
    m = messages(spark, sf_dir)
    pairs = m.select(F.col("conv_id").alias("a"), (F.col("conv_id") + 1).alias("b")).distinct()
    return op.first_divergence(pairs, m, m)


@query("SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seen FROM conversations")
def visible_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much text each message could draw on: all strictly before it."""
    return op.visible_before(messages(spark, sf_dir), F.length("text"), "seen").select("conv_id", "turn", F.col("seen").cast("long").alias("seen"))


@query(
    "WITH k AS (SELECT conv_id, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY 1) SELECT min(conv_id) AS conv_id, count(*) AS copies FROM k GROUP BY h"
)
def distinct_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of equal conversations, with how many there are. Message digests are gathered, not texts."""
    lines = F.concat("role", F.lit(":"), "text")
    k = messages(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.sha2(lines, 256).alias("h")))), lambda x: x["h"]), ",").alias("h"))
    return k.groupBy("h").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")).drop("h")


@query(
    "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS verified FROM conversations"
)
def verified_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State that holds at each message: what the latest customer message set, kept until the next."""
    state = F.last(F.when(F.col("role") == "user", F.length("text")), ignorenulls=True).over(op.in_order())
    return messages(spark, sf_dir).select("conv_id", "turn", state.cast("long").alias("verified"))


@query(
    "WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS users, arg_max(role, turn) AS last, count(*) AS n FROM conversations GROUP BY 1) "
    "SELECT conv_id, CASE WHEN users > 20 THEN 'max_user_turns' WHEN last = 'assistant' THEN 'answered' WHEN n = 1 THEN 'no_reply' ELSE 'open' END AS ending FROM c"
)
def endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each finished conversation ended, the first rule that holds."""
    c = messages(spark, sf_dir).groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.max_by("role", "turn").alias("last"), F.count("*").alias("n"))
    ending = F.when(F.col("users") > 20, "max_user_turns").when(F.col("last") == "assistant", "answered").when(F.col("n") == 1, "no_reply").otherwise("open")
    return c.select("conv_id", ending.alias("ending"))


_LIMITS = op.Limits(turns=6, calls=8, errors=3, format=1, claim=1, stall=1, repeat=1)
#: What is wrong with a reply, and which messages of the system are failed tools: made up from the message's place.
_WRONG = "CASE (conv_id * 3 + turn) % 11 WHEN 0 THEN 'format' WHEN 1 THEN 'claim' WHEN 2 THEN 'stall' END"
_AS_SAID = "CASE WHEN conv_id % 3 = 0 THEN 'the same  again' ELSE text END"
_HELD_STALL = "e.kind = 'stall' AND r.is < 1"
_HELD_REPEAT = f"e.kind IN ('reply', 'stall') AND NOT ({_HELD_STALL}) AND e.said = r.last AND r.ir < 1"
_AGENT = "e.kind IN ('format', 'claim', 'stall', 'reply')"
_REPLY = f"{_AGENT} AND e.kind NOT IN ('format', 'claim') AND NOT ({_HELD_STALL}) AND NOT coalesce({_HELD_REPEAT}, false)"


def _more(count: str, hit: str) -> str:
    return f"r.{count} + (coalesce({hit}, false) AND NOT ({_AGENT} AND r.calls >= 8))::BIGINT"


def _turn(count: str, hit: str) -> str:
    return f"CASE WHEN e.kind = 'user' THEN 0 ELSE r.{count} + coalesce({hit}, false)::BIGINT END"


@query(
    f"WITH RECURSIVE m AS (SELECT conv_id, turn, role, {_WRONG} AS wrong, trim(regexp_replace({_AS_SAID}, '\\s+', ' ', 'g')) AS said FROM conversations), "
    "e AS (SELECT conv_id, role, said, CASE WHEN role = 'assistant' THEN coalesce(wrong, 'reply') WHEN role = 'user' THEN 'user' WHEN turn % 2 = 0 THEN 'error' ELSE 'other' END AS kind, "
    "row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM m), "
    "r AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, 0::BIGINT AS turns, 0::BIGINT AS calls, 0::BIGINT AS replies, 0::BIGINT AS formats, 0::BIGINT AS claims, 0::BIGINT AS stalls, 0::BIGINT AS repeats, 0::BIGINT AS errors, "
    "0::BIGINT AS fi, 0::BIGINT AS ic, 0::BIGINT AS is, 0::BIGINT AS ir, NULL::VARCHAR AS last, '' AS role, '' AS ended FROM e UNION ALL SELECT r.conv_id, e.n, "
    f"{_more('turns', "e.kind = 'user' AND r.turns < 6")}, {_more('calls', _AGENT)}, {_more('replies', _REPLY)}, {_more('formats', "e.kind = 'format'")}, {_more('claims', "e.kind = 'claim'")}, {_more('stalls', _HELD_STALL)}, "
    f"{_more('repeats', _HELD_REPEAT)}, {_more('errors', "e.kind = 'error'")}, {_turn('fi', "e.kind = 'format'")}, {_turn('ic', "e.kind = 'claim'")}, {_turn('is', _HELD_STALL)}, {_turn('ir', _HELD_REPEAT)}, "
    f"CASE WHEN {_REPLY} THEN e.said ELSE r.last END, CASE WHEN {_REPLY} THEN 'reply' ELSE e.role END, "
    f"CASE WHEN e.kind = 'user' AND r.turns >= 6 THEN 'max_user_turns' WHEN {_AGENT} AND r.calls >= 8 THEN 'max_agent_calls' WHEN e.kind = 'format' AND r.fi >= 1 THEN 'agent_format_error' "
    "WHEN e.kind = 'claim' AND r.ic >= 1 THEN 'unbacked_claim' WHEN e.kind = 'error' AND r.errors >= 2 THEN 'tool_errors' ELSE '' END FROM r JOIN e ON e.conv_id = r.conv_id AND e.n = r.n + 1 WHERE r.ended = '') "
    "SELECT conv_id, turns AS customer_turns, calls, replies, formats, claims, stalls, repeats, errors AS tool_errors, CASE WHEN ended <> '' THEN ended WHEN role = 'reply' THEN 'answered' ELSE 'open' END AS ended "
    "FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1"
)
def conversation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine over each conversation, with replies held and asked for again by kind, under tight limits."""
    m = messages(spark, sf_dir).withColumns({"wrong": F.expr(_WRONG), "text": F.expr(_AS_SAID)})
    return op.fold(op.events(m, problem=F.col("wrong"), failed=F.col("turn") % 2 == 0), _LIMITS)


@query("WITH e AS (SELECT conv_id, list(struct_pack(t := turn, r := role, n := length(text)) ORDER BY turn) AS log FROM conversations GROUP BY 1) SELECT conv_id, x.t AS turn, x.r AS role, x.n AS chars FROM (SELECT conv_id, unnest(log) AS x FROM e)")
def flattened_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested logs, one array a conversation, flattened to rows again."""
    m = messages(spark, sf_dir).select("conv_id", F.struct("turn", "role", F.length("text").cast("long").alias("chars")).alias("x"))
    return m.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("log")).select("conv_id", F.inline("log"))


@query(
    "SELECT conv_id, turn, CASE lead(role) OVER w WHEN 'user' THEN 'asked' WHEN 'assistant' THEN 'spoke_again' WHEN 'system' THEN 'handed_over' ELSE 'ended' END AS next "
    "FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY role = 'assistant'"
)
def after_a_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes after each reply."""
    nxt = F.lead("role").over(op.in_order())
    kind = F.when(nxt == "user", "asked").when(nxt == "assistant", "spoke_again").when(nxt == "system", "handed_over").otherwise("ended")
    return messages(spark, sf_dir).withColumn("next", kind).filter("role = 'assistant'").select("conv_id", "turn", "next")


@query()
def consent_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consent, refusal, question or other, of each customer message; and of fixed sentences in Korean."""
    m = messages(spark, sf_dir).filter("role = 'user'").select("conv_id", "turn", F.col("text"))
    fixed = [(-1, k, s) for k, s in enumerate(("네, 진행해 주세요", "아니요 괜찮습니다", "네이비로 바꿔 주세요", "언제 도착하나요?", "그렇게 해 주세요"))]
    return m.union(spark.createDataFrame(fixed, m.schema)).select("conv_id", "turn", consent.kind(F.col("text")).alias("kind"))


@query()
def unbacked_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentence of each reply that claims something done which no earlier message of the conversation shows."""
    m = messages(spark, sf_dir)
    fixed = [(-1, 0, "user", "취소해 주세요"), (-1, 1, "assistant", "주문 취소가 완료되었습니다. 감사합니다."), (-1, 2, "user", "네"), (-1, 3, "assistant", "취소해 드리겠습니다."), (-1, 4, "system", 'cancel_order\n{"status": "cancelled"}'), (-1, 5, "assistant", "취소가 완료되었습니다.")]
    m = m.union(spark.createDataFrame(fixed, m.schema))
    results = m.filter("role = 'system'")
    return claims.unbacked(m.filter("role = 'assistant'"), results)
