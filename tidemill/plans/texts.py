"""Text operators over documents, benchmark items, names and constructed sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import speech, text as fn
from tidemill.plans.shop import _LETTERS, korean_names
from tidemill.operators import ranks
from tidemill.registry import query, table

#: Characters of a quote, and how many different ones of the items' side every task may hold (8 bytes each).
QUOTE, QUOTES_MOST = 20, 1_000_000


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, said): a Korean sentence for each order, with its number, amount, date, a phone and an e-mail. Orders are dealt
    out over all cores: a row costs far more to rewrite than to send, and a file's row groups are few."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    o = o.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    phone = F.concat(F.lit("010-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    said = F.concat_ws(
        " ",
        F.concat(F.lit("주문 O-"), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"), F.lit(" 금액은")),
        F.concat(F.format_number(F.round("o_totalprice").cast("long"), 0), F.lit("원이고")),
        F.concat(F.month("o_orderdate").cast("string"), F.lit("월 "), F.dayofmonth("o_orderdate").cast("string"), F.lit("일에 샀어요.")),
        F.concat(F.lit("번호는 "), phone, F.lit(", 메일은 user")),
    )
    return o.select("o_orderkey", F.concat(said, F.col("o_custkey").cast("string"), F.lit("@example.com 입니다")).alias("said"))


_LOW = "lower(coalesce(text, ''))"
_MAIL = r"[0-9a-z._%+\-]+@[0-9a-z\-]+(?:\.[0-9a-z\-]+)*\.[a-z]{2,}"
_DAY = r"(^|[^\d])\d{4}\s*[-./]\s*\d{1,2}\s*[-./]\s*\d{1,2}($|[^\d])"


@query(
    rf"WITH m AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_MAIL}') AS emails, regexp_replace({_LOW}, '{_MAIL}', ' ', 'g') AS bare FROM documents), "
    rf"d AS (SELECT doc_id, emails, regexp_replace(regexp_replace(bare, '{_DAY}', '\1 \2', 'g'), '{_DAY}', '\1 \2', 'g') AS bare FROM m), "
    # a comma before three digits and no fourth becomes another mark, twice, as neighbours share a character
    r"c AS (SELECT doc_id, emails, regexp_replace(regexp_replace(bare, ',(\d{3})([^\d]|$)', '§\1\2', 'g'), ',(\d{3})([^\d]|$)', '§\1\2', 'g') AS bare FROM d), "
    r"n AS (SELECT doc_id, emails, [translate(x, '§-', '') FOR x IN regexp_extract_all(bare, '\d+(?:-\d+|§\d{3})*')] AS numbers FROM c), "
    "v AS (SELECT doc_id, list_concat(['email:' || x FOR x IN emails], ['num:' || x FOR x IN numbers IF length(x) >= 4]) AS v FROM n) "
    "SELECT doc_id, array_to_string(list_sort(list_distinct(v)), ' ') AS tokens FROM v WHERE len(v) > 0"
)
def value_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails and numbers of each document that has any (dates are compared in another query); worked out once a row."""
    of = F.filter(fn.tokens(F.col("text")), lambda x: ~x.startswith("date:"))
    one = fn.let(of, lambda v: F.when(F.size(v) > 0, F.array(F.array_join(v, " "))).otherwise(F.array().cast("array<string>")))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(one).alias("tokens"))


@query(
    "SELECT o_orderkey, 'date:' || strftime(o_orderdate, '%m-%d') AS token, array_to_string(list_sort(list_distinct(['date:' || strftime(o_orderdate::DATE + d, '%m-%d') for d in [7, 8, 30, -29]])), ' ') AS derived FROM orders"
)
def date_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of a text and the days that rules derive from them."""
    o = table(spark, sf_dir, "orders")
    found = fn.tokens(F.concat(F.lit("ordered "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" ok")))
    derived = fn.shifted_dates(F.array(F.date_format("o_orderdate", "MM-dd")), F.year("o_orderdate"))
    return o.select("o_orderkey", F.array_join(found, " ").alias("token"), F.array_join(derived, " ").alias("derived"))


@query(
    "SELECT o_orderkey, contains(any_in, n) OR contains(src, n) AS grounded FROM (SELECT o_orderkey, (o_orderkey % 10000)::VARCHAR AS n, (o_custkey * 1000 + o_orderkey % 1000)::VARCHAR AS src, o_custkey::VARCHAR AS any_in FROM orders)"
)
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stated number is a source or part of a longer source number; a fold over the row's small array."""
    num = lambda c: F.concat(F.lit("num:"), c.cast("string"))
    sources = F.array(num(F.col("o_custkey") * 1000 + F.col("o_orderkey") % 1000), num(F.col("o_custkey")))
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", fn.grounded(num(F.col("o_orderkey") % 10000), sources).alias("grounded"))


_DIGITS = "(o_orderkey * 1111 % 100000)::VARCHAR"


@query(
    f"SELECT o_orderkey, d = repeat(substr(d, 1, 1), length(d)) OR contains('0123456789', d) OR contains('1234567890', d) OR contains('9876543210', d) OR regexp_matches(d, '^0{{2,}}\\d{{1,2}}$') AS placeholder FROM (SELECT o_orderkey, {_DIGITS} AS d FROM orders)"
)
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that stand for a format."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 1111 % 100000).cast("string").alias("d"))
    return o.select("o_orderkey", fn.is_placeholder(F.col("d")).alias("placeholder"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[\\s.,?!~''\"“”‘’()\\[\\]·:;-]', '', 'g') AS squeezed, levenshtein(p_name, p_type) AS distance FROM part")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names squeezed for comparison, and edits between two texts."""
    return table(spark, sf_dir, "part").select("p_partkey", fn.squeeze(F.col("p_name")).alias("squeezed"), F.levenshtein("p_name", "p_type").alias("distance"))


@query("SELECT p_brand, sum(levenshtein(p_name, p_type))::BIGINT AS edits, sum(length(p_name))::BIGINT AS chars, count(*) FILTER (p_name = p_type) AS exact, median(p_retailprice) FILTER (p_size > 5) AS middle FROM part GROUP BY p_brand")
def channel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of a channel by speaker: edits over characters, exact share, median over the uncached only."""
    p = table(spark, sf_dir, "part")
    middle = ranks.medians(p, F.when(F.col("p_size") > 5, F.col("p_retailprice")), {"brand": F.col("p_brand")}).select("brand", F.col("median").alias("middle"))
    counts = p.groupBy("p_brand").agg(
        F.sum(F.levenshtein("p_name", "p_type")).alias("edits"),
        F.sum(F.length("p_name")).alias("chars"),
        F.count_if(F.col("p_name") == F.col("p_type")).alias("exact"),
    )
    return counts.join(middle, F.col("p_brand").eqNullSafe(F.col("brand")), "left").drop("brand")


@query(f"SELECT s_suppkey, levenshtein({_LETTERS}, (SELECT {_LETTERS} FROM supplier WHERE s_suppkey = 1)) AS distance FROM supplier")
def jamo_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by letter between each name and the first."""
    names = korean_names(spark, sf_dir)
    first = names.filter("s_suppkey = 1").select(F.col("name").alias("first"))
    return names.crossJoin(F.broadcast(first)).select("s_suppkey", fn.name_distance(F.col("name"), F.col("first")).alias("distance"))


@query()
def section_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 20 characters of squashed text that documents of any length share with benchmark items, the first item
    of each counting."""
    return fn.quotes(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", QUOTE, QUOTES_MOST)


@query(
    "WITH w AS (SELECT DISTINCT o_orderkey, c_custkey AS owner, o_custkey AS asked FROM orders JOIN customer ON c_custkey = o_custkey + (o_orderkey % 3) - 1) SELECT asked, owner, count(*) AS leaks FROM w WHERE owner <> asked GROUP BY 1, 2"
)
def other_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in a reply that belong to another customer than the one who asks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("asked"), (F.col("o_custkey") + F.col("o_orderkey") % 3 - 1).alias("owner"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"))
    return o.join(c, "owner", "left_semi").filter("owner <> asked").groupBy("asked", "owner").agg(F.count("*").alias("leaks"))


@query(
    "SELECT event_id, trim(regexp_replace(t, '(?i)#{2,}\\s*(?:STOP|OUT[-_ ]?OF[-_ ]?SCOPE)\\s*#*', '', 'g')) AS said, CASE WHEN regexp_matches(t, '(?i)#{2,}\\s*OUT[-_ ]?OF[-_ ]?SCOPE') THEN 'out_of_scope' "
    "WHEN regexp_matches(t, '(?i)#{2,}\\s*STOP') THEN 'customer_stop' END AS ending FROM (SELECT event_id, event_type || CASE event_id % 3 WHEN 0 THEN ' ###STOP###' WHEN 1 THEN ' ### out-of-scope ###' ELSE '' END AS t FROM events)"
)
def ending_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a message says without its mark of an end, and which end it marks."""
    mark = F.when(F.col("event_id") % 3 == 0, " ###STOP###").when(F.col("event_id") % 3 == 1, " ### out-of-scope ###").otherwise("")
    e = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", mark).alias("t"))
    return e.select("event_id", fn.without_ending(F.col("t")).alias("said"), fn.ending(F.col("t")).alias("ending"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, coalesce((props->>'k')::BIGINT, 0) > 50 AS large FROM events")
def preview_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values out of JSON text."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (F.coalesce(k, F.lit(0)) > 50).alias("large"))


@query("SELECT l_orderkey, '{\"lines\":[' || string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) || '],\"order\":' || l_orderkey || '}' AS args FROM lineitem GROUP BY l_orderkey")
def canonical_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments as comparable JSON: unordered lists sorted, fields in order of name, nulls left out."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines"))
    return l.select("l_orderkey", F.to_json(F.struct("lines", F.lit(None).cast("string").alias("note"), F.col("l_orderkey").alias("order"))).alias("args"))


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list(round(l_extendedprice)::BIGINT * l_quantity::BIGINT), list(round(l_extendedprice)::BIGINT)))), ' ') AS amounts FROM lineitem GROUP BY l_orderkey")
def result_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts at any depth of a JSON result."""
    won = F.round("l_extendedprice").cast("long").alias("unit_price_won")
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(won, F.col("l_quantity").cast("long").alias("quantity"))).alias("items"))
    doc = F.to_json(F.struct(F.struct("items").alias("order")))
    return l.select("l_orderkey", F.array_join(F.transform(fn.json_amounts(doc), lambda x: x.cast("string")), " ").alias("amounts"))


_TERMS = (
    "s AS (SELECT unnest([-1, 0, 1]) AS v), c AS (SELECT a.v AS a, b.v AS b, d.v AS d, e.v AS e, abs(a.v) + abs(b.v) + abs(d.v) + abs(e.v) AS terms FROM s a, s b, s d, s e), "
    "t AS (SELECT * FROM c WHERE (a <> 0 OR b <> 0) AND (terms BETWEEN 2 AND 3 OR terms = 1 AND a + b = 1)), "
    "o AS (SELECT o_orderkey, o_custkey % 3000 + 1 AS x, o_orderkey % 2000 + 3001 AS y, round(o_totalprice)::BIGINT % 7000 AS value FROM orders)"
)


@query(
    f"WITH {_TERMS} SELECT o_orderkey, bool_or(a * x + b * y + d * 3000 + e * 5000 = value) AS explained FROM o, t "
    "WHERE NOT (x = 3000 AND d <> 0) AND NOT (y = 5000 AND e <> 0) GROUP BY o_orderkey"
)
def combined_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts explained as sum or difference of a result's amounts and fixed ones."""
    o = table(spark, sf_dir, "orders")
    own = F.array(F.col("o_custkey").cast("long") % 3000 + 1, F.col("o_orderkey").cast("long") % 2000 + 3001)
    return o.select("o_orderkey", fn.by_combination(F.round("o_totalprice").cast("long") % 7000, own).alias("explained"))


@query(
    "WITH k AS (SELECT unnest([['email', '3'], ['phone', ''], ['id', '0'], ['amount', ''], ['date', '2']]) AS k) "
    "SELECT k[1] AS kind, count(*) AS n, count(*) FILTER ((o_orderkey % 4)::VARCHAR <> k[2]) AS kept FROM orders, k GROUP BY k[1]"
)
def entity_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values of each sentence and whether a damaged copy still has them, counted by kind. Copies lose their hyphens,
    the commas of their amounts, the mark of their month, or the sign of their e-mail address."""
    lost = (F.replace("said", F.lit("-"), F.lit("")), F.translate("said", ",", " "), F.replace("said", F.lit("월"), F.lit("")), F.replace("said", F.lit("@"), F.lit(" ")))
    heard = F.get(F.array(*lost), (F.col("o_orderkey") % 4).cast("int"))
    each = _sentences(spark, sf_dir).select("said", heard.alias("heard"), F.explode(fn.entities(F.col("said"))).alias("e"))
    kept = fn.survived(F.col("e.kind"), F.col("e.value"), F.col("heard"))
    return each.groupBy("e.kind").agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"))


_ONES = "'', '일', '이', '삼', '사', '오', '육', '칠', '팔', '구'"
_PLACED = "[" + ", ".join(f"[{', '.join(repr('' if d == 0 else ('' if d == 1 else '일이삼사오육칠팔구'[d - 1]) + place) for d in range(10))}]" for place in ("천", "백", "십")) + f", [{_ONES}]]"
_GROUP = f"g AS (SELECT n, p[1][n // 1000 + 1] || p[2][n // 100 % 10 + 1] || p[3][n // 10 % 10 + 1] || p[4][n % 10 + 1] AS said FROM (SELECT unnest(range(10000)) AS n, {_PLACED} AS p))"
_DIGITS_SAID = "translate({}, '0123456789', '공일이삼사오육칠팔구')"


@query(
    f"WITH {_GROUP}, o AS (SELECT *, round(o_totalprice)::BIGINT AS won, month(o_orderdate) AS m FROM orders) "
    f"SELECT o_orderkey, '주문 오 다시 ' || {_DIGITS_SAID.format("lpad((o_orderkey % 100000)::VARCHAR, 5, '0')")} || ' 금액은 ' || "
    "CASE WHEN won >= 10000 THEN CASE WHEN won // 10000 = 1 THEN '' ELSE hi.said END || '만' || CASE WHEN won % 10000 > 0 THEN ' ' ELSE '' END ELSE '' END || lo.said || ' 원이고 ' || "
    "CASE m WHEN 6 THEN '유' WHEN 10 THEN '시' ELSE mo.said END || '월 ' || da.said || '일에 샀어요. 번호는 공일공, ' || "
    f"{_DIGITS_SAID.format("lpad((o_custkey % 10000)::VARCHAR, 4, '0')")} || ', ' || {_DIGITS_SAID.format("lpad((o_orderkey % 10000)::VARCHAR, 4, '0')")} || "
    f"', 메일은 유 에스 이 알 ' || {_DIGITS_SAID.format('o_custkey::VARCHAR')} || ' 골뱅이 이그잼플 닷컴 입니다' AS spoken "
    "FROM o JOIN g hi ON hi.n = won // 10000 JOIN g lo ON lo.n = won % 10000 JOIN g mo ON mo.n = m JOIN g da ON da.n = day(o_orderdate)"
)
def verbalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as they are said."""
    return _sentences(spark, sf_dir).select("o_orderkey", speech.verbalize(F.col("said")).alias("spoken"))


@query(
    "SELECT o_orderkey, 'O-' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS number, "
    "'010-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || '-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS phone FROM orders"
)
def spoken_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers and phones as they come back once they were said and written again."""
    again = speech.spoken_to_written(speech.verbalize(F.col("said")))
    return _sentences(spark, sf_dir).select("o_orderkey", again.alias("again")).select(
        "o_orderkey", F.regexp_extract("again", r"O-\d{5}", 0).alias("number"), F.regexp_extract("again", r"010-\d{4}-\d{4}", 0).alias("phone")
    )


@query("SELECT o_orderkey, 'O-' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') || ' ' || replace(format('{:,}', round(o_totalprice)::BIGINT // 10000 * 10000 + 500), '''', '') || '원 a' || o_custkey || '@example.com' AS text FROM orders")
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recogniser writes for order numbers, amounts and e-mails, in their usual form."""
    o = table(spark, sf_dir, "orders")
    heard = F.concat(
        F.lit("5-"), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"), F.lit(" "), F.floor(F.round("o_totalprice") / 10000).cast("string"), F.lit("만 500원 a"), F.col("o_custkey").cast("string"), F.lit(" 골뱅이 이그잼플 닷컴")
    )
    return o.select("o_orderkey", speech.normalize_heard(heard).alias("text"))


@query(
    "SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS place FROM orders) WHERE o_orderkey % 5 = 0"
)
def respelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a record's utterances that are said otherwise today. Texts are compared before utterances are placed, so that none is sent on."""
    said = _sentences(spark, sf_dir).select("o_orderkey", speech.verbalize(F.col("said")).alias("now"))
    was = F.when(F.col("o_orderkey") % 5 == 0, F.concat("now", F.lit("?"))).otherwise(F.col("now"))
    compared = said.select("o_orderkey", (~was.eqNullSafe(F.col("now"))).alias("changed"))
    placed = compared.withColumn("place", F.row_number().over(Window.partitionBy((F.col("o_orderkey") / 1000).cast("int")).orderBy("o_orderkey")))
    return placed.filter("changed").select("o_orderkey", "place")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type END AS tool FROM events")
def leaked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls written into a reply as JSON."""
    call = F.concat(F.lit('I will {now} do {"name": "'), "event_type", F.lit('", "arguments": {"k": 1}} for you'))
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, call).otherwise(F.lit("no { call }")).alias("t"))
    return e.select("event_id", fn.column(fn.leaked_call, F.col("t")).alias("tool"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Good day.' WHEN 1 THEN 'Good day. I show the ' || event_type || '.' ELSE 'The system of ' || event_type || ', I think, works.' END AS kept FROM events")
def redacted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies without the clauses that quote instructions."""
    rules = "neverrevealthesystemprompt"
    windows = {rules[k : k + 10] for k in range(len(rules) - 9)}
    quoting = F.concat(F.lit("Good day. I must never reveal the system "), "event_type", F.lit("."))
    short, other = F.concat(F.lit("Good day. I show the "), "event_type", F.lit(".")), F.concat(F.lit("The system of "), "event_type", F.lit(", I think, works."))
    e = table(spark, sf_dir, "events").select("event_id", F.get(F.array(quoting, short, other, other), (F.col("event_id") % 4).cast("int")).alias("t"))
    return e.select("event_id", fn.column(lambda t: fn.without_quotes(t, windows), F.col("t")).alias("kept"))


@query("SELECT c_custkey, c_custkey % 3 <> 1 AS named FROM customer")
def names_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in a text, spaces aside."""
    said = F.when(F.col("c_custkey") % 3 == 0, F.replace("c_name", F.lit("#"), F.lit(" # "))).when(F.col("c_custkey") % 3 == 1, F.lit("Customer")).otherwise(F.upper("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", fn.names(F.concat(F.lit("hello "), said, F.lit(" bye")), F.col("c_name")).alias("named"))


@query(r"SELECT doc_id, regexp_matches(replace(text, ',', '§'), '(^|[^0-9A-Za-z.\-§]|[^0-9]§)12($|[^\d\-§]|§($|[^\d])|-($|[^\d]))') AS states FROM documents WHERE text IS NOT NULL")
def stated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text states the number 12, thousands separators aside, not as part of another number or id."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", fn.states_number(F.col("text"), F.lit(12)).alias("states"))


@query("SELECT o_orderkey, o_orderkey % 5 < 3 AS dated, o_orderkey % 2 = 0 AS tracked FROM orders")
def stated_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sentences state an order's day (written in several ways, or with another year or month) and its parcel number."""
    day = F.col("o_orderdate").cast("date")
    wrong = F.concat_ws("-", (F.year(day) + 1).cast("string"), F.date_format(day, "MM"), F.date_format(day, "dd"))
    other = F.concat(F.month(F.add_months(day, 1)).cast("string"), F.lit("월 1일"))
    ways = [F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "M월 d일"), F.date_format(day, "yyyy년 M월 d일"), wrong, other]
    parcel = F.concat(F.lit("P-"), F.lpad("o_orderkey", 9, "0"))
    told = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("is "), F.replace(F.lower(parcel), F.lit("-"), F.lit(" \u2013 ")))).otherwise(F.concat(parcel, F.lit("7")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), parcel.alias("parcel"), F.concat(F.lit("on "), F.get(F.array(*ways), (F.col("o_orderkey") % 5).cast("int")), F.lit("에 ")).alias("said"), told.alias("told"))
    return o.select("o_orderkey", fn.states_date(F.col("said"), F.col("day")).alias("dated"), fn.states_text(F.col("told"), F.col("parcel")).alias("tracked"))
