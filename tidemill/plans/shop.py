"""Lookups and nested documents over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators import shop as op
from tidemill.registry import query, table


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_custkey = 7 THEN 'own' ELSE 'not_owner' END AS access FROM orders WHERE o_orderkey IN (1, 7, 32, 100)")
def own_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by key with the check of who owns them; the keys reach the scan as a filter."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderkey").isin(1, 7, 32, 100))
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_custkey") == 7, "own").otherwise("not_owner").alias("access"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' ORDER BY o_orderkey")
def matching_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality filters and an order by key."""
    o = table(spark, sf_dir, "orders")
    return o.filter((o["o_orderpriority"] == "1-URGENT") & (o["o_orderstatus"] == "P")).select("o_orderkey", "o_orderdate").orderBy("o_orderkey")


@query("SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer WHERE replace(lower(c_name), ' ', '') LIKE 'customer#%1' GROUP BY c_nationkey")
def find_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First customer by key, for each nation, whose normalised name matches."""
    name = F.replace(F.lower("c_name"), F.lit(" "), F.lit(""))
    return table(spark, sf_dir, "customer").filter(name.like("customer#%1")).groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))


@query(
    "SELECT c_nationkey, c_mktsegment, CASE WHEN count(*) > 1 THEN 'caller_shared' WHEN min(c_name) LIKE '%1' THEN 'verified' ELSE 'name_differs' END AS outcome "
    "FROM customer GROUP BY 1, 2"
)
def verify_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a caller check by number: shared by several, name as said, or another name."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.min("c_name").alias("name"))
    return c.select("c_nationkey", "c_mktsegment", F.when(F.col("n") > 1, "caller_shared").when(F.col("name").like("%1"), "verified").otherwise("name_differs").alias("outcome"))


@query(
    "WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || p_name, ';' ORDER BY l_linenumber, p_name) AS items, count(*) AS n, sum(round(l_extendedprice)::BIGINT)::BIGINT AS goods "
    "FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT o_orderkey, c_name, o_orderstatus, items, coalesce(n, 0) AS n_items, goods "
    "FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey"
)
def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its customer and its lines nested in order; lines are gathered by order before they are joined."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    items = items.select("l_orderkey", "l_linenumber", "p_name", F.round("l_extendedprice").cast("long").alias("won"))
    nested = op.nest(items, "l_orderkey", ["l_linenumber", "p_name", "won"], "lines")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
    doc = o.join(nested, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    text = F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["p_name"]))
    goods = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["won"])
    return doc.select("o_orderkey", "c_name", "o_orderstatus", F.when(F.col("lines").isNotNull(), F.array_join(text, ";")).alias("items"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_items"), goods.alias("goods"))


@query(
    "WITH l AS (SELECT l_orderkey, min({'n': l_linenumber, 'p': l_partkey}).p AS first, count(*) AS n FROM lineitem GROUP BY 1) "
    "SELECT o_custkey, o_orderkey, p_name || CASE WHEN n > 1 THEN ' 외 ' || (n - 1) || '건' ELSE '' END AS summary, "
    "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders JOIN l ON l_orderkey = o_orderkey JOIN part ON p_partkey = first"
)
def order_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders, newest first, with the first line's name and how many more there are."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("first"), F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(first, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("first"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return o.select("o_custkey", "o_orderkey", op.and_more(F.col("p_name"), F.col("n")).alias("summary"), place.alias("place"))


@query(
    "WITH o AS (SELECT o_custkey, count(*) AS orders, max(o_orderdate) AS last FROM orders GROUP BY 1) "
    "SELECT c_custkey, c_name, n_name, coalesce(orders, 0) AS orders, last FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o_custkey = c_custkey"
)
def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with nation and a summary of orders, none left out."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("last"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), "last")


@query("SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS variants, count(*) AS n FROM part GROUP BY p_brand")
def product_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product with its variants in order."""
    v = op.nest(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", ["p_partkey"], "v")
    return v.select("p_brand", F.array_join(F.transform("v", lambda x: x["p_partkey"].cast("string")), ",").alias("variants"), F.size("v").cast("long").alias("n"))


@query("SELECT o_orderkey, l_linenumber, l_shipdate, l_linestatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def tracked_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of the orders on their way."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus")
    return o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")


@query(
    "SELECT a.p_partkey AS part, count(*) AS choices, min(b.p_partkey) AS first FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey "
    "WHERE b.p_size >= 10 GROUP BY 1"
)
def exchange_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other variants of the same product in stock: counted by product, not paired, so that a product with many
    variants isn't squared. The first is the product's least, or its second least for the least itself."""
    return op.alternatives(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey", F.col("p_size") >= 10).withColumnRenamed("p_partkey", "part")


#: Syllables of a supplier's made-up Korean name: an initial, a vowel and a final each differ from name to name.
_SYLLABLES = ("s_suppkey * 588 % (19 * 588)", "6 * 588 + s_suppkey * 28 % 588", "9 * 588 + s_suppkey * 5 % 28")


def korean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, s_nationkey, name) of suppliers; in some there is a space."""
    one, two, three = (F.expr(f"cast(44032 + {s} AS int)") for s in _SYLLABLES)
    syllable = lambda code: F.decode(F.unhex(F.hex(code)), "UTF-16BE")
    gap = F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise("")
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.concat(syllable(one), gap, syllable(two), syllable(three)).alias("name"))


_FINALS = "'!\"#$%&()*+,-./:;<=>?@[]^_{|'"
_LETTERS = " || ".join(f"chr((65 + ({s}) // 588)::INTEGER) || chr((97 + ({s}) % 588 // 28)::INTEGER) || CASE WHEN ({s}) % 28 = 0 THEN '' ELSE substr({_FINALS}, ({s}) % 28, 1) END" for s in _SYLLABLES)


@query(
    f"WITH n AS (SELECT s_suppkey, s_nationkey, {_LETTERS} AS letters FROM supplier) SELECT a.s_suppkey, b.s_suppkey AS other, levenshtein(a.letters, b.letters) AS distance "
    "FROM n a JOIN n b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE levenshtein(a.letters, b.letters) <= 2"
)
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of one nation whose names differ by two letters at most."""
    return op.near_names(korean_names(spark, sf_dir), "s_suppkey", "s_nationkey", "name")


@query(
    "WITH p AS (SELECT l_orderkey, l_returnflag AS tool, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY 1, 2) "
    "SELECT a.l_orderkey, a.lines FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.lines = b.lines AND a.tool = 'R' AND b.tool = 'N'"
    " UNION ALL SELECT l_orderkey, lines FROM p WHERE tool = 'A' AND lines = '1'"
)
def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of which a pending one has the same target: order and sorted lines."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("tool")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("v"))
    p = l.select("l_orderkey", "tool", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("lines"))
    same = p.filter("tool = 'R'").join(p.filter("tool = 'N'").select("l_orderkey", "lines"), ["l_orderkey", "lines"]).select("l_orderkey", "lines")
    return same.union(p.filter("tool = 'A' AND lines = '1'").select("l_orderkey", "lines"))


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 100")
def latest_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred latest of a status: each task keeps its own hundred, nothing is sorted as a whole."""
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").orderBy(F.desc("ts"), "event_id").select("event_id", "ts", "user_id").limit(100)


@query("SELECT event_id, ts, event_type, row_number() OVER (ORDER BY event_id) AS place FROM events WHERE user_id = 7")
def session_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one session in order."""
    e = table(spark, sf_dir, "events").filter("user_id = 7").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.select("event_id", "ts", "event_type", "place")


_CHECKS = {
    "order_customer": "SELECT o_orderkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "line_order": "SELECT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "line_part": "SELECT l_orderkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)",
    "order_repeated": "SELECT o_orderkey AS k FROM orders GROUP BY 1 HAVING count(*) > 1",
    "line_repeated": "SELECT l_orderkey AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "line_amount": "SELECT l_orderkey AS k FROM lineitem WHERE l_quantity <= 0 OR l_extendedprice < 0 OR l_discount NOT BETWEEN 0 AND 1",
    "order_status": "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')",
    "order_total": "SELECT o_orderkey AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice HAVING abs(o_totalprice - sum(l_extendedprice)) > 1",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS check, count(*) AS violations, count(DISTINCT k) AS keys FROM ({sql})" for name, sql in _CHECKS.items()))
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of each invariant of the tables: keys that lead nowhere, repeated keys, bad amounts and states, totals."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    total = l.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("goods")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return op.violations(
        {
            "order_customer": op.dangling(o, "o_custkey", c, "c_custkey").select("o_orderkey"),
            "line_order": op.dangling(l, "l_orderkey", o, "o_orderkey").select("l_orderkey"),
            "line_part": op.dangling(l, "l_partkey", p, "p_partkey").select("l_orderkey"),
            "order_repeated": op.repeated(o, ["o_orderkey"]).select("o_orderkey"),
            "line_repeated": op.repeated(l, ["l_orderkey", "l_linenumber"]).select("l_orderkey"),
            "line_amount": l.filter("l_quantity <= 0 OR l_extendedprice < 0 OR NOT l_discount BETWEEN 0 AND 1").select("l_orderkey"),
            "order_status": o.filter(~F.col("o_orderstatus").isin("F", "O", "P")).select("o_orderkey"),
            "order_total": total.filter("abs(o_totalprice - goods) > 1").select("o_orderkey"),
        }
    )
