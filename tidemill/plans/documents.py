"""Orders and customers with everything that belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import documents as op
from tidemill.plans.calls import shop
from tidemill.registry import query


def _flat(name: str, *fields: str):
    """An array of structs as text, to be compared."""
    return F.array_join(F.transform(name, lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))), " ").alias(name)


_LINES = "l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS part, min(l_quantity)::BIGINT AS q, bool_or(l_returnflag = 'R') AS back FROM lineitem GROUP BY 1, 2)"


@query(
    f"WITH {_LINES}, a AS (SELECT o, string_agg(n || ':' || part || ':' || q || ':' || CASE WHEN back THEN 'return_requested' ELSE 'ordered' END, ' ' ORDER BY n) AS lines, "
    "string_agg('RT-' || o || '-' || n || ':' || CASE WHEN n % 2 = 0 THEN 'defective' ELSE 'changed_mind' END, ' ' ORDER BY 'RT-' || o || '-' || n) FILTER (back) AS requests FROM l GROUP BY o) "
    "SELECT o_orderkey::VARCHAR AS order_id, o_custkey::VARCHAR AS customer_id, CASE o_orderstatus WHEN 'O' THEN 'paid' WHEN 'F' THEN 'delivered' ELSE 'shipping' END AS status, coalesce(lines, '') AS lines, "
    "round(o_totalprice)::BIGINT AS paid_won, coalesce(requests, '') AS requests, (o_orderdate::DATE + 3)::VARCHAR AS promised_by, CASE WHEN o_orderkey % 3 = 0 THEN 'CP-' || o_orderkey || '-1' ELSE '' END AS coupons, 'A' || o_custkey || '-1' AS address "
    "FROM orders LEFT JOIN a ON o = o_orderkey"
)
def full_order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines, payment, requests, shipment, address and coupons nested, in one aggregation."""
    s = shop(spark, sf_dir)
    found = op.nested(
        s.orders.select("order_id", "customer_id", "status"),
        "order_id",
        {
            "lines": (s.lines, ["line_no", "variant_id", "quantity", "status"]),
            "payment": (s.orders, ["amount_won"]),
            "requests": (s.requests, ["request_id", "reason"]),
            "shipment": (s.orders, ["promised_by", "delivered_at", "ship_address_id"]),
            "coupons": (s.coupons, ["coupon_id", "issued_at"]),
        },
        single=["payment", "shipment"],
    )
    return found.select("order_id", "customer_id", "status", _flat("lines", "line_no", "variant_id", "quantity", "status"), F.col("payment.amount_won").alias("paid_won"), _flat("requests", "request_id", "reason"), F.col("shipment.promised_by").cast("string").alias("promised_by"), _flat("coupons", "coupon_id"), F.col("shipment.ship_address_id").alias("address"))


@query(
    "WITH o AS (SELECT o_custkey AS c, string_agg(o_orderkey || ':' || CASE o_orderstatus WHEN 'O' THEN 'paid' WHEN 'F' THEN 'delivered' ELSE 'shipping' END, ' ' ORDER BY o_orderkey::VARCHAR) AS orders, "
    "string_agg('CP-' || o_orderkey || '-1', ' ' ORDER BY 'CP-' || o_orderkey || '-1') FILTER (o_orderkey % 3 = 0) AS coupons FROM orders GROUP BY 1) "
    "SELECT c_custkey::VARCHAR AS customer_id, c_name AS name, coalesce(orders, '') AS orders, 'A' || c_custkey || '-1 A' || c_custkey || '-2' AS addresses, coalesce(coupons, '') AS coupons, "
    "CASE WHEN c_custkey % 4 = 0 THEN 'TK-' || c_custkey || '-1 TK-' || c_custkey || '-4' ELSE '' END AS tickets FROM customer LEFT JOIN o ON c = c_custkey"
)
def full_customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders, addresses, coupons and tickets nested, in one aggregation."""
    s = shop(spark, sf_dir)
    parents = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("name"))
    found = op.nested(parents, "customer_id", {"orders": (s.orders, ["order_id", "status"]), "addresses": (s.addresses, ["address_id"]), "coupons": (s.coupons, ["coupon_id", "order_id"]), "tickets": (s.tickets, ["ticket_id"])})
    return found.select("customer_id", "name", _flat("orders", "order_id", "status"), _flat("addresses", "address_id"), _flat("coupons", "coupon_id"), _flat("tickets", "ticket_id"))
