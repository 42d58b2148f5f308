"""Edge lists derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each part of an order to the next."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("dst is not null")


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the customer's nation to the supplier's, for each order line."""
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    customers, suppliers = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))


def cust_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From customers to suppliers, with text ids."""
    joined = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a page's path to the targets of its links."""
    pages = _table(spark, sf_dir, "pages")
    return pages.select(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r"""href\s*=\s*["']([^"']+)["']"""), F.lit(1))).alias("dst"))


def event_type_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event type of a user to the next."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).where("dst is not null")


#: The same definitions for other SQL engines.
SQL = {
    "part_chain": "select src, dst from (select l_partkey::bigint src, (lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey))::bigint dst from lineitem) where dst is not null",
    "nation_trade": "select c_nationkey::bigint src, s_nationkey::bigint dst from orders join lineitem on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey",
    "cust_supp": "select 'c' || o_custkey src, 's' || l_suppkey dst from orders join lineitem on o_orderkey = l_orderkey",
    "page_links": """select regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) src, unnest(regexp_extract_all(html, 'href\\s*=\\s*["'']([^"'']+)["'']', 1)) dst from pages""",
    "event_type_flow": "select src, dst from (select event_type src, lead(event_type) over (partition by user_id order by ts, event_id) dst from events) where dst is not null",
}
VIEWS = {f.__name__: f for f in (part_chain, nation_trade, cust_supp, page_links, event_type_flow)}
#: Views whose ids are text and get dense numbers.
NAMED = ("cust_supp", "page_links", "event_type_flow")
