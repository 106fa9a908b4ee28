"""Categorical frames over the star schema: features as text, a row id, and an indicator z."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's segment, nation and region; z: status is F."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority", "c_mktsegment", "n_name", "r_name", (F.col("o_orderstatus") == "F").cast("int").alias("z"))


ORDERS_SQL = """SELECT o_orderkey AS id, o_orderstatus, o_orderpriority, c_mktsegment, n_name, r_name, (o_orderstatus = 'F')::INT AS z
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items; z: flag R with a line number up to 2, or an order number divisible by 20."""
    t = table(spark, sf_dir, "lineitem")
    planted = ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") <= 2)) | (F.col("l_orderkey") % 20 == 0)
    return t.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        "l_returnflag",
        "l_linestatus",
        F.col("l_linenumber").cast("string").alias("l_linenumber"),
        F.round(F.col("l_discount") * 100).cast("int").cast("string").alias("l_discount"),
        planted.cast("int").alias("z"),
    )


LINES_SQL = """SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber,
  round(l_discount * 100)::INT::VARCHAR AS l_discount, ((l_returnflag = 'R' AND l_linenumber <= 2) OR l_orderkey % 20 = 0)::INT AS z FROM lineitem"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")


def marked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, whose columns together have more cells than the rows can fill; z: every fifth part."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("id"), "p_brand", "p_type", "p_size", F.concat(F.lit("v"), key % 5).alias("bucket"), (key % 5 == 0).cast("int").alias("z"))


PARTS_SQL = "SELECT p_partkey AS id, p_brand, p_type, p_size, 'v' || (p_partkey % 5)::VARCHAR AS bucket, (p_partkey % 5 = 0)::INT AS z FROM part"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with hour of day, user group and size of value; z: purchase."""
    t = table(spark, sf_dir, "events")
    return t.select(
        F.col("event_id").alias("id"),
        "event_type",
        F.floor(F.hour("ts") / 6).cast("int").cast("string").alias("quarter"),
        (F.col("user_id") % 4).cast("string").alias("user_group"),
        F.when(F.col("value") >= 50, "high").otherwise("low").alias("size"),
        (F.col("event_type") == "purchase").cast("int").alias("z"),
    )


EVENTS_SQL = """SELECT event_id AS id, event_type, floor(hour(ts) / 6)::INT::VARCHAR AS quarter, (user_id % 4)::VARCHAR AS user_group,
  CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS size, (event_type = 'purchase')::INT AS z FROM events"""

LINE_FEATURES = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"]
ORDER_FEATURES = ["o_orderpriority", "c_mktsegment", "r_name"]
PART_FEATURES = ["p_brand", "p_type", "p_size"]
EVENT_FEATURES = ["quarter", "user_group", "size"]
