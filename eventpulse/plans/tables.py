"""The test tables as the operators' inputs, in Spark and as the same SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = [("one_time", ["1-URGENT", "2-HIGH"]), ("pass", ["3-MEDIUM", "4-NOT"]), ("unknown", ["5-LOW"])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order and part: kind, people, class_title, venue, person, month, method, owner_text."""
    from eventpulse.functions.text import method_group

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("l_returnflag") == "R", "cancellation").otherwise("reservation").alias("kind"),
        F.col("l_quantity").cast("long").alias("people"),
        F.concat_ws(" ", "p_type", "p_name").alias("class_title"),
        F.col("p_brand").alias("venue"),
        F.col("o_custkey").alias("person"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        method_group("o_orderpriority", METHODS, "unknown").alias("method"),
        F.col("p_name").alias("owner_text"),
        F.col("p_partkey").alias("part_id"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


BOOKINGS = """
bookings AS (SELECT o_orderkey AS order_id, CASE WHEN l_returnflag = 'R' THEN 'cancellation' ELSE 'reservation' END AS kind,
  CAST(l_quantity AS BIGINT) AS people, p_type || ' ' || p_name AS class_title, p_brand AS venue, o_custkey AS person,
  strftime(o_orderdate, '%Y-%m') AS month,
  CASE WHEN o_orderpriority LIKE '%1-URGENT%' OR o_orderpriority LIKE '%2-HIGH%' THEN 'one_time'
       WHEN o_orderpriority LIKE '%3-MEDIUM%' OR o_orderpriority LIKE '%4-NOT%' THEN 'pass' ELSE 'unknown' END AS method,
  p_name AS owner_text, p_partkey AS part_id, p_size AS size, p_retailprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a label: review_id, venue (Brand#n for source srcn), rating, class and other ratings, visits, needs_review, text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_doc")
    joined = docs.join(labels, docs["doc_id"] == labels["l_doc"])
    return joined.select(
        F.col("doc_id").alias("review_id"),
        F.concat(F.lit("Brand#"), F.substring("source", 4, 10)).alias("venue"),
        (F.col("quality") * 2 + 3).cast("double").alias("rating"),
        F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("quality") + 4).cast("double").alias("class_rating"),
        (F.col("doc_id") % 7 + 1).cast("long").alias("visits"),
        (F.col("toxic") == 1).alias("needs_review"),
        "text",
        "lang",
    )


REVIEWS = """
reviews AS (SELECT d.doc_id AS review_id, 'Brand#' || substring(source, 4, 10) AS venue, CAST(quality * 2 + 3 AS DOUBLE) AS rating,
  CASE WHEN toxic = 1 THEN NULL ELSE CAST(quality + 4 AS DOUBLE) END AS class_rating, CAST(d.doc_id % 7 + 1 AS BIGINT) AS visits,
  toxic = 1 AS needs_review, text, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def with_views(*views: str) -> str:
    """A WITH clause of view definitions, to be followed by a SELECT."""
    return "WITH " + ",".join(v.strip() for v in views) + " "
