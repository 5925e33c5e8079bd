"""The catalogue's roles, read from Parquet tables, and the same roles as DuckDB CTEs for checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Catalogue:
    """Reads each role on demand; only the columns that a query uses reach the scan."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def region(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("long").alias("region_id"), F.col("r_name").alias("region"))

    @property
    def suburb(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            k.cast("long").alias("suburb_id"), F.col("n_name").alias("suburb"), F.col("n_regionkey").cast("long").alias("region_id"),
            F.when(k % 5 != 0, (1 + k % 7).cast("double")).alias("sqkm"), (1000 * (k + 1)).cast("long").alias("population"), (2000 + k).cast("long").cast("string").alias("postcode"),
            (F.lit(-34.0) + (k % 5) * F.lit(0.2)).alias("lat"), (F.lit(150.5) + ((k * 3) % 25) * F.lit(0.04)).alias("lng"),
        )

    @property
    def venue(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("venue_id"), F.col("c_name").alias("venue"), F.col("c_nationkey").cast("long").alias("suburb_id"), F.col("c_acctbal").alias("rating"),
            (F.lit(-34.0) + (k % 997) * F.lit(0.001)).alias("lat"), (F.lit(150.5) + ((k * 7) % 1009) * F.lit(0.001)).alias("lng"),
        )

    @property
    def deal(self) -> DataFrame:
        s = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("deal_id"), F.col("o_custkey").alias("venue_id"), F.when(s == "F", "approved").when(s == "O", "new").otherwise("rejected").alias("status"),
            F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("date").alias("start_date"), F.col("o_totalprice").alias("price"),
        )

    @property
    def schedule(self) -> DataFrame:
        start = (F.col("l_quantity").cast("int") * 30) % 1440
        number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        return self.table("lineitem").select(F.col("l_orderkey").alias("deal_id"), number.alias("schedule_id"), F.dayofweek("l_shipdate").alias("day"), start.alias("start"), (start + 30 * F.col("l_linenumber")).cast("int").alias("end"))

    @property
    def event(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), F.when(k % 9 > 0, k % 9).alias("day"))


#: The same roles in DuckDB.
ROLES = """
region_ AS (SELECT r_regionkey::BIGINT AS region_id, r_name AS region FROM region),
suburb_ AS (SELECT n_nationkey::BIGINT AS suburb_id, n_name AS suburb, n_regionkey::BIGINT AS region_id, CASE WHEN n_nationkey % 5 <> 0 THEN (1 + n_nationkey % 7)::DOUBLE END AS sqkm,
  (1000 * (n_nationkey + 1))::BIGINT AS population, (2000 + n_nationkey)::BIGINT::VARCHAR AS postcode, -34.0::DOUBLE + (n_nationkey % 5) * 0.2::DOUBLE AS lat, 150.5::DOUBLE + ((n_nationkey * 3) % 25) * 0.04::DOUBLE AS lng FROM nation),
venue_ AS (SELECT c_custkey AS venue_id, c_name AS venue, c_nationkey::BIGINT AS suburb_id, c_acctbal AS rating, -34.0::DOUBLE + (c_custkey % 997) * 0.001::DOUBLE AS lat, 150.5::DOUBLE + ((c_custkey * 7) % 1009) * 0.001::DOUBLE AS lng FROM customer),
deal_ AS (SELECT o_orderkey AS deal_id, o_custkey AS venue_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'new' ELSE 'rejected' END AS status, o_orderpriority AS title, o_orderdate::DATE AS start_date, o_totalprice AS price FROM orders),
schedule_ AS (SELECT l_orderkey AS deal_id, l_orderkey * 10 + l_linenumber AS schedule_id, (dayofweek(l_shipdate) + 1)::INT AS day, (l_quantity::INT * 30) % 1440 AS s, (l_quantity::INT * 30) % 1440 + 30 * l_linenumber AS e FROM lineitem),
event_ AS (SELECT event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k')::INT AS k, CASE WHEN json_extract_string(props, '$.k')::INT % 9 > 0 THEN json_extract_string(props, '$.k')::INT % 9 END AS day FROM events)
"""
