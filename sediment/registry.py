"""The registered queries and their SQL, and the driver's tables of one folder that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

c = F.col


class Tables:
    """The driver's tables of one folder, and the postings made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def tagged(self) -> DataFrame:
        """orders with tags: the different part types of their items."""
        tags = self.lineitem.join(self.part, c("l_partkey") == c("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_type").alias("tags"))
        return self.orders.join(tags, c("o_orderkey") == c("l_orderkey"), "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))

    def placed(self, orders: DataFrame | None = None) -> DataFrame:
        """orders with customer, nation and region."""
        where = self.nation.join(self.region, c("n_regionkey") == c("r_regionkey"))
        people = self.customer.join(where, c("c_nationkey") == c("n_nationkey"))
        return (self.orders if orders is None else orders).join(people, c("o_custkey") == c("c_custkey"))

    def as_of(self) -> DataFrame:
        return self.orders.agg(F.max("o_orderdate").alias("now"))


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
