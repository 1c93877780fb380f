"""Queries on the states of a learning path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findara.plans.catalog import query
from findara.plans.engine import phases
from findara.session import table


@query("""SELECT c_custkey, CASE WHEN count(o_orderkey) > 0 THEN 'completado' ELSE 'pendiente' END AS findings, CASE WHEN count(o_orderkey) FILTER (o_orderstatus = 'F') > 0 OR count(o_orderkey) FILTER (o_orderstatus = 'P') > 0 THEN 'completado' ELSE 'pendiente' END AS people,
          CASE WHEN count(o_orderkey) FILTER (o_orderstatus = 'O') > 1 OR count(o_orderkey) FILTER (o_orderpriority = '1-URGENT') > 0 THEN 'activo' ELSE 'pendiente' END AS curriculum, 'pendiente' AS steps
          FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def learning_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of each customer: all orders are findings, finished and partial ones people and groups."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    status = F.col("o_orderstatus")
    n = rows.groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("all"), count(status == "F").alias("f"), count(status == "P").alias("p"),
        F.greatest(count(status == "O") - 1, F.lit(0)).alias("o"), count(F.col("o_orderpriority") == "1-URGENT").alias("u"),
    )
    state = phases(F.col("all"), F.col("f"), F.col("p"), F.col("o"), F.col("u"))
    return n.select("c_custkey", *[F.get(state, F.lit(i)).alias(c) for i, c in enumerate(("findings", "people", "curriculum", "steps"))])
