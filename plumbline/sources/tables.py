"""Readers of the base tables and the event frame that every analytic takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an event frame, in order.
FRAME = (
    "report_id",
    "site",
    "ts",
    "activity",
    "energy_type",
    "barrier_type",
    "barrier_status",
    "barrier_failure_mode",
    "exposure",
    "magnitude_class",
    "is_high_energy",
    "sif_potential",
    "lsr_tag",
    "confidence",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def needs_attention(high_energy: Column, exposure: Column, barrier_status: Column, direct_control: Column) -> Column:
    """The label rule: high energy, someone exposed, and no direct control confirmed in place."""
    return high_energy & (exposure != "no_exposure") & ~((barrier_status == "confirmed_present") & direct_control)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines as event frames; report_id is unique, and orders rows that tie elsewhere."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    wide = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    status = (
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "explicitly_absent")
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "uncertain")
        .when(F.col("l_returnflag") == "R", "not_mentioned")
        .otherwise("confirmed_present")
    )
    out = wide.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("report_id"),
        F.col("n_name").alias("site"),
        F.col("l_shipdate").alias("ts"),
        F.col("p_type").alias("activity"),
        F.col("p_brand").alias("energy_type"),
        F.col("c_mktsegment").alias("barrier_type"),
        status.alias("barrier_status"),
        F.when(status.isin("explicitly_absent", "uncertain"), F.col("o_orderpriority")).alias("barrier_failure_mode"),
        F.when(F.col("o_orderstatus") == "F", "direct_proximity").when(F.col("o_orderstatus") == "O", "indirect_proximity").otherwise("no_exposure").alias("exposure"),
        (F.col("p_size") % 5 + 1).cast("int").alias("magnitude_class"),
        (F.col("p_size") % 5 + 1 >= 3).alias("is_high_energy"),
        F.col("p_size"),
        (F.col("l_discount") * 10 + F.lit(0.0)).alias("confidence"),
    )
    flagged = needs_attention(F.col("is_high_energy"), F.col("exposure"), F.col("barrier_status"), F.col("barrier_type").isin("BUILDING", "MACHINERY"))
    out = out.withColumn("sif_potential", flagged)
    return out.withColumn("lsr_tag", F.when(F.col("sif_potential"), F.concat(F.lit("L"), (F.col("p_size") % 9).cast("string"))).otherwise("N/A")).select(*FRAME)


def latest(df: DataFrame, ts: str = "ts"):
    """The fixed clock of windowed analytics: the latest time in the data."""
    return df.agg(F.max(ts)).first()[0]


#: The same projection for the SQL side.
FRAMES_SQL = """
frames AS (
  SELECT *, CASE WHEN sif_potential THEN 'L' || CAST(p_size % 9 AS VARCHAR) ELSE 'N/A' END AS lsr_tag FROM (
    SELECT *, is_high_energy AND exposure <> 'no_exposure' AND NOT (barrier_status = 'confirmed_present' AND barrier_type IN ('BUILDING', 'MACHINERY')) AS sif_potential FROM (
      SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS report_id, n_name AS site, l_shipdate AS ts, p_type AS activity, p_brand AS energy_type,
        c_mktsegment AS barrier_type, barrier_status, CASE WHEN barrier_status IN ('explicitly_absent', 'uncertain') THEN o_orderpriority END AS barrier_failure_mode,
        CASE o_orderstatus WHEN 'F' THEN 'direct_proximity' WHEN 'O' THEN 'indirect_proximity' ELSE 'no_exposure' END AS exposure,
        CAST(1 + p_size % 5 AS INTEGER) AS magnitude_class, 1 + p_size % 5 >= 3 AS is_high_energy, p_size, l_discount * 10 + 0.0 AS confidence
      FROM (SELECT *, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'explicitly_absent' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'uncertain'
              WHEN l_returnflag = 'R' THEN 'not_mentioned' ELSE 'confirmed_present' END AS barrier_status FROM lineitem)
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)))
"""
