"""Stand-in league tables built from the driver's TPC-H-like tables (FIXTURES.md).

These functions only give rows in the schemas the operators expect; none of the
operators' work happens here. One customer is one player, a nation is a team,
an order is a fixture, and ``events`` supply weekly points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions.constants import POSITION_ORDER
from pitchside.sources import schemas
from pitchside.sources.tables import read_table

# FIXED VALUES of the mapping: market segment -> element_type. Segment 5 has no
# position row, which exercises the "Unknown" default.
SEGMENT_TO_ELEMENT_TYPE = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}
FORM_NA_MODULUS = 97
PPG_NULL_MODULUS = 89
GAMEWEEK_EPOCH = "1995-01-01"
EVENT_NULL_MODULUS = 50
DIFFICULTY_NULL_MODULUS = 11
AWAY_TEAMS = 25


def _segment_case(col: str) -> str:
    whens = " ".join(f"WHEN '{seg}' THEN {code}" for seg, code in SEGMENT_TO_ELEMENT_TYPE.items())
    return f"CAST(CASE {col} {whens} END AS INT)"


def players_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer LEFT JOIN (orders JOIN lineitem, grouped by customer)."""
    lineitem = read_table(spark, sf_dir, "lineitem",
                          ["l_orderkey", "l_quantity", "l_returnflag", "l_linestatus"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    customer = read_table(spark, sf_dir, "customer",
                          ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])

    finished = F.col("l_linestatus") == "F"
    flag = F.col("l_returnflag")
    qty = F.col("l_quantity")
    # Reduce lineitem to one row per order first (map-side partial aggregation),
    # so the join with orders moves order-sized data, not line-sized data.
    per_order = lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(qty).alias("qty"),
        F.count_if(finished & (flag == "R")).alias("g"),
        F.count_if(finished & (flag == "A")).alias("a"),
        F.count_if(finished & (flag == "N")).alias("cs"),
        F.sum(F.when(flag == "R", qty)).alias("q_r"),
        F.sum(F.when(flag == "A", qty)).alias("q_a"),
        F.sum(F.when(flag == "N", qty)).alias("q_n"),
    )
    per_customer = (
        orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "inner")
        .groupBy("o_custkey")
        .agg(
            F.sum("n_lines").alias("total_points"),
            F.sum("qty").alias("minutes_d"),
            F.sum("g").alias("goals_scored"),
            F.sum("a").alias("assists"),
            F.sum("cs").alias("clean_sheets"),
            F.count(F.lit(1)).alias("n_orders"),   # o_orderkey is the key of orders, and lineitem has one row per order here
            F.sum("q_r").alias("q_r"),
            F.sum("q_a").alias("q_a"),
            F.sum("q_n").alias("q_n"),
        )
    )
    total_orders = orders.select(F.count(F.lit(1))).scalar()

    joined = customer.join(per_customer, customer.c_custkey == per_customer.o_custkey, "left")
    # The mapping is plain SQL (FIXTURES.md), so it is written as SQL expressions.
    text = lambda e: f"CAST(CAST({e} AS DOUBLE) AS STRING)"
    joined = joined.withColumn("_sel", F.lit(100.0) * F.col("n_orders") / total_orders)
    return joined.selectExpr(
        "c_custkey AS id",
        "split_part(c_name, '#', 1) AS first_name",
        "split_part(c_name, '#', 2) AS second_name",
        "CAST(c_nationkey AS INT) AS team",
        f"{_segment_case('c_mktsegment')} AS element_type",
        "CAST(floor(c_acctbal / 50.0D) AS INT) AS now_cost",
        "CAST(total_points AS BIGINT) AS total_points",
        "CAST(minutes_d AS BIGINT) AS minutes",
        "CAST(goals_scored AS BIGINT) AS goals_scored",
        "CAST(assists AS BIGINT) AS assists",
        "CAST(clean_sheets AS BIGINT) AS clean_sheets",
        f"CASE WHEN c_custkey % {FORM_NA_MODULUS} = 0 THEN 'n/a' "
        f"ELSE {text('CAST((c_custkey * 7) % 101 AS DOUBLE) / 10.0D')} END AS form",
        f"CASE WHEN c_custkey % {PPG_NULL_MODULUS} = 0 THEN CAST(NULL AS STRING) "
        f"ELSE {text('CAST(total_points AS DOUBLE) / n_orders')} END AS points_per_game",
        f"{text('q_r')} AS influence",
        f"{text('q_a')} AS creativity",
        f"{text('q_n')} AS threat",
        f"{text('minutes_d / 10.0D')} AS ict_index",
        f"{text('_sel')} AS selected_by_percent",
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]).select(
        F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))


def positions(spark: SparkSession) -> DataFrame:
    """The four position rows, ids 1..4 in display order."""
    rows = [(i + 1, name) for i, name in enumerate(POSITION_ORDER)]
    return spark.createDataFrame(rows, schema=schemas.POSITIONS)


def fixtures_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders JOIN customer: one fixture per order, home team = customer's nation."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
    return joined.selectExpr(
        "o_orderkey AS id",
        f"CASE WHEN o_orderkey % {EVENT_NULL_MODULUS} = 0 THEN CAST(NULL AS INT) ELSE CAST(1 + "
        f"floor(datediff(to_date(o_orderdate), DATE'{GAMEWEEK_EPOCH}') / 7.0D) AS INT) END AS event",
        "o_orderstatus = 'F' AS finished",
        "CAST(c_nationkey AS INT) AS team_h",
        f"CAST((o_orderkey * 7 + 3) % {AWAY_TEAMS} AS INT) AS team_a",
        f"CASE WHEN o_orderkey % {DIFFICULTY_NULL_MODULUS} = 0 THEN CAST(NULL AS INT) "
        "ELSE CAST(1 + o_orderkey % 5 AS INT) END AS team_h_difficulty",
    )


def player_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly points per player from ``events`` (sparse: weeks without events are absent)."""
    events = read_table(spark, sf_dir, "events", ["user_id", "ts", "value"])
    half_day = 2 * F.dayofmonth("ts") - 1 + (F.hour("ts") >= 12).cast("int")
    return (
        events.groupBy(F.col("user_id").alias("player_id"), half_day.alias("week"))
        .agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("points"))
        .select(F.col("player_id").cast("long"), F.col("week").cast("int"), F.col("points").cast("long"))
    )
