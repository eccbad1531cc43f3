"""Relational views of the given tables in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators.carry import running_sum

MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_type AS product_id",
        "concat('t', event_id) AS trade_id",
        f"{MS} AS ts_ms",
        "event_id AS ingest_seq",
        "CASE user_id % 3 WHEN 0 THEN 'Buy' WHEN 1 THEN 'Sell' ELSE 'Unknown' END AS side",
        "value AS price",
        "CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS size",
    )


def l2_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level per message; every 500th message of a product is a snapshot, every 7th event deletes. Messages are counted bucket by bucket."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_type AS product_id",
        f"{MS} AS ts_ms",
        "event_id AS seq",
        "0 AS ord",
        "CASE WHEN user_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side",
        "CAST(floor(value) AS DOUBLE) AS price",
        "CASE WHEN event_id % 7 = 0 THEN 0D ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) END AS quantity",
    )
    kind = F.when((F.col("nth") - 1) % 500 == 0, "snapshot").otherwise("update").alias("kind")
    return running_sum(rows, ["product_id"], "seq", F.lit(1), "nth").select("product_id", "ts_ms", "seq", "ord", kind, "side", "price", "quantity")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('C', o_custkey % 500) AS ticker",
        "o_orderkey AS accession_no",
        "CAST(o_orderdate AS DATE) AS filing_date",
        "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '4' WHEN '2' THEN '10-K' WHEN '3' THEN '10-Q' WHEN '4' THEN '8-K' ELSE 'DEF 14A' END AS form",
    )


def insider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed transactions; code K is unknown on purpose."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.selectExpr(
        "concat('P', l_partkey % 200) AS ticker",
        "l_orderkey AS accession_no",
        "s_name AS owner_name",
        "CAST(l_shipdate AS DATE) AS transaction_date",
        "CASE l_linenumber WHEN 1 THEN 'P' WHEN 2 THEN 'S' WHEN 3 THEN 'A' WHEN 4 THEN 'F' WHEN 5 THEN 'M' WHEN 6 THEN 'G' ELSE 'K' END AS transaction_code",
        "l_quantity AS shares",
        "l_extendedprice / l_quantity AS price_per_share",
        "l_returnflag = 'R' AS is_derivative",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS cik",
        "'us-gaap' AS taxonomy",
        "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' WHEN '2' THEN 'NetIncomeLoss' WHEN '3' THEN 'Assets' WHEN '4' THEN 'Liabilities' ELSE 'StockholdersEquity' END AS concept",
        "CASE o_orderstatus WHEN 'F' THEN 'USD' WHEN 'O' THEN 'shares' ELSE 'EUR' END AS unit",
        "CAST(o_orderdate AS DATE) AS end_date",
        "o_totalprice AS val",
        "o_orderkey AS pos",
        "CASE WHEN o_orderkey % 4 = 0 THEN '10-K' ELSE '10-Q' END AS form",
    )
