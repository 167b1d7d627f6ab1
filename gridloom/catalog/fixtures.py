"""The operators' inputs, bound to the driver's tables: the same text in Spark and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

R = 4  # side of a window on the small grids
N_COLS, N_ROWS = 20, 10

INST = """SELECT l_orderkey AS series_id, CAST(l_linenumber AS BIGINT)*1000000000 + l_partkey*10000 + l_suppkey AS sop_id,
 l_discount AS px_spacing, l_quantity AS px_cols, l_tax*1000 AS px_rows, l_extendedprice AS instance_size, l_linestatus AS transfer_syntax,
 CASE WHEN l_returnflag='R' THEN 'LABEL' ELSE 'VOLUME' END AS image_kind FROM lineitem"""
SERIES = """SELECT o.o_orderkey AS series_id, o.o_custkey AS patient_id, lower(c.c_mktsegment) AS collection_id,
 o.o_orderpriority AS site, o.o_orderstatus AS stain, o.o_totalprice AS series_size
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""
GRID = """SELECT CAST(floor(p_partkey/200) AS INT) AS slide_id, CAST(floor((p_partkey%200)/20) AS INT) AS grid_i,
 CAST(p_partkey%20 AS INT) AS grid_j, p_partkey AS tile_id, p_size AS size,
 CAST(p_size AS DOUBLE)/50 AS tissue_frac, CAST((p_partkey*37)%100 AS DOUBLE)/1000 AS artifact_frac FROM part"""
VEC = """SELECT vec_id, embedding, label AS slide_id, CAST(vec_id%20 AS INT) AS grid_i, CAST(floor(vec_id/20)%20 AS INT) AS grid_j,
 CAST(1 + vec_id%7 AS DOUBLE)/8 AS quality FROM embeddings"""


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    for name, df in tables.items():
        text = f"WITH {name} AS (SELECT * FROM {{{name}}}) " + text if not text.startswith("WITH ") else text.replace("WITH ", f"WITH {name} AS (SELECT * FROM {{{name}}}), ", 1)
    return spark.sql(text, **tables)


def inst(spark: SparkSession, sf: str) -> DataFrame:
    out = _sql(spark, INST, lineitem=_read(spark, sf, "lineitem"))
    return out.select("series_id", "sop_id", "px_spacing", "px_cols", "px_rows", "instance_size", "transfer_syntax", F.array("image_kind").alias("kinds"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, SERIES, orders=_read(spark, sf, "orders"), customer=_read(spark, sf, "customer"))


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, GRID, part=_read(spark, sf, "part"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, VEC, embeddings=_read(spark, sf, "embeddings"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _read(spark, sf, name)
