"""Raster, cell, track and file-list views over the star-schema tables.

Each view exists twice, as a DataFrame for the Spark queries and as SQL text for the
independent check.  Values are integers wherever possible so that sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Height and width of a mosaic image; the last image may lack pixels.
MOSAIC_SIZE = (80, 80)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50x50 images with 25 round cells each, one image per 2,500 orders."""
    return table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 2500").alias("image_set"),
        F.expr("cast((o_orderkey % 2500) div 50 as int)").alias("y"),
        F.expr("cast(o_orderkey % 50 as int)").alias("x"),
        F.expr("cast(floor(o_totalprice) as bigint) % 4096").alias("value"),
    ).select(
        F.expr("concat('c', cast(image_set % 3 as string))").alias("condition"),
        "image_set", "y", "x",
        F.expr("""
            case when (y%10-4)*(y%10-4) + (x%10-4)*(x%10-4)
                      <= 4 + 3*(((y div 10)*5 + x div 10) % 4)
                 then cast((y div 10)*5 + x div 10 + 1 as int) else 0 end""").alias("label"),
        "value",
    )


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80x80 images of 100 vectors each, with border cells and touching cells."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode("embedding").alias("p", "v")
    ).selectExpr(
        "vec_id div 100 as image_set", "vec_id % 100 as sub",
        "p div 8 as ly", "p % 8 as lx",
        "cast(round(cast(v as double) * 1000) as bigint) + 1000 as value",
    ).selectExpr(
        "concat('c', cast(image_set % 2 as string)) as condition", "image_set",
        "cast((sub div 10)*8 + ly as int) as y", "cast((sub % 10)*8 + lx as int) as x",
        """cast(case when ly between 1 and 3 and lx between 1 and 3 then 3*sub+1
                     when ly between 1 and 6 and lx between 5 and 6 then 3*sub+2
                     when ly between 5 and 6 and lx between 0 and 4 then 3*sub+3
                     else 0 end as int) as label""",
        "cast(case when ly = 2 and lx = 2 then 3*sub+1 else 0 end as int) as nuclear_label",
        "value",
    )


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaic as two markers, A and its complement B."""
    return mosaic(spark, sf_dir).select(
        "condition", "image_set", "y", "x", "label", "nuclear_label",
        F.explode(F.array(
            F.struct(F.lit("A").alias("marker"), F.col("value")),
            F.struct(F.lit("B").alias("marker"), (2000 - F.col("value")).alias("value")),
        )).alias("m"),
    ).select("condition", "image_set", "m.marker", "y", "x", "label", "nuclear_label", "m.value")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderstatus as Condition", "o_custkey % 40 as ImageSet", "o_orderkey as CellID",
        "20 + (o_orderkey * 37) % 400 as Area", "o_totalprice as A_CTCF",
        "greatest(o_totalprice - 150000, 0) as B_CTCF",
    )


def ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag as Condition", "l_extendedprice as Red_CTCF",
        "round(l_discount * 100) * 500 + (case when l_discount = 0 then 0 else l_quantity end) as GFP_CTCF",
        "l_quantity * 4 as Area",
    )


def ratio2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`ratio`, with two conditions."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_linestatus as Condition", "l_extendedprice as Red_CTCF",
        "round(l_discount * 100) * 500 + (case when l_discount = 0 then 0 else l_quantity end) as GFP_CTCF",
        "l_quantity * 4 as Area",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_type as condition", "datediff(cast(ts as date), date'2024-01-01') as frame",
        "event_id as label", "cast(user_id as double) as cy", "value as cx",
        "10 + event_id % 50 as area", "value as mean_intensity",
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .selectExpr("event_type as condition", "datediff(cast(ts as date), date'2024-01-01') as frame",
                    "user_id", "event_id", "value")
        .groupBy("condition", "frame", "user_id")
        .agg(F.max("event_id").alias("label"), F.max_by("value", "event_id").alias("v"))
        .selectExpr("condition", "frame", "user_id as track_id", "label",
                    "cast(user_id as double) as cy", "v as cx", "v as mean_intensity",
                    "case when user_id >= 2 then user_id div 2 end as parent_id")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag as condition",
        """concat('HaCaT_A0', cast(l_suppkey % 5 as string), '_sx_', cast(l_partkey % 4 as string),
                  '_w', cast(1 + l_linenumber % 3 as string), '.tif') as name""",
    ).distinct()


def gappy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names with some channels missing and, per condition, one name that does not parse."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag as condition",
        """case when l_partkey % 4 = 3 and l_linenumber % 3 = 2 then 'single.tif'
                else concat('HaCaT_A0', cast(l_suppkey % 5 as string), '_sx_', cast(l_partkey % 4 as string),
                            '_w', cast(1 + l_linenumber % 3 as string), '.tif') end as name""",
    ).distinct()


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id % 20 as image_set", "ts", "event_id as seq", "event_type as operation"
    )


def calibration_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = raster(spark, sf_dir)
    dark = px.selectExpr("'dark' as kind", "cast(image_set as int) as frame_no", "y", "x", "value % 64 as value")
    flat = px.selectExpr("'flat' as kind", "cast(image_set as int) as frame_no", "y", "x",
                         "1000 + value % 200 as value")
    return dark.unionByName(flat)


_RATIO_SQL = """
  SELECT {cond} AS Condition, l_extendedprice AS Red_CTCF,
         round(l_discount * 100) * 500 + (CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity END) AS GFP_CTCF,
         l_quantity * 4 AS Area
  FROM lineitem"""

_NAME_SQL = """'HaCaT_A0' || CAST(l_suppkey % 5 AS VARCHAR) || '_sx_' || CAST(l_partkey % 4 AS VARCHAR)
         || '_w' || CAST(1 + l_linenumber % 3 AS VARCHAR) || '.tif'"""

SQL: dict[str, str] = {
    "raster": """
  SELECT 'c' || CAST(image_set % 3 AS VARCHAR) AS condition, image_set, y, x,
         CASE WHEN (y%10-4)*(y%10-4) + (x%10-4)*(x%10-4) <= 4 + 3*(((y//10)*5 + x//10) % 4)
              THEN CAST((y//10)*5 + x//10 + 1 AS INT) ELSE 0 END AS label,
         value
  FROM (SELECT o_orderkey // 2500 AS image_set,
               CAST((o_orderkey % 2500) // 50 AS INT) AS y,
               CAST(o_orderkey % 50 AS INT) AS x,
               CAST(floor(o_totalprice) AS BIGINT) % 4096 AS value
        FROM orders)""",
    "mosaic": """
  SELECT 'c' || CAST(image_set % 2 AS VARCHAR) AS condition, image_set,
         CAST((sub // 10)*8 + ly AS INT) AS y, CAST((sub % 10)*8 + lx AS INT) AS x,
         CAST(CASE WHEN ly BETWEEN 1 AND 3 AND lx BETWEEN 1 AND 3 THEN 3*sub+1
                   WHEN ly BETWEEN 1 AND 6 AND lx BETWEEN 5 AND 6 THEN 3*sub+2
                   WHEN ly BETWEEN 5 AND 6 AND lx BETWEEN 0 AND 4 THEN 3*sub+3 ELSE 0 END AS INT) AS label,
         CAST(CASE WHEN ly = 2 AND lx = 2 THEN 3*sub+1 ELSE 0 END AS INT) AS nuclear_label,
         value
  FROM (SELECT vec_id // 100 AS image_set, vec_id % 100 AS sub, p // 8 AS ly, p % 8 AS lx,
               CAST(round(CAST(embedding[p+1] AS DOUBLE) * 1000) AS BIGINT) + 1000 AS value
        FROM (SELECT vec_id, unnest(range(64)) AS p, embedding FROM embeddings))""",
    "markers": """
  SELECT condition, image_set, 'A' AS marker, y, x, label, nuclear_label, value FROM mosaic
  UNION ALL
  SELECT condition, image_set, 'B' AS marker, y, x, label, nuclear_label, 2000 - value AS value FROM mosaic""",
    "cells": """
  SELECT o_orderstatus AS Condition, o_custkey % 40 AS ImageSet, o_orderkey AS CellID,
         20 + (o_orderkey * 37) % 400 AS Area, o_totalprice AS A_CTCF,
         greatest(o_totalprice - 150000, 0) AS B_CTCF
  FROM orders""",
    "ratio": _RATIO_SQL.format(cond="l_returnflag"),
    "ratio2": _RATIO_SQL.format(cond="l_linestatus"),
    "detections": """
  SELECT event_type AS condition, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS frame,
         event_id AS label, CAST(user_id AS DOUBLE) AS cy, value AS cx,
         10 + event_id % 50 AS area, value AS mean_intensity
  FROM events""",
    "tracks": """
  SELECT event_type AS condition, frame, user_id AS track_id, max(event_id) AS label,
         CAST(user_id AS DOUBLE) AS cy, arg_max(value, event_id) AS cx,
         arg_max(value, event_id) AS mean_intensity,
         CASE WHEN user_id >= 2 THEN user_id // 2 END AS parent_id
  FROM (SELECT *, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS frame FROM events)
  GROUP BY event_type, frame, user_id""",
    "files": f"SELECT DISTINCT l_returnflag AS condition, {_NAME_SQL} AS name FROM lineitem",
    "gappy_files": f"""
  SELECT DISTINCT l_returnflag AS condition,
         CASE WHEN l_partkey % 4 = 3 AND l_linenumber % 3 = 2 THEN 'single.tif' ELSE {_NAME_SQL} END AS name
  FROM lineitem""",
    "edit_log": "SELECT user_id % 20 AS image_set, ts, event_id AS seq, event_type AS operation FROM events",
    "calibration_frames": """
  SELECT 'dark' AS kind, CAST(image_set AS INT) AS frame_no, y, x, value % 64 AS value FROM raster
  UNION ALL
  SELECT 'flat' AS kind, CAST(image_set AS INT) AS frame_no, y, x, 1000 + value % 200 AS value
  FROM raster""",
}
