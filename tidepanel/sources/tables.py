"""Panels from the star schema: months by supplier or part, days by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rows
from ..operators.panel import densify
from .scratch import bounded, settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_facts(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """``ticker, date, close, volume, dv``: the month's average price per unit, quantity and turnover. Sums run on whole cents."""
    lines = table(spark, sf_dir, "lineitem").select(F.col(key).alias("ticker"), F.last_day(F.col("l_shipdate").cast("date")).alias("date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("units"))
    sums = lines.groupBy("ticker", "date").agg(F.sum("cents").alias("cents"), F.sum("units").alias("units"))
    return sums.select("ticker", "date", (F.col("cents") / 100.0 / F.col("units")).alias("close"), F.col("units").cast("double").alias("volume"), (F.col("cents") / 100.0).alias("dv"))


def month_panel(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """The dense panel of :func:`month_facts`."""
    return densify(settled(month_facts(spark, sf_dir, key), "months"))  # for names, calendar and cells: one scan of the lines


def smooth_panel(spark: SparkSession, sf_dir: str, first: int = 12) -> DataFrame:
    """Suppliers' running average price, from month ``first`` on, its ordinals counted anew."""
    panel = bounded(settled(month_panel(spark, sf_dir), "dense"), "ticker")
    price = F.sum("dv").over(rows(None, 0)) / F.sum("volume").over(rows(None, 0))
    return panel.withColumn("close", price).where(F.col("t") >= first).withColumn("t", F.col("t") - first)


def day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, date, close, volume``: each user's last value of a day, and the day's number of events."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("date"), "ts", "event_id", "value")
    return events.groupBy("ticker", "date").agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
