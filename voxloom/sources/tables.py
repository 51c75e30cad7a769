"""Scans of the Parquet tables below one folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str, day: str | None = None) -> DataFrame:
    """Scan ``folder/name.parquet``; with ``columns`` only these are read, with ``day`` only that day."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df if day is None else df.filter(F.col("day") == day)
    return df.select(*columns) if columns else df


PRODUCT = "struct<product_id: string, canonical_name: string, family: string, versions: array<string>, aliases: array<string>, generic_aliases: array<string>>"


def catalog_json(spark: SparkSession, path: str, variable: str = "VOXLOOM_CATALOG") -> DataFrame:
    """The product catalog from one JSON object {"products": [...]}; the environment variable names another file."""
    place = os.environ.get(variable) or path
    return spark.read.schema(f"products array<{PRODUCT}>").option("multiLine", True).json(place).selectExpr("inline(products)")
