"""Readers of the small text files around a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.names import recorded_at_from_name

INTERVALS = "start_s double, end_s double, value int"
BOARD = "player string, eliminations int, assists int, damage_dealt int, damage_taken int, knock_outs int"


def truth_csv(spark: SparkSession, path: str, schema: str = INTERVALS) -> DataFrame:
    """Intervals with a known value, or boards with known cells."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8")


def roster_list(spark: SparkSession, path: str) -> DataFrame:
    """name: the lines of a text file; comments (#) and blank lines are skipped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("name")).filter((F.col("name") != "") & ~F.col("name").startswith("#"))


def roster_table(spark: SparkSession, path: str) -> DataFrame:
    """name: column 2, in backticks, of the rows of a markdown table whose column 1 is a number."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*\|\s*\d+\s*\|\s*`([^`]+)`", 1).alias("name")).filter("name <> ''")


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """source_file, recorded_at: from the name, else the time the file was last changed."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("source_file"), F.coalesce(_stamp(name), F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss")).alias("recorded_at"))


def _stamp(name: Column) -> Column:
    return recorded_at_from_name(name)
