"""Sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def links(xml: Column) -> Column:
    """All <loc> texts of a sitemap, trimmed, non-blank, each once."""
    found = F.transform(F.xpath(xml, F.lit("//loc/text()")), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def read(spark: SparkSession, path: str) -> DataFrame:
    """url and sitemap of every file under a path (one file, one sitemap)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("sitemap"), "value")
    return files.select("sitemap", F.explode(links(F.col("value"))).alias("url"))
