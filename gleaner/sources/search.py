"""A Python data source for organic search results behind any client, and its clean-up.

The client is a callable from a query to a list of dicts with link, title and snippet. Spark plans one
partition for each query, so queries run in parallel on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleaner.functions.url import normalize_url


def search_source(client: Callable[[str], list[dict]], name: str = "search") -> type[DataSource]:
    class Reader(DataSourceReader):
        def __init__(self, queries: list[str]):
            self.queries = queries

        def partitions(self):
            return [InputPartition(q) for q in self.queries]

        def read(self, partition):
            for place, r in enumerate(client(partition.value)):
                yield partition.value, place, r.get("link"), r.get("title"), r.get("snippet")

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "query string, place int, link string, title string, snippet string"

        def reader(self, schema):
            return Reader([q for q in self.options.get("queries", "").split("\n") if q])

    return Source


def search_links(spark: SparkSession, client: Callable[[str], list[dict]], queries: list[str], prefix: str) -> DataFrame:
    """query, url and reason of the results under a prefix, each URL once, at its best place."""
    spark.dataSource.register(search_source(client))
    rows = spark.read.format("search").option("queries", "\n".join(queries)).load()
    url = normalize_url(F.col("link"))
    rows = rows.select("query", "place", url.alias("url"), F.coalesce("snippet", "title", F.lit("search result")).alias("reason")).filter(F.col("url").startswith(prefix))
    best = rows.groupBy("url").agg(F.min(F.struct("place", "query", "reason")).alias("r"))
    return best.select("r.query", "url", "r.reason")
