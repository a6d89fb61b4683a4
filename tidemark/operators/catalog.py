"""Catalog search: a term, a category and whether only what is available counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(name: Column, category: Column, available: Column, term: Column, wanted: Column, only_available: Column) -> Column:
    """The trimmed term anywhere in the name, whatever its case; the category, or ``all``; and availability if asked."""
    found = F.contains(F.lower(name), F.lower(F.trim(term)))
    return found & ((wanted == "all") | (category == wanted)) & (~only_available | available)


def result_count(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " result").otherwise(" results"))


def searched(products: DataFrame, searches: DataFrame) -> DataFrame:
    """``(search, n, shown)`` for each search (search, term, category, only_available): a small table, broadcast to the products."""
    s = F.broadcast(searches.select("search", "term", F.col("category").alias("_wanted"), "only_available"))
    on = matches(F.col("name"), F.col("category"), F.col("available"), F.col("term"), F.col("_wanted"), F.col("only_available"))
    found = products.join(s, on).groupBy("search").agg(F.count("*").alias("n"))
    out = searches.select("search").join(found, "search", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return out.withColumn("shown", result_count(F.col("n")))
