"""Connected components of a table of links, by passes that each write their state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(found: DataFrame) -> DataFrame:
    """``v, label`` for every vertex of the links (a, b); label is the smallest vertex reachable.

    Large-star and small-star passes (Kiveris et al. 2014): each hangs a vertex's
    neighbours on the smallest vertex near it, until every vertex hangs on its
    component's smallest. Sums before shuffles keep a vertex of very many links even;
    the number of passes follows the logarithm of the longest path.
    """
    links = durable(found.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        before = links
        # large star: a vertex's larger neighbours hang on the smallest vertex near it
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a vertex and its smaller neighbours hang on the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        links = durable(small.where("u <> v").distinct())
        if links.exceptAll(before).isEmpty() and before.exceptAll(links).isEmpty():
            break
    stars = links.select(F.col("u").alias("v"), F.col("v").alias("label"))
    return durable(stars.union(links.select("v", F.col("v").alias("label"))).distinct())
