"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloop.session import cut_lineage


def _links(a, b) -> list:
    return [F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")]


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b", store=cut_lineage) -> DataFrame:
    """``node``, ``label``: every node of ``links`` with the smallest node reachable from it.

    Alternating star contraction: first every node's larger neighbours are hung under the smallest
    of its neighbourhood, then its smaller ones, until nothing changes.  A round is a grouped minimum
    (combined on the map side) and one join each; the number of rounds grows with the logarithm of the
    longest chain.  The minima are stored before they are joined, so that both sides of a join are plain
    exchanges and Spark's adaptive join can split a hub that has a third of all links.  Links with a null
    end and links to itself name no link and are ignored; an empty table gives an empty result.  ``store``
    writes a table under a name and reads it back.
    """
    links = links.filter(F.col(a) != F.col(b)).select(*_links(F.col(a), F.col(b))).distinct()
    links = store(links, "links")
    mark = _mark(links)
    while mark[0]:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
        large = store(both.join(least, "u").filter("v > u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "star-large")
        under = store(large.groupBy("hi").agg(F.min("lo").alias("m")), "star-under")
        moved = large.join(under, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = store(moved.unionAll(under.select("hi", F.col("m").alias("lo"))).distinct(), "star-small")
        before, mark = mark, _mark(links)
        if before == mark:
            break
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionAll(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
