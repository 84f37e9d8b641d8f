"""Connected components of an edge table by repeated contraction, on narrow shuffled tables only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.llm.shared import pin


def components(edges: DataFrame) -> DataFrame:
    """(v, component) of every vertex of ``edges`` (a, b: long); the component's name is one of its vertices.

    Each round every vertex moves to the smallest vertex among itself and its neighbours, by number in even rounds
    (stars close at once) and by a fresh hash in odd ones (long chains shrink by a constant share), and edges are
    renamed and made distinct. A vertex with very many neighbours is reduced map-side, and its joins can split."""
    edges = pin(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("component", F.col("v"))
    number = 0
    while not edges.isEmpty():
        def rank(c: str, number: int = number) -> Column:
            return F.col(c) if number % 2 == 0 else F.xxhash64(c, F.lit(number))

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = (both.withColumn("r", rank("b")).groupBy("a").agg(F.min("r").alias("r"), F.min_by("b", "r").alias("to"))
                 .filter(F.col("r") < rank("a")).select(F.col("a").alias("from"), "to"))
        moves = pin(moves, "moves")
        a, b = (moves.select(F.col("from").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = (edges.join(a, "a", "left").join(b, "b", "left")
                 .select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).filter("a <> b"))
        edges = pin(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        labels = (labels.join(moves.withColumnRenamed("from", "component"), "component", "left")
                  .select("v", F.coalesce("to", "component").alias("component")))
        number += 1
    return pin(labels, "components")
