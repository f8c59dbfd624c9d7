"""Connected components of an edge table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node that it reaches.

    Each round gives a node the least label of its neighbours, hands the same offer to
    the node's present root (else long chains would move a step a round), and then
    replaces a label by that label's own label. Rounds end when no label moves, so the
    result is exact for any graph. An edge is joined on its own ends only, whose degree
    the edge table bounds; the one join on labels, where a component's label may be hot,
    has an unaggregated exchange on both sides, which adaptive execution can split.
    Offers are combined before they are shuffled. No edges: no rows. Loops, repeated
    edges and either direction are fine; edges with a null end are left out.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    with Tables(edges.sparkSession) as tables:
        # both directions come from one pass over the edges, which may be costly to make
        both = tables.put(e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct())
        labels = tables.put(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
        while True:
            seen = both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("offer")), "v")
            offers = seen.groupBy("u").agg(F.min("offer").alias("offer"))
            offers = labels.join(offers, labels.node == offers.u, "left").select("node", "root", F.least("root", "offer").alias("offer"))
            offers = tables.put(offers)
            hooks = (
                offers.select("node", "offer")
                .unionByName(offers.where("offer < root").select(F.col("root").alias("node"), "offer"))
                .groupBy("node").agg(F.min("offer").alias("offer"))
            )
            hooked = tables.put(labels.join(hooks, "node").select("node", F.col("root").alias("was"), F.least("root", "offer").alias("root")))
            above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = tables.put(hooked.join(above, "root", "left").select("node", "was", F.least("root", "top").alias("root")))
            labels = jumped.select("node", "root")
            if jumped.where("root <> was").isEmpty():
                return cut(labels)
