"""Connected components by repeated contraction onto the smallest neighbour; nothing but sizes reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import durable_round


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp) of the undirected links (a, b); comp is the smallest node of the component.

    Each round maps a node to the first of itself and its neighbours (a map-side combined minimum) and replaces every link by that of
    its ends' images. Two rounds go by the nodes' own order, which ends most inputs; later ones by an order hashed anew each round,
    so that long chains too shrink by a constant factor. Nodes without links, null ends and self-links yield no row; no links yield
    an empty result. A hot node is only a hot join key, which adaptive execution splits.
    """
    edges = links.where("a is not null and b is not null and a <> b").select("a", "b")
    maps: list[DataFrame] = []
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        if len(maps) < 2:
            m = ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("to"))
        else:
            place = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
            m = ends.groupBy("node").agg(F.min(place("other")).alias("m")).select("node", F.least(place("node"), "m")["x"].alias("to"))
        m = durable_round(m)
        maps.append(m)
        left, right = m.toDF("a", "ta"), m.toDF("b", "tb")
        edges = durable_round(edges.join(left, "a").join(right, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        if edges.isEmpty():
            break
    out = maps[0].select("node", F.col("to").alias("comp"))
    for m in maps[1:]:
        out = out.join(m.toDF("comp", "next"), "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
    if len(maps) > 2:  # the last image is not the smallest node
        out = durable_round(out)
        out = out.join(out.groupBy("comp").agg(F.min("node").alias("least")), "comp").select("node", F.col("least").alias("comp"))
    return out
