"""Connected components of a link table, by alternating large-star and small-star steps.

The least neighbours are stored before they are joined back, so that Spark can split a node with very many neighbours.

Each step keeps the components and shortens the paths; it ends after about log(longest path) rounds.  Every round is
written to the shared folder, so plans stay short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.textops import stored


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """(u, v) with u > v.  Large: every larger neighbour of a node links to the node's least neighbour; small: every smaller one and itself."""
    if larger:
        sides = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        out = sides.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = pairs.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, component): every linked node with the least node of its component."""
    pairs = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stored(pairs, "links")
    mark = F.xxhash64("u", "v")
    state = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(mark)).first()
        if state is not None and tuple(now) == state or now[0] == 0:
            break
        state = tuple(now)
        pairs = stored(_star(stored(_star(pairs, True), "links"), False), "links")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
