"""Connected components of an undirected graph given as links, without collecting links or nodes.

Two steps take turns until nothing changes: each node's larger neighbours are linked to its smallest neighbour
(or itself), then each node's smaller neighbours are. Every round keeps the components and leaves, after a number
of rounds that grows with the logarithm of their size, one star around each smallest node. Neighbours are never
gathered in a list: the smallest one is an aggregate and the links are joined to it, so a node with very many
links is dealt out by the join: the smallest neighbours are written first, so that adaptive execution sees two plain
tables and splits the rows of a hot node. Each round is written to the shared folder too, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import materialise


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: bigint); component is its smallest node.

    Null ends, loops and repeated links do no harm; no links give an empty result.
    """
    now = materialise(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    state = _state(now)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        now = materialise(_small(_large(now)), "links")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _state(links: DataFrame) -> tuple:
    """Two sets of links are taken for equal if their number and two sums of hashes are."""
    low = lambda salt: F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v", F.lit(salt)), F.lit((1 << 40) - 87))), F.lit(0))
    return tuple(links.agg(F.count(F.lit(1)), low(1), low(2)).first())


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    least = materialise(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
