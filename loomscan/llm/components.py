"""Connected components of a distributed graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, materialize, workspace


def _state(e: DataFrame) -> tuple:
    """Number of links and 128 bits of hashes of them; rounds that change nothing are known by it."""
    h = [F.xxhash64(F.lit(k), "v", "u") for k in range(2)]
    return tuple(e.agg(F.count("*"), *[F.bit_xor(x) for x in h]).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; component is the smallest node that can be reached.

    Nodes may be of any ordered type. Links need no order and may repeat; links with a null end or of a node with
    itself are left out; an empty table gives no rows. Each round joins the links with the least neighbour of their
    nodes and cuts lineage by writing to shared storage; the number of rounds grows with the logarithm of the
    diameter. Nothing is collected, and links of a hub are dealt over many tasks.
    """
    with workspace(links.sparkSession):
        e = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u is not null and v is not null and u <> v").distinct()
        e = materialize(e, "cc")
        state = _state(e)
        while n := state[0]:
            # large star: larger neighbours of u go to the least neighbour of u
            both = e.union(e.select(F.col("u").alias("v"), F.col("v").alias("u"))).select("u", "v")
            least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
            large = dealt_join(both, least, "u", "n", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
            # small star: u and its smaller neighbours go to the least of them
            least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            small = dealt_join(large, least, "u", "n", n).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
            e = materialize(small.select("v", "u"), "cc")
            before, state = state, _state(e)
            if state == before:
                break
        out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        return materialize(out, "components", keep=True)
