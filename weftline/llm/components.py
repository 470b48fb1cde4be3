"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialise

#: More rounds than any graph of up to 2**40 nodes needs.
MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and root (the least node of its component) for every node of an edge other than a loop.

    Each step groups edges by one end with a partial minimum and joins it back; the edges are
    written between rounds, so lineage stays short and a lost executor costs one round.
    Null ends are left out; repeated edges and both directions are allowed.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = materialise(now, "edges")
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        new = materialise(small, "edges")
        # done once every node hangs on one root and no root hangs on another
        open_ = new.groupBy("u").count().where("count > 1").select("u").unionByName(new.join(new.select(F.col("u").alias("v")).distinct(), "v").select("u")).limit(1).count()
        now = new
        if not open_:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
