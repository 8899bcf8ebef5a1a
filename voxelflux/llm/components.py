"""Connected components of an edge table by alternating large and small stars."""
from pyspark.sql import DataFrame, functions as F

from .textops import forget, stored


def _state(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(stored(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, moves to the least of them."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")))
    down = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another; `root` is the least node of its component, also for itself.
    `edges` has two columns of one type. Nulls, loops and repeated edges are ignored; no edges give no rows.

    A round moves rows between tables in the shared folder, so nothing but two numbers (to see that nothing changed) comes
    to the driver; rounds grow with the logarithm of the node count. A node with many edges is summed before it is shuffled, and meets
    its edges in a join of two stored tables, which can be split at it.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = stored(e.distinct())
    state = _state(e)
    while True:
        new = stored(_small_star(_large_star(e).distinct()))
        forget(e)
        e, last = new, state
        state = _state(e)
        if state == last:
            break
    return e.union(e.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("node"), F.col("v").alias("root"))
