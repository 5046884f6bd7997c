"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join, so a hub of any degree is spread like other skewed keys; edges never
leave the executors. Steps are stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _star(directed: DataFrame, larger_only: bool) -> DataFrame:
    """Tie the neighbours v of each u to the smallest of u and them. ``directed`` has (u, v)."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = directed.join(least, "u")
    if larger_only:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): component is the smallest id reachable. Self edges and nulls are ignored."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True)   # (v, m) with m < v
        after = stored(_star(large, False), "star")
        new = _state(after)
        now, changed = after, new != state
        state = new
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
