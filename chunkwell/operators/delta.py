"""What changed between two lists of leaf hashes: as sets, or by walking two trees in step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta_by_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """status (added, removed, unchanged) and chunk_hash of the distinct hashes of both sides, by one aggregation."""
    both = old.select("chunk_hash", F.lit(1).alias("o"), F.lit(0).alias("n")).unionAll(new.select("chunk_hash", F.lit(0), F.lit(1)))
    sides = both.groupBy("chunk_hash").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return sides.select(F.when(F.col("o") == 0, "added").when(F.col("n") == 0, "removed").otherwise("unchanged").alias("status"), "chunk_hash")


def delta_positional(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, hash, is_leaf of two node tables (keys, node_path, hash, is_leaf, leaf_pos), as walked in step.

    Equal nodes end the walk: their leaves are unchanged. A leaf against anything else gives both nodes' hashes,
    which may be inner ones. A tree without its partner gives its leaves. The loop follows the levels, an inner join
    each on the pairs still open.
    """
    a = old.select(*keys, "node_path", F.col("hash").alias("oh"), F.col("is_leaf").alias("ol"))
    b = new.select(*keys, "node_path", F.col("hash").alias("nh"), F.col("is_leaf").alias("nl"))
    pairs = a.join(b, [*keys, "node_path"])
    # a pair is visited if every strict ancestor is an inner pair that differs: that is, none is closed
    closed = pairs.where("oh = nh or ol or nl").select(*keys, "node_path", "oh", "nh")
    top = closed.select(*keys, F.col("node_path").alias("above"))
    strict = F.transform(F.sequence(F.lit(0), F.length("node_path") - 1), lambda i: F.substring(F.col("node_path"), F.lit(1), i))
    above = closed.where("node_path != ''").select(*keys, "node_path", F.explode(strict).alias("above")).join(top, [*keys, "above"], "left_semi").select(*keys, "node_path").distinct()
    visited = closed.join(above, [*keys, "node_path"], "left_anti")
    changed = visited.where("oh != nh")
    ends = changed.select(*keys, "node_path", F.explode(F.array(F.struct(F.lit("removed").alias("status"), F.col("oh").alias("hash")), F.struct(F.lit("added").alias("status"), F.col("nh").alias("hash")))).alias("e")).select(*keys, "node_path", "e.status", "e.hash")
    flags = old.select(*keys, "node_path", F.lit("removed").alias("status"), "is_leaf").unionAll(new.select(*keys, "node_path", F.lit("added"), "is_leaf"))
    moved = ends.join(flags, [*keys, "node_path", "status"]).select(*keys, "status", "hash", "is_leaf")
    same = visited.where("oh = nh").select(*keys, F.col("node_path").alias("above"))
    leaf = old.where("is_leaf").select(*keys, "hash", F.explode(F.transform(F.sequence(F.lit(0), F.length("node_path")), lambda i: F.substring(F.col("node_path"), F.lit(1), i))).alias("above"))
    kept = leaf.join(same, [*keys, "above"]).select(*keys, F.lit("unchanged").alias("status"), "hash", F.lit(True).alias("is_leaf"))
    only = []
    for side, other, status in ((old, new, "removed"), (new, old, "added")):
        only.append(side.where("is_leaf").join(other.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(status).alias("status"), "hash", F.lit(True).alias("is_leaf")))
    return moved.unionAll(kept).unionAll(only[0]).unionAll(only[1])
