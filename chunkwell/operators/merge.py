"""Merging two snapshots: a two-way union of their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_paths(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """file_path, side (ours, theirs, both, conflict) of two commits' chunk_refs.

    Files are the same if they have the same chunks at the same places, repeated ones included. Places are compared
    one by one and a file's are counted, so no row holds a file's list.
    """
    place = lambda refs, a, b: refs.select("file_path", "chunk_order", "chunk_hash", F.lit(a).alias("a"), F.lit(b).alias("b"))
    places = place(ours, 1, 0).unionAll(place(theirs, 0, 1)).groupBy("file_path", "chunk_order", "chunk_hash").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = places.groupBy("file_path").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.min(F.least("a", "b")).alias("all"))
    return both.select("file_path", F.when(F.col("b") == 0, "ours").when(F.col("a") == 0, "theirs").when(F.col("all") == 1, "both").otherwise("conflict").alias("side"))


def conflicts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return merge_paths(ours, theirs).where("side = 'conflict'").select("file_path")


def merged_refs(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """file_path, chunk_order, chunk_hash, chunk_offset, chunk_length of the merge; conflicting paths are left out.

    Offsets are summed up anew from the lengths.
    """
    sides = merge_paths(ours, theirs)
    taken = lambda refs, *names: refs.select("file_path", "chunk_order", "chunk_hash", "chunk_length").join(sides.where(F.col("side").isin(*names)).select("file_path"), "file_path", "left_semi")
    rows = taken(ours, "ours", "both").unionAll(taken(theirs, "theirs"))
    w = Window.partitionBy("file_path").orderBy("chunk_order").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("file_path", "chunk_order", "chunk_hash", (F.sum("chunk_length").over(w) - F.col("chunk_length")).alias("chunk_offset"), "chunk_length")
