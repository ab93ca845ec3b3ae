"""What a push or pull has to move between two stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dag import missing_commits, newest_common_commit


def candidates(source_commits: DataFrame, source_refs: DataFrame, target_commits: DataFrame) -> DataFrame:
    """chunk_hash of every chunk that the missing commits reference, less those of the newest common commit.

    All missing commits count, so a chunk that only one in the middle has is moved too. Without missing commits the
    plan is empty.
    """
    missing = missing_commits(source_commits, target_commits).select("commit_hash")
    base = newest_common_commit(source_commits, target_commits).select("commit_hash")
    wanted = source_refs.join(missing, "commit_hash", "left_semi").select("chunk_hash").distinct()
    return wanted.join(source_refs.join(base, "commit_hash", "left_semi").select("chunk_hash"), "chunk_hash", "left_anti")


def trees_of(nodes: DataFrame, commits: DataFrame) -> DataFrame:
    """The stored trees of commits (commit_hash); a commit without one has no rows here."""
    return nodes.join(commits.select("commit_hash"), "commit_hash", "left_semi")


def leaves_or_refs(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """commit_hash, chunk_hash of each commit: its stored tree's leaves, or its references where it has no tree."""
    leaves = nodes.where("is_leaf").select("commit_hash", F.col("hash").alias("chunk_hash"))
    rest = refs.select("commit_hash", "chunk_hash").join(nodes.where("node_path = ''").select("commit_hash"), "commit_hash", "left_anti")
    return leaves.unionAll(rest)


def uses_trees(source_commits: DataFrame, target_commits: DataFrame, nodes: DataFrame) -> bool:
    """Whether a delta of trees is possible: something is missing, and the newest common and the newest missing commit have trees."""
    base = newest_common_commit(source_commits, target_commits).select("commit_hash")
    newest = missing_commits(source_commits, target_commits).orderBy(F.col("timestamp").desc(), F.col("commit_hash").desc()).limit(1).select("commit_hash")
    return trees_of(nodes.where("node_path = ''"), base.unionAll(newest)).count() == 2


def plan(wanted: DataFrame, source_objects: DataFrame, target_objects: DataFrame) -> DataFrame:
    """chunk_hash and action: skip (the target has it), send, or absent (the source lacks it)."""
    t = target_objects.select("chunk_hash", F.lit(True).alias("t"))
    s = source_objects.select("chunk_hash", F.lit(True).alias("s"))
    return wanted.join(t, "chunk_hash", "left").join(s, "chunk_hash", "left").select("chunk_hash", F.when(F.col("t"), "skip").when(F.col("s"), "send").otherwise("absent").alias("action"))


def transfer(wanted: DataFrame, source_objects: DataFrame, target_objects: DataFrame) -> DataFrame:
    """The objects to append to the target."""
    return source_objects.join(plan(wanted, source_objects, target_objects).where("action = 'send'").select("chunk_hash"), "chunk_hash", "left_semi")


def stats(actions: DataFrame, sizes: DataFrame, commits: DataFrame, used_delta: bool) -> DataFrame:
    """One row: transferred_chunks, transferred_bytes (stored size), skipped_chunks, commits_synced, used_merkle_delta."""
    sums = actions.join(sizes.select("chunk_hash", "stored_bytes"), "chunk_hash", "left").agg(
        F.count_if(F.col("action") == "send").alias("transferred_chunks"),
        F.coalesce(F.sum(F.when(F.col("action") == "send", F.col("stored_bytes"))), F.lit(0)).cast("bigint").alias("transferred_bytes"),
        F.count_if(F.col("action") == "skip").alias("skipped_chunks"),
    )
    return sums.crossJoin(commits.agg(F.count("*").alias("commits_synced"))).withColumn("used_merkle_delta", F.lit(used_delta))  # one row each
