"""The commit graph: ancestry, history, missing commits, common commits and names of commits.

Reachability doubles: each round joins every known path with the paths that begin at its end, so a chain of n commits
takes log2(n) rounds, each written to the shared folder, and not n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BRANCH_PREFIX
from ..sources.session import mark, release, written


def history(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """start, commit_hash: every commit reachable from each start (commit_hash), itself included.

    edges: (commit_hash, parent_hash). After round k every commit less than 2**k steps back is known, by jumps of
    exactly 2**(k - 1) steps; it ends when a round finds nothing new, so cycles end too. Jumps are made of the whole
    graph: which part the starts reach is known at the end only.
    """
    spark, since = edges.sparkSession, mark(edges.sparkSession)
    jumps = written(edges.select(F.col("commit_hash").alias("a"), F.col("parent_hash").alias("b")).where("a is not null and b is not null").distinct(), "jumps")
    seen = written(starts.select(F.col("commit_hash").alias("start"), "commit_hash").distinct(), "seen")
    count = seen.count()
    while True:
        more = seen.join(jumps, seen.commit_hash == jumps.a).select("start", F.col("b").alias("commit_hash"))
        seen = written(seen.unionAll(more).distinct(), "seen")
        now = seen.count()
        if now == count:
            release(spark, since, [seen])
            return seen
        count = now
        jumps = written(jumps.join(jumps.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct(), "jumps")


def commit_history(commits: DataFrame, starts: DataFrame, edges: DataFrame) -> DataFrame:
    """history() with each commit's timestamp, 0 where it isn't known; order by it, newest first."""
    return history(starts, edges).join(commits.select("commit_hash", "timestamp"), "commit_hash", "left").select("start", "commit_hash", F.coalesce("timestamp", F.lit(0.0)).alias("timestamp"))


def is_ancestor(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (ancestor, descendant) with is_ancestor: a commit is its own; an empty or null one is none's."""
    starts = pairs.where("descendant is not null and descendant != ''").select(F.col("descendant").alias("commit_hash")).distinct()
    found = history(starts, edges).select(F.col("start").alias("descendant"), F.col("commit_hash").alias("ancestor"), F.lit(True).alias("found"))
    return pairs.join(found, ["ancestor", "descendant"], "left").select("ancestor", "descendant", (F.coalesce("found", F.lit(False)) & (F.col("ancestor") != "")).alias("is_ancestor"))


def missing_commits(source: DataFrame, target: DataFrame) -> DataFrame:
    """Commits of source that target lacks, oldest first."""
    return source.join(target.select("commit_hash"), "commit_hash", "left_anti").orderBy("timestamp", "commit_hash")


def newest_common_commit(source: DataFrame, target: DataFrame) -> DataFrame:
    """The newest commit, by time, in both."""
    return source.join(target.select("commit_hash"), "commit_hash", "left_semi").orderBy(F.col("timestamp").desc(), F.col("commit_hash").desc()).limit(1)


def resolve(wanted: DataFrame, refs: DataFrame, commits: DataFrame, least: int = 6) -> DataFrame:
    """wanted (ref) with commit_hash and n: a branch's short name, a full ref name, an exact hash or a unique prefix, in that order.

    n is how many commits the best kind of match gives: 1 resolves, 0 is unknown, more is ambiguous. Prefixes have
    `least` digits or more. Commits are counted by their prefixes of the lengths that occur in wanted, and these are
    joined: an equi-join, not a comparison of every pair.
    """
    names = refs.select(F.col("ref_name"), F.col("commit_hash"))
    short = wanted.join(names.withColumn("ref", F.substring("ref_name", len(BRANCH_PREFIX) + 1, 1 << 30)).where(F.col("ref_name").startswith(BRANCH_PREFIX)).select("ref", "commit_hash"), "ref").withColumn("kind", F.lit(1))
    full = wanted.join(names.select(F.col("ref_name").alias("ref"), "commit_hash"), "ref").withColumn("kind", F.lit(2))
    exact = wanted.join(commits.select(F.col("commit_hash").alias("ref"), "commit_hash"), "ref").withColumn("kind", F.lit(3))
    found = short.unionByName(full).unionByName(exact).distinct().groupBy("ref", "kind").agg(F.count("*").alias("n"), F.min("commit_hash").alias("commit_hash"))
    longest = commits.agg(F.max(F.length("commit_hash"))).first()[0] or 0
    lengths = [r[0] for r in wanted.select(F.length("ref").alias("n")).where(F.col("n").between(least, longest)).distinct().collect()]
    heads = commits.select("commit_hash").distinct().withColumn("n", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).where(F.length("commit_hash") >= F.col("n"))
    prefix = heads.select(F.expr("left(commit_hash, n)").alias("ref"), "commit_hash").join(wanted, "ref", "left_semi").groupBy("ref").agg(F.count("*").alias("n"), F.min("commit_hash").alias("commit_hash")).withColumn("kind", F.lit(4))
    best = found.unionByName(prefix).groupBy("ref").agg(F.min(F.struct("kind", "n", "commit_hash")).alias("m"))
    joined = wanted.select("ref").distinct().join(best, "ref", "left")
    return joined.select("ref", F.when(F.col("m.n") == 1, F.col("m.commit_hash")).alias("commit_hash"), F.coalesce(F.col("m.n"), F.lit(0)).cast("bigint").alias("n"))
