"""Reads and writes of the metadata tables as plans; writes return the table's new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FormatMismatchError
from ..functions.scalars import BRANCH_PREFIX, chunker_signature
from ..sources.session import written

# ---- reads


def list_files(files: DataFrame, status: str | None = None) -> DataFrame:
    return (files.where(F.col("status") == status) if status is not None else files).orderBy("path")


def by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key) == value)


def latest_commit(commits: DataFrame) -> DataFrame:
    """The newest commit; of several with its time the one with the largest hash."""
    return commits.orderBy(F.col("timestamp").desc(), F.col("commit_hash").desc()).limit(1)


def list_commits(commits: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; a limit holds only if positive."""
    df = commits.orderBy(F.col("timestamp").desc(), F.col("commit_hash").desc())
    return df.limit(limit) if limit and limit > 0 else df


def commit_chunk_refs(refs: DataFrame, commit: str) -> DataFrame:
    return refs.where(F.col("commit_hash") == commit).orderBy("file_path", "chunk_order")


def file_chunks(refs: DataFrame, chunks: DataFrame, commit: str | None = None, path: str | None = None) -> DataFrame:
    """References with their chunks' sizes, null where a chunk isn't recorded."""
    if commit is not None:
        refs = refs.where(F.col("commit_hash") == commit)
    if path is not None:
        refs = refs.where(F.col("file_path") == path)
    return refs.join(chunks.select("chunk_hash", "size_uncompressed", "size_compressed"), "chunk_hash", "left")


def commit_file_paths(refs: DataFrame, commit: str) -> DataFrame:
    return refs.where(F.col("commit_hash") == commit).select("file_path").distinct().orderBy("file_path")


def commit_chunk_hashes(refs: DataFrame) -> DataFrame:
    """commit_hash, chunk_hash and first_seq of each commit's chunks: first_seq orders them as first seen."""
    return refs.groupBy("commit_hash", "chunk_hash").agg(F.min("ref_seq").alias("first_seq"))


def commit_parents(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges of the graph: recorded parents, or for commits without any the single parent of their own row."""
    old = commits.join(parents.select("commit_hash"), "commit_hash", "left_anti").where("parent_hash is not null and parent_hash != ''")
    return parents.select("commit_hash", "parent_hash", "ordinal").unionAll(old.select("commit_hash", "parent_hash", F.lit(0).alias("ordinal")))


def list_refs(refs: DataFrame, prefix: str = "") -> DataFrame:
    return refs.where(F.col("ref_name").startswith(prefix)).orderBy("ref_name")


def list_branches(refs: DataFrame) -> DataFrame:
    found = refs.where(F.col("ref_name").startswith(BRANCH_PREFIX))
    return found.select(F.substring("ref_name", len(BRANCH_PREFIX) + 1, 1 << 30).alias("name"), "commit_hash").orderBy("name")


def lookup(config: DataFrame, key: str, default: str | None = None) -> str | None:
    row = config.where(F.col("key") == key).select("value").first()
    return row.value if row is not None and row.value is not None else default


def cached_chunks(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (with file_hash) and cached: their chunk lists where the cache has one that isn't empty, else null."""
    return files.join(cache.where(F.size("chunks") > 0).select("file_hash", F.col("chunks").alias("cached")), "file_hash", "left")


def active_chunks(refs: DataFrame) -> DataFrame:
    return refs.select("chunk_hash").distinct()


def orphan_chunks(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    return chunks.join(refs.select("chunk_hash"), "chunk_hash", "left_anti")


# ---- writes


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of `rows` in place of those with their keys; a key may come once in rows."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def latest_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of several rows of a key the last in order: one aggregation, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*rows.columns)


def new_rows(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows with keys that table lacks, of each the first in order."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
    return first.join(table.select(*keys), keys, "left_anti").select(*table.columns)


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table and the rows with new keys, of each the first in order: the first writer wins."""
    return table.unionByName(new_rows(table, rows, keys, order))


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti").select(*table.columns)


def delete_commits(commits: DataFrame, refs: DataFrame, parents: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the commits in gone (commit_hash): references and parents go with them."""
    return tuple(delete(t, gone, ["commit_hash"]) for t in (commits, refs, parents))


def delete_chunk_records(chunks: DataFrame, refs: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks without those in gone (chunk_hash), but for chunks that a commit still references."""
    return delete(chunks, gone.join(refs.select("chunk_hash"), "chunk_hash", "left_anti"), ["chunk_hash"])


def signature_differences(recorded: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """key, recorded, expected where a recorded value (key, value) isn't the engine's; keys not recorded are no difference."""
    spark = recorded.sparkSession
    own = spark.createDataFrame(sorted((expected or chunker_signature()).items()), "key string, expected string")
    return recorded.join(F.broadcast(own), "key").where("value != expected").select("key", F.col("value").alias("recorded"), "expected")


def verify_signature(recorded: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """The rows to record: none if the signature is there and right, all if it isn't there. FormatMismatchError lists every difference."""
    own = expected or chunker_signature()
    wrong = signature_differences(recorded, own).orderBy("key").collect()  # at most four rows
    if wrong:
        raise FormatMismatchError("; ".join(f"{r.key}: recorded {r.recorded}, expected {r.expected}" for r in wrong))
    there = lookup(recorded, "chunker_id")
    return recorded.sparkSession.createDataFrame([] if there else sorted(own.items()), "key string, value string")


def numbered_refs(chunks: DataFrame, commit: str) -> DataFrame:
    """chunk_refs rows of a snapshot's chunk rows: ref_seq follows path and order.

    Files are dealt out by ranges of path and summed up within a range; the ranges' totals, a row each, are summed up
    after that. No task holds all files.
    """
    per = chunks.groupBy("path").agg(F.count("*").alias("n")).repartitionByRange("path").withColumn("part", F.spark_partition_id())
    per = written(per, "numbered")
    totals = per.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))  # a row for each range
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("path")) - F.col("n")
    start = per.select("path", "part", inside.alias("inside")).join(F.broadcast(base), "part").select("path", (F.col("base") + F.col("inside")).alias("start"))
    joined = chunks.join(start, "path")
    return joined.select((F.col("start") + F.col("chunk_order") + 1).cast("bigint").alias("ref_seq"), F.lit(commit).alias("commit_hash"), F.col("path").alias("file_path"), "chunk_hash", "chunk_offset", "chunk_length", "chunk_order")
